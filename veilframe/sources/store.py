"""The mapping of placeholders to values, encrypted at rest.

A store is a folder: generations of Parquet tables whose rows are sealed with AES-GCM, and a
small header that names the current one.  Rows are sealed and opened by the executors, so a
mapping may be as large as any table; the header is replaced by a rename, so a run that dies
leaves the former state.  The key never appears in a plan: it is read by a scalar subquery.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.masking import MAPPING

TABLES = {"mapping": MAPPING, "glossary": "term string, kind string, aliases array<string>", "allowlist": "value string"}
VERSION, BACKUPS = 1, 3
DEFAULT_KDF = {"n": 1 << 15, "r": 8, "p": 1}


class StoreError(Exception):
    """The store can not be read."""


class WrongPassword(StoreError):
    """The password is wrong, or the store was changed by others."""


def check_kdf(kdf: dict) -> dict:
    """Bounds on what a header may demand, so that opening one can not exhaust the machine."""
    if set(kdf) != {"n", "r", "p"} or any(type(v) is not int for v in kdf.values()):
        raise StoreError("the header's key derivation is malformed")
    n, r, p = kdf["n"], kdf["r"], kdf["p"]
    if n < 2 or n & (n - 1) or not 1 <= r <= 32 or not 1 <= p <= 8 or 128 * n * r > 1 << 30:
        raise StoreError("the header's key derivation is out of range")
    return kdf


def _key(password: str, salt: bytes, kdf: dict) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=kdf["n"], r=kdf["r"], p=kdf["p"], maxmem=(128 * kdf["n"] * kdf["r"] + (1 << 20)) * 2, dklen=32)


class Store:
    def __init__(self, spark: SparkSession, path: str, key: bytes, header: dict):
        self.spark, self.path, self._secret, self.header = spark, path.rstrip("/"), key, header

    @classmethod
    def create(cls, spark: SparkSession, path: str, password: str, kdf: dict | None = None) -> Store:
        salt, kdf = os.urandom(16), check_kdf(dict(kdf or DEFAULT_KDF))
        store = cls(spark, path, _key(password, salt, kdf), {"version": VERSION, "kdf": kdf, "salt": base64.b64encode(salt).decode(), "generation": 0})
        if store._exists("header.json"):
            raise StoreError("a store is there already")
        store.save()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, password: str) -> Store:
        store = cls(spark, path, b"", {})
        if not store._exists("header.json"):
            raise StoreError("no store there")
        try:
            header = json.loads(store._read("header.json"))
            version, kdf, salt = header["version"], check_kdf(header["kdf"]), base64.b64decode(header["salt"], validate=True)
            seal = base64.b64decode(header.pop("seal"), validate=True)
        except (KeyError, TypeError, ValueError) as bad:
            raise StoreError("the header is malformed") from bad
        if type(version) is not int or version != VERSION:
            raise StoreError(f"version {version!r} is not supported")
        store._secret, store.header = _key(password, salt, kdf), header
        sealed = spark.createDataFrame([(bytearray(seal),)], "c binary")
        if sealed.select(F.try_aes_decrypt("c", store._secret_column(), F.lit("GCM"), F.lit("DEFAULT"), store._bound("header")).alias("x")).first()["x"] is None:
            raise WrongPassword("wrong password, or the store was changed")
        return store

    def _secret_column(self) -> Column:
        return self.spark.createDataFrame([(bytearray(self._secret),)], "k binary").scalar()

    def _bound(self, name: str) -> Column:
        """What a row is bound to besides the key: its table and the whole header."""
        return F.lit(f"{name}:{json.dumps(self.header, sort_keys=True, separators=(',', ':'))}")

    def _file(self, name: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, name: str) -> bool:
        fs, at = self._file(name)
        return fs.exists(at)

    def _read(self, name: str) -> str:
        fs, at = self._file(name)
        stream = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def _replace(self, name: str, content: str) -> None:
        fs, staged = self._file(f".{name}.new")
        _, at = self._file(name)
        out = fs.create(staged, True)
        out.write(bytearray(content.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(staged, at, options)

    def table(self, name: str) -> DataFrame:
        """A stored table; a changed row fails the query that reads it."""
        rows = self.spark.read.schema("c binary").parquet(f"{self.path}/gen-{self.header['generation']}/{name}")
        plain = F.aes_decrypt("c", self._secret_column(), F.lit("GCM"), F.lit("DEFAULT"), self._bound(name))
        return rows.select(F.from_json(plain.cast("string"), TABLES[name]).alias("r")).select("r.*")

    def save(self, **tables: DataFrame) -> None:
        """Writes a new generation (tables not given stay as they are), keeps the last three before."""
        now = {n: tables[n] if n in tables else (self.table(n) if self.header["generation"] else self.spark.createDataFrame([], s)) for n, s in TABLES.items()}
        own = Store(self.spark, self.path, self._secret, self.header | {"generation": self.header["generation"] + 1})
        own._write(now)
        self.header = own.header
        fs, at = self._file(f"gen-{self.header['generation'] - BACKUPS - 1}")
        fs.delete(at, True)

    def _write(self, tables: dict[str, DataFrame]) -> None:
        secret = self._secret_column()
        for name, df in tables.items():
            sealed = F.aes_encrypt(F.to_json(F.struct(*df.columns)).cast("binary"), secret, F.lit("GCM"), F.lit("DEFAULT"), None, self._bound(name))
            df.select(sealed.alias("c")).write.mode("overwrite").parquet(f"{self.path}/gen-{self.header['generation']}/{name}")
        one = self.spark.createDataFrame([("sealed",)], "s string")
        seal = one.select(F.aes_encrypt(F.col("s").cast("binary"), secret, F.lit("GCM"), F.lit("DEFAULT"), None, self._bound("header")).alias("c")).first()["c"]
        self._replace("header.json", json.dumps(self.header | {"seal": base64.b64encode(bytes(seal)).decode()}))

    def rekey(self, password: str, kdf: dict | None = None) -> None:
        """Seals everything anew; earlier generations, readable with the old password, go."""
        salt, kdf = os.urandom(16), check_kdf(dict(kdf or DEFAULT_KDF))
        now = {n: self.table(n) for n in TABLES}
        generation = self.header["generation"] + 1
        own = Store(self.spark, self.path, _key(password, salt, kdf), {"version": VERSION, "kdf": kdf, "salt": base64.b64encode(salt).decode(), "generation": generation})
        own._write(now)
        for old in range(max(1, generation - BACKUPS - 1), generation):
            fs, at = self._file(f"gen-{old}")
            fs.delete(at, True)
        self._secret, self.header = own._secret, own.header
