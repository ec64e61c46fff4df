"""Text files as rows: decoding, folder scans and masked copies."""

from __future__ import annotations

import codecs
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import ship

SUFFIXES = (".txt", ".md", ".docx", ".xlsx")
# The longer marks first: one of UTF-32 begins like one of UTF-16.
_MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"), (codecs.BOM_UTF8, "utf-8-sig"))
DECODED = "struct<text:string,bom:boolean,error:string>"


def decode(data: bytes) -> dict:
    """Text of a file, whether it began with a UTF-8 mark, or why it can not be read.

    A mark decides the encoding, and what does not fit it is an error; without one UTF-8 is
    tried, then Windows-1252.
    """
    marked = next((name for mark, name in _MARKS if data.startswith(mark)), None)
    for name in [marked] if marked else ["utf-8", "cp1252"]:
        try:
            return {"text": data.decode(name), "bom": name == "utf-8-sig", "error": None}
        except UnicodeDecodeError:
            continue
    return {"text": None, "bom": False, "error": f"not readable as {marked or 'UTF-8 or Windows-1252'}"}


def decoded(content: Column) -> Column:
    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(bytes(b)) if b is not None else {"text": None, "bom": False, "error": "no content"} for b in rows], columns=["text", "bom", "error"])

    ship(SparkSession.active())
    return F.pandas_udf(run, DECODED)(content)


def scan(spark: SparkSession, path: str, recursive: bool = False, out: str | None = None, results: bool = False) -> DataFrame:
    """``path, suffix, status, content`` of a folder's files; one status a file.

    Hidden files and folders, earlier results (``.anon``, ``.restored``) and what lies under
    ``out`` are no input, unless ``results`` asks for earlier results; files with other endings
    are listed as skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    below = F.substr("path", F.locate(path.rstrip("/"), F.col("path")) + len(path.rstrip("/")))
    mine = ~below.rlike(r"/\.")
    if not results:
        mine &= ~name.rlike(r"\.(anon|restored)(\.[^.]*)?$")
    if out and not results:
        mine &= ~F.contains(F.col("path"), F.lit(out.rstrip("/") + "/"))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    status = F.when(suffix.isin(*SUFFIXES), "ready").otherwise("skipped")
    return files.where(mine).select("path", suffix.alias("suffix"), status.alias("status"), F.when(status == "ready", F.col("content")).alias("content"))


def read_texts(spark: SparkSession, path: str, recursive: bool = False, out: str | None = None) -> DataFrame:
    """``path, seg_id, text, bom, error``: every plain text file as one segment."""
    rows = scan(spark, path, recursive, out).where(F.col("suffix").isin(".txt", ".md"))
    return rows.select("path", F.lit("text").alias("seg_id"), decoded(F.col("content")).alias("d")).select("path", "seg_id", "d.*")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``name, content``, each to a file below ``folder``, by a hidden copy and a rename.

    A task that runs again writes the same file again.  Returns ``name, bytes``.
    """
    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch["name"], batch["content"]):
                if name in ("", ".", "..") or "/" in name or "\\" in name:
                    raise ValueError(f"{name!r} is no plain file name")
                target = os.path.join(folder, name)
                staged = os.path.join(folder, f".{name}.{os.getpid()}.part")
                with open(staged, "wb") as f:
                    f.write(content)
                os.replace(staged, target)
                sizes.append(len(content))
            yield pd.DataFrame({"name": batch["name"], "bytes": sizes})

    return rows.select("name", "content").mapInPandas(run, "name string, bytes long")


def encoded(text: Column, bom: Column) -> Column:
    """UTF-8 bytes; the mark comes back where the input had one."""
    return F.concat(F.when(bom, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.encode(text, "UTF-8"))


def output_name(path: Column, label: str) -> Column:
    """``<stem>.<label><suffix>``"""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(\.[^.]+)$", rf".{label}$1")
