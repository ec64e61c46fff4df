"""Legacy ARC archives to WARC.

An ARC file begins with a version block whose own lines name the fields of each record's
header line: five in version 1, ten in version 2.  The converter parses header lines by the
file's version, reads as many bytes as they declare, and writes equivalent WARC records: the
identifier is a name-based UUID of file and record, the timestamp comes from the archive
date, the type is ``response`` or, for a payload already kept elsewhere, ``revisit``, and
payload digests are SHA-1.  Of equal payloads of at least ``least`` bytes the record with the
largest page id is the response (of equal ids, the last in file order).  Records are gzip
members of their own, so a file can be entered at any record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import files
from veilframe.session import fresh_path, ship, stored

FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Bytes of records after which an archive file is closed.
ROTATE = 16 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def arc_head(name: str, version: str) -> bytes:
    body = f"{version} 0 veilframe\n{FIELDS[version]}\n\n".encode()
    rest = " - - 0" + f" {name}" if version == "2" else ""
    first = f"filedesc://{name} 0.0.0.0 20000101000000 text/plain" + (" 200" + rest if version == "2" else "")
    return f"{first} {len(body)}\n".encode() + body


def arc_record(url: str, date: str, body: bytes, version: str, offset: int, name: str) -> bytes:
    url = _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-"
    head = [url, "0.0.0.0", date, "text/html"] + ([] if version == "1" else ["200", "-", "-", str(offset), name])
    return " ".join([*head, str(len(body))]).encode("utf-8", "replace") + b"\n" + body + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, gzipped or plain; fields by name, ``body`` as declared."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    fields: list[str] = []
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.rstrip(b"\r\n").decode("utf-8").split(" ")
        body = stream.read(int(parts[-1]))
        if len(body) != int(parts[-1]):
            raise ValueError("an ARC record is shorter than declared")
        if parts[0].startswith("filedesc://"):
            version, names = body.decode().split("\n")[:2]
            if FIELDS.get(version.split(" ")[0]) is None:
                raise ValueError(f"ARC version {version!r}")
            fields = names.split(" ")
            continue
        if len(parts) != len(fields):
            raise ValueError(f"a header line of {len(parts)} fields; the file has {len(fields)}")
        yield dict(zip(fields, parts)) | {"body": body}


def split_http(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, header block and payload of an HTTP response."""
    head, _, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + b"\r\n\r\n", payload


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while line := stream.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip().lower()] = v.strip()
        yield headers, stream.read(int(headers["content-length"]))


def record_id(file: str, ordinal: int) -> str:
    """Identifier of a record by its file's own name and its place there, wherever the file lies."""
    file = file.rpartition("/")[2]
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{ordinal}')}>"


def write_arc(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """ARC files of ``pages(page_id, url, html)``, of both versions; returns their ``file`` names."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "arc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, number, held, at, out = TaskContext.get().partitionId(), 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            files.put(f"{folder}/{name}", b"".join(out))
            return pa.record_batch({"file": [f"{folder}/{name}"]})

        for batch in batches:
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html"))):
                if not out:
                    version = "12"[(pid + number) % 2]
                    name = f"{pid:06d}-{number:05d}.arc.gz"
                    out.append(_member(arc_head(name, version)))
                    at = len(out[-1])
                payload = (html or "").encode("utf-8")
                own = "" if page is None else f"X-Page-Id: {page}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                out.append(_member(arc_record(url or "-", "20000101000000", body, version, at, name)))
                held += len(body)
                at += len(out[-1])
                if held >= ROTATE:
                    yield flush()
                    number, held, out = number + 1, 0, []
        if out:
            yield flush()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return stored(rows.mapInArrow(run, "file string"), "arc-files")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("file").to_pylist():
            rows = []
            for k, record in enumerate(read_arc(files.get(path))):
                http, _, payload = split_http(record["body"])
                page = http.get("x-page-id")
                rows.append((path, k, None if page is None else int(page), len(payload), hashlib.sha1(payload).hexdigest()))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["file", "ordinal", "page_id", "size", "digest"])


def _convert(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, name, source, out, done = None, "", None, [], []

        def flush() -> None:
            info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(current, -1)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: veilframe\r\nformat: WARC File Format 1.1\r\n")
            files.put(f"{folder}/{name}", b"".join([_member(info), *out]))
            done.append(f"{folder}/{name}")

        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != current:
                    if current is not None:
                        flush()
                    current, source, out = row["file"], enumerate(read_arc(files.get(row["file"]))), []
                    name = current.rpartition("/")[2].replace(".arc.", ".warc.")
                k, record = next(source)
                if k != row["ordinal"]:
                    raise ValueError("records of an ARC file are missing")
                _, head, payload = split_http(record["body"])
                d = record["Archive-date"]
                digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
                headers = [
                    ("WARC-Type", "revisit" if row["revisit"] else "response"),
                    ("WARC-Record-ID", record_id(current, k)),
                    ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
                    ("WARC-Target-URI", record["URL"]),
                    ("WARC-IP-Address", record["IP-address"]),
                    ("WARC-Payload-Digest", digest),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                if row["revisit"]:
                    headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(row["to_file"], row["to_ordinal"]))]
                    if row["refers_to"] is not None:
                        headers.append(("WARC-Refers-To-Page", str(row["refers_to"])))
                out.append(_member(warc_record(headers, head if row["revisit"] else head + payload)))
        if current is not None:
            flush()
        if done:
            yield pa.record_batch({"file": done})

    return run


def convert(arcs: DataFrame, least: int = 1000, folder: str | None = None) -> DataFrame:
    """WARC files of the ARC files in ``arcs(file)``; returns their ``file`` names.

    Shuffles a digest row per record; payloads stay in the files.  Equal payloads are found by
    a pre-aggregated maximum per digest, so a payload with very many copies costs a row per task.
    """
    spark = arcs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "warc")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(arcs.repartition(n).mapInArrow(_scan, "file string, ordinal int, page_id long, size long, digest string"), "records")
    best = found.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max(F.struct("page_id", "file", "ordinal")).alias("best"))
    rows = found.join(best, ["digest", "size"], "left")
    other = F.coalesce((F.col("best.file") != F.col("file")) | (F.col("best.ordinal") != F.col("ordinal")), F.lit(False))
    rows = rows.select("file", "ordinal", "digest", other.alias("revisit"), F.col("best.file").alias("to_file"), F.col("best.ordinal").alias("to_ordinal"), F.col("best.page_id").alias("refers_to"))
    rows = rows.repartition(n, "file").sortWithinPartitions("file", "ordinal")
    return stored(rows.mapInArrow(_convert(folder), "file string"), "warc-files")


def read_pages(warcs: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page record.

    A response's size and digest are taken from its payload and must agree with its headers;
    a revisit states those of the payload that it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                rows = []
                for headers, block in read_warc(files.get(path)):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = split_http(block)
                    size, digest = int(http["content-length"]), base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                        raise ValueError("a payload differs from its headers")
                    page, to = http.get("x-page-id"), headers.get("warc-refers-to-page")
                    rows.append((None if page is None else int(page), size, digest, kind, None if to is None else int(to)))
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = int(warcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return warcs.repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
