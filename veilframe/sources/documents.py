"""Files of any kind that is read, as rows of segments, and their edited copies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.spans import spliced
from veilframe.session import ship
from veilframe.sources.office import Package, PackageError
from veilframe.sources.texts import decode, scan

SEGMENTS = "path string, turn int, seg_id string, text string, column_kind string, error string"
NOTES = "path string, note string, count int, examples string"
EDITS = "array<struct<seg_id:string,start:int,end:int,text:string>>"


def segments(content: bytes, suffix: str) -> list[tuple[str, str, str | None]]:
    """``(seg_id, text, column_kind)`` in order; a plain text is one segment."""
    if suffix in (".docx", ".xlsx"):
        return [(s.name, s.text, s.column_kind) for s in Package(suffix, content).segments]
    found = decode(content)
    if found["error"]:
        raise PackageError(found["error"])
    return [("text", found["text"], None)]


def edited(content: bytes, suffix: str, edits: dict[str, list[tuple[int, int, str]]]) -> bytes:
    """The file with its segments edited; a text is written as UTF-8 and keeps its mark."""
    if suffix in (".docx", ".xlsx"):
        return Package(suffix, content).written(edits)
    found = decode(content)
    return spliced(found["text"], edits.get("text", [])).encode("utf-8-sig" if found["bom"] else "utf-8")


def read_documents(spark: SparkSession, path: str, recursive: bool = False, out: str | None = None, results: bool = False) -> DataFrame:
    """``path, turn, seg_id, text, column_kind, error`` of all files that can be read.

    A file that can not be read is one row with ``error``; an empty one has no rows.
    """

    def run(batches) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, suffix, content in zip(batch["path"], batch["suffix"], batch["content"]):
                try:
                    rows = [(at, i, name, text, kind, None) for i, (name, text, kind) in enumerate(segments(bytes(content), suffix))]
                except PackageError as e:
                    rows = [(at, 0, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "turn", "seg_id", "text", "column_kind", "error"])

    ship(spark)
    return _ready(spark, path, recursive, out, results).mapInPandas(run, SEGMENTS)


def read_notes(spark: SparkSession, path: str, recursive: bool = False, out: str | None = None, results: bool = False) -> DataFrame:
    """``path, note, count, examples``: what packages hold that is not searched, and bare numbers that may name people."""

    def run(batches) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, suffix, content in zip(batch["path"], batch["suffix"], batch["content"]):
                try:
                    notes = Package(suffix, bytes(content)).notes
                except PackageError:
                    notes = []
                yield pd.DataFrame([(at, *n) for n in notes], columns=["path", "note", "count", "examples"])

    ship(spark)
    return _ready(spark, path, recursive, out, results).where(F.col("suffix").isin(".docx", ".xlsx")).mapInPandas(run, NOTES)


def edit_documents(spark: SparkSession, path: str, edits: DataFrame, recursive: bool = False, out: str | None = None, results: bool = False) -> DataFrame:
    """``path, content``: every readable file, with ``edits(path, seg_id, start, end, text)`` made.

    The edits of a file are gathered to it, as it is written whole.
    """

    def run(batches) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, suffix, content, made in zip(batch["path"], batch["suffix"], batch["content"], batch["edits"]):
                per: dict[str, list[tuple[int, int, str]]] = {}
                for e in made if made is not None else []:
                    per.setdefault(e["seg_id"], []).append((e["start"], e["end"], e["text"]))
                try:
                    yield pd.DataFrame({"path": [at], "content": [edited(bytes(content), suffix, per)]})
                except PackageError:
                    if per:
                        raise

    ship(spark)
    per = edits.groupBy("path").agg(F.collect_list(F.struct("seg_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text")).cast(EDITS).alias("edits"))
    return _ready(spark, path, recursive, out, results).join(per, "path", "left").select("path", "suffix", "content", "edits").mapInPandas(run, "path string, content binary")


def _ready(spark: SparkSession, path: str, recursive: bool, out: str | None, results: bool) -> DataFrame:
    return scan(spark, path, recursive, out, results).where(F.col("status") == "ready").select("path", "suffix", "content")
