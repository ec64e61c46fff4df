"""Masked and restored copies of folders, published only once what was written has been checked."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import api
from veilframe.operators.masking import placeholder, references
from veilframe.session import stored
from veilframe.sources.documents import edit_documents, read_documents, read_notes
from veilframe.sources.texts import output_name, scan, write_files


#: What can become of a file, and what each means for the exit code.
STATUSES = {"masked": 0, "dry-run": 0, "skipped": 0, "error": 1, "blocked": 2}


@dataclass
class Published:
    files: DataFrame  # path, status, masked, distinct: counts only, never values
    mapping: DataFrame
    leaks: DataFrame  # name, start, end, text, reason: of the blocked files
    unread: DataFrame  # path, error
    notes: DataFrame  # path, note, count, examples


def summary(files: DataFrame) -> DataFrame:
    """``status, count`` for every status, also those that no file has."""
    known = files.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(files.groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("count"))


def exit_code(files: DataFrame) -> int:
    return max((STATUSES[r["status"]] for r in files.select("status").distinct().collect()), default=0)


def _texts(spark: SparkSession, source: str, recursive: bool, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    rows = stored(read_documents(spark, source, recursive, out), "segments")
    place = F.struct("path", "turn", "seg_id").alias("place")
    return rows.where("error is null").select(place, "text", "column_kind"), rows.where("error is not null").select("path", "error")


def _write(spark: SparkSession, copies: DataFrame, folder: str, label: str) -> DataFrame:
    named = copies.select(output_name(F.col("path"), label).alias("name"), "content")
    clash = named.groupBy("name").count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two files would be written as {clash[0]['name']}")
    return stored(write_files(named, folder), "written")


def _publish(written: DataFrame, staged: str, out: str) -> None:
    for row in written.select("name").toLocalIterator():
        os.replace(os.path.join(staged, row["name"]), os.path.join(out, row["name"]))


def mask_folder(
    spark: SparkSession, source: str, out: str, mapping: DataFrame | None = None, recursive: bool = False, force: bool = False, dry_run: bool = False,
    accepted: DataFrame | None = None, glossary: DataFrame | None = None, allowlist: DataFrame | None = None, exclude: tuple[str, ...] = (),
    before: Callable[[DataFrame], None] | None = None, **options,
) -> Published:
    """Writes a masked copy of every readable file of ``source`` to ``out``, which driver and executors share.

    Copies are staged in a hidden folder of ``out``, read again and searched; a file with a place
    still to be seen is blocked and not published, unless ``force``.  The staging folder goes in
    any case.  ``before`` is given the mapping before the first file is published, to save it;
    ``dry_run`` writes nothing and saves nothing.
    """
    texts, unread = _texts(spark, source, recursive, out)
    masked = api.anonymize(texts, mapping, key="place", exclude=exclude, glossary=glossary, allowlist=allowlist, **options)
    notes = read_notes(spark, source, recursive, out)
    counts = masked.spans.groupBy(F.col("place.path").alias("path")).agg(F.count("*").alias("masked"), F.countDistinct("text").alias("distinct"))
    names = scan(spark, source, recursive, out).select("path", output_name(F.col("path"), "anon").alias("name"), "status")
    status = F.when(F.col("status") == "skipped", "skipped").when(F.col("error").isNotNull(), "error")
    files = names.join(unread, "path", "left").join(counts, "path", "left").select("path", "name", "masked", "distinct", status.alias("failed")).na.fill(0, ["masked", "distinct"])
    if dry_run:
        leaks = spark.createDataFrame([], "name string, start int, end int, text string, reason string")
        return Published(files.select("path", F.coalesce("failed", F.lit("dry-run")).alias("status"), "masked", "distinct"), masked.mapping, leaks, unread, notes)
    values = masked.mapping.select("value", placeholder(F.col("kind"), F.col("number")).alias("to"))
    edits = masked.spans.join(values, F.col("text") == F.col("value")).select("place.path", "place.seg_id", "start", "end", F.col("to").alias("text"))
    staged = os.path.join(out, f".staged-{uuid.uuid4().hex}")
    try:
        os.makedirs(staged)
        written = _write(spark, edit_documents(spark, source, edits, recursive, out), staged, "anon")
        again = stored(_reread(spark, staged), "reread")
        hidden = masked.mapping.where(~F.col("value").isin(*exclude)) if exclude else masked.mapping
        left = api.verify(again, hidden, glossary, allowlist, accepted, key="place", text="text", **{k: v for k, v in options.items() if k in ("rules", "first_names")})
        left = left.where(~F.col("text").isin(*exclude)) if exclude else left
        leaks = stored(left.select(F.element_at(F.split("place.path", "/"), -1).alias("name"), "start", "end", "text", "reason"), "left")
        stopped = leaks.limit(0) if force else leaks
        if before:
            before(masked.mapping)
        _publish(written.join(stopped, "name", "left_anti"), staged, out)
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    blocked = stopped.select("name", F.lit("blocked").alias("blocked")).distinct()
    files = files.join(blocked, "name", "left").select("path", F.coalesce("failed", "blocked", F.lit("masked")).alias("status"), "masked", "distinct")
    return Published(stored(files, "files"), masked.mapping, leaks, unread, notes)


def _reread(spark: SparkSession, staged: str) -> DataFrame:
    """Texts of the staged copies, which a folder scan would pass over as results."""
    rows = read_documents(spark, staged, results=True)
    bad = rows.where("error is not null").limit(1).collect()
    if bad:
        raise RuntimeError(f"{bad[0]['path']} can not be read again: {bad[0]['error']}")
    return rows.select(F.struct("path", "turn", "seg_id").alias("place"), "text")


def restore_folder(spark: SparkSession, source: str, out: str, mapping: DataFrame, recursive: bool = False) -> DataFrame:
    """Writes a copy of every readable file with its placeholders put back; returns ``name, bytes``."""
    rows = read_documents(spark, source, recursive, out, results=True).where("error is null")
    refs = rows.select("path", "seg_id", F.explode(references(F.col("text"))).alias("r")).select("path", "seg_id", "r.*")
    edits = refs.join(mapping.select("kind", "number", "value"), ["kind", "number"]).select("path", "seg_id", "start", "end", F.col("value").alias("text"))
    staged = os.path.join(out, f".staged-{uuid.uuid4().hex}")
    try:
        os.makedirs(staged)
        written = _write(spark, edit_documents(spark, source, edits, recursive, out, results=True), staged, "restored")
        _publish(written, staged, out)
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    return written
