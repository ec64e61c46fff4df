"""Numbering, masking, restoring and verifying as joins and windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.spans import fold, matches, splice
from veilframe.functions.words import TITLES
from veilframe.operators.rules import KINDS, RULES, Rule, detect
from veilframe.session import SMALL_BATCH, ship, spread, stored

MAPPING = "kind string, number bigint, value string, case_sensitive boolean"


#: A number of its own for every row.  Users' keys may be null or repeat, so nothing is ever joined back by them.
ROW = "_veilframe_row"


def rows_of(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW``, written out, so that a row keeps its number however often it is read."""
    ship(docs.sparkSession, SMALL_BATCH)
    return docs if ROW in docs.columns else stored(spread(docs).withColumn(ROW, F.monotonically_increasing_id()), "rows")


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    return docs.withColumn("spans", detect(F.col(text), rules))


def spans_of(found: DataFrame, *keys: str) -> DataFrame:
    """One row per approved span.

    A plain ``explode`` would have the optimizer look for empty arrays first, which finds all spans twice more.
    """
    keys = keys or ("doc_id",)
    return found.select(*keys, F.explode_outer("spans").alias("s")).select(*keys, "s.*").where("approved")


def drop_allowed(spans: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Spans whose folded text is not on the list ``allowlist(value)``."""
    keys = allowlist.select(fold(F.trim("value")).alias("_key")).distinct()
    return spans.join(keys, fold(F.trim("text")) == F.col("_key"), "left_anti")


def number(spans: DataFrame, mapping: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The mapping with every new value numbered within its kind, in order of first appearance.

    A value keeps its first kind; numbers go on from the largest stored one.  Values are laid
    out by ranges of (kind, first place) and numbered within their range; only the counts per
    range are summed up, so a kind with very many values is still numbered by many tasks.
    """
    first = spans.groupBy(F.col("text").alias("value")).agg(F.min(F.struct(key, "start", "kind", "case_sensitive")).alias("f"))
    fresh = first.select("value", F.col("f.kind").alias("kind"), F.col("f.case_sensitive").alias("case_sensitive"), F.col(f"f.{key}").alias("_doc"), F.col("f.start").alias("_start"))
    if mapping is not None:
        fresh = fresh.join(mapping.select("value"), "value", "left_anti")
    laid = stored(fresh.repartitionByRange("kind", "_doc", "_start").withColumn("_part", F.spark_partition_id()), "values")
    before = Window.partitionBy("kind").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = laid.groupBy("kind", "_part").count().select("kind", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("kind", "_part").orderBy("_doc", "_start"))
    out = laid.join(base, ["kind", "_part"]).withColumn("number", within.cast("bigint") + F.col("_base"))
    columns = ["kind", "number", "value", "case_sensitive"]
    if mapping is None:
        return out.select(*columns)
    top = mapping.groupBy("kind").agg(F.max("number").alias("top"))  # a row per kind
    out = out.join(F.broadcast(top), "kind", "left").withColumn("number", F.col("number") + F.coalesce("top", F.lit(0)))
    return mapping.select(*columns).unionByName(out.select(*columns))


def placeholder(kind: Column, number_: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("_"), number_.cast("string"), F.lit("]"))


def apply(found: DataFrame, mapping: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, masked``: every approved span of ``found(key, text, spans)`` replaced by its placeholder.

    Rows are told apart by ``ROW``: null, repeated and clashing keys are masked each by its own
    spans.  Spans meet the mapping by value; a value that very many spans share is split by
    Spark's skew join.
    """
    found = rows_of(found.select(*([ROW] if ROW in found.columns else []), key, text, "spans"))
    named = spans_of(found, ROW).select(ROW, "start", "end", F.col("text").alias("value")).join(mapping.select("value", "kind", "number"), "value")
    edits = named.groupBy(ROW).agg(F.collect_list(F.struct("start", "end", placeholder(F.col("kind"), F.col("number")).alias("text"))).alias("edits"))
    return found.join(edits, ROW, "left").select(key, splice(F.col(text), F.col("edits")).alias("masked"))


# Brackets that a placeholder may have been rewritten with, and what may part its kind from its number.
OPENING, CLOSING, PARTED = "[({<【", "])}>】", r"(?:\\?_|[ \t\-]+)"
_KIND = "|".join(KINDS)
#: Bracketed in any case, each bracket perhaps escaped; or bare, as written, and no part of a longer word.
_TOKEN = rf"(?iu:\\?[{re.escape(OPENING)}](?:{_KIND}){PARTED}\d+\\?[{re.escape(CLOSING)}])|(?<![A-Za-z0-9])(?:{_KIND})_\d+(?![\p{{L}}\p{{N}}_])"


def references(text: Column) -> Column:
    """Placeholder-looking tokens: ``array<struct<start, end, raw, kind, number, exact>>``.

    A bracket on one side only is no part of the token.
    """

    def read(m: Column) -> Column:
        raw = m["text"]
        kind, digits = F.upper(F.regexp_extract(raw, "[A-Za-z]+", 0)), F.regexp_extract(raw, r"\d+", 0).cast("bigint")
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(raw)).cast("int").alias("end"), raw.alias("raw"), kind.alias("kind"), digits.alias("number"), (raw == placeholder(kind, digits)).alias("exact"))

    return F.when(text.rlike(rf"(?iu)(?:{_KIND})\\?[_ \t\-]"), F.transform(matches(text, "", _TOKEN), read))


def restore(docs: DataFrame, mapping: DataFrame, key: str = "doc_id", text: str = "masked") -> DataFrame:
    """``key, restored, found, altered, invented``: placeholders put back by (kind, number)."""
    rows = rows_of(docs.select(*([ROW] if ROW in docs.columns else []), key, text))
    refs = rows.select(ROW, F.explode_outer(references(F.col(text))).alias("r")).where("r is not null").select(ROW, "r.*")
    known = refs.join(mapping.select("kind", "number", "value"), ["kind", "number"], "left")
    hit = F.col("value").isNotNull()
    canonical = placeholder(F.col("kind"), F.col("number"))
    per = known.groupBy(ROW).agg(
        F.collect_list(F.when(hit, F.struct("start", "end", F.col("value").alias("text")))).alias("edits"),
        F.array_sort(F.collect_list(F.when(hit, canonical))).alias("found"),
        F.array_sort(F.collect_list(F.when(hit & ~F.col("exact"), F.struct(F.col("raw"), canonical.alias("canonical"))))).alias("altered"),
        F.array_sort(F.collect_list(F.when(~hit, F.col("raw")))).alias("invented"),
    )
    return rows.join(per, ROW, "left").select(key, splice(F.col(text), F.col("edits")).alias("restored"), "found", "altered", "invented")


def placeholders_in(text: Column) -> Column:
    """The distinct placeholders of a text in their written form, in order of appearance."""
    return F.array_distinct(F.transform(references(text), lambda r: placeholder(r["kind"], r["number"])))


def totals(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, masked, distinct``: approved spans and different values of every row of ``found(key, spans)``."""
    values = F.transform(F.filter("spans", lambda s: s["approved"]), lambda s: s["text"])
    return found.select(key, F.size(values).alias("masked"), F.size(F.array_distinct(values)).alias("distinct"))


def missing(expected: Column, found: Column) -> Column:
    """Placeholders that were sent and did not come back, in order."""
    return F.array_sort(F.array_except(expected, found))


def leaks(masked: DataFrame, accepted: DataFrame | None = None, key: str = "doc_id", text: str = "masked") -> DataFrame:
    """What the rules still find in text about to be shared: first reason per place."""
    rows = rows_of(masked.select(*([ROW] if ROW in masked.columns else []), key, text))
    spans = spans_of(find(rows, text=text), ROW, key)
    seen = spans.select(ROW, key, "start", "end", "text", F.concat(F.lit("detected "), "kind", F.lit(" ("), "source", F.lit(")")).alias("reason"))
    if accepted is not None:
        seen = drop_allowed(seen, accepted)
    return seen.groupBy(ROW, key, "start", "end", "text").agg(F.min("reason").alias("reason")).drop(ROW)


def header_kind(label: Column) -> Column:
    """Kind of the values under a column title, null if the title is not a known one."""
    flat = F.trim(F.regexp_replace(fold(label), "[^a-z0-9]+", " "))
    out = F.lit(None).cast("string")
    for kind, names in TITLES.items():
        out = F.when(flat.rlike(f"^(?:{names})$"), F.lit(kind)).otherwise(out)
    return out


def review_groups(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct (kind, text) with count, sources and the first two contexts."""
    spot = lambda s: F.concat(
        F.lit("…"), F.replace(F.substr("text", F.greatest(s["start"] - 31, F.lit(1)), F.least(s["start"], F.lit(32))), F.lit("\n"), F.lit(" ")), F.lit("«"), s["text"], F.lit("»"),
        F.replace(F.substr("text", s["end"] + 1, F.lit(32)), F.lit("\n"), F.lit(" ")), F.lit("…"),
    )
    cut = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text"), s["start"].alias("start"), s["source"].alias("source"), spot(s).alias("context")))
    rows = found.select(key, F.explode(cut).alias("s")).select(key, "s.*")  # only the surroundings travel
    counts = rows.groupBy("kind", "text").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("source")).alias("sources"))
    w = Window.partitionBy("kind", "text").orderBy(key, "start", "context")
    first = rows.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy("kind", "text").agg(F.array_sort(F.collect_list(F.struct("n", "context"))).alias("c"))
    return counts.join(first, ["kind", "text"]).select("kind", "text", "count", "sources", F.transform("c", lambda x: x["context"]).alias("contexts"))
