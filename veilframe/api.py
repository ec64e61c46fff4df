"""Masking, restoring and checking of whole sets of texts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import words as W
from veilframe.functions.spans import NONE, fold
from veilframe.operators import lookup, masking
from veilframe.operators.masking import ROW
from veilframe.operators.names import name_spans, trimmed
from veilframe.operators.resolve import resolve
from veilframe.operators.rules import RULES, Rule, detect
from veilframe.session import stored


@dataclass
class Masked:
    texts: DataFrame  # key, masked
    mapping: DataFrame  # kind, number, value, case_sensitive
    spans: DataFrame  # key and the fields of a span


def _kept(found: DataFrame, allowlist: DataFrame | None) -> DataFrame:
    """``found`` without the spans whose folded text is on the list."""
    if allowlist is None:
        return found
    rows = masking.drop_allowed(found.select(ROW, F.posexplode("spans").alias("_i", "s")).select(ROW, "_i", "s.*"), allowlist)
    fields = [f for f in rows.columns if f not in (ROW, "_i")]
    again = rows.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("_i", F.struct(*fields).alias("s")))).alias("_s"))
    joined = found.drop("spans").join(again, ROW, "left")
    return joined.withColumn("spans", F.coalesce(F.transform("_s", lambda x: x["s"]), F.expr(NONE))).drop("_s")


def analyze(
    docs: DataFrame, mapping: DataFrame | None = None, glossary: DataFrame | None = None, allowlist: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
    first_names: Iterable[str] | None = W.FIRST_NAMES, propagate: bool = True, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` with ``spans``: disjoint spans in order, each text searched for what any text has shown.

    An optional column ``column_kind`` names the kind of a whole cell.  Keys may be null or
    repeat.  Detection is written out once: everything after reads it three times.
    """
    return _analyze(masking.rows_of(docs), mapping, glossary, allowlist, rules, first_names, propagate, key, text).drop(ROW)


def _analyze(
    docs: DataFrame, mapping: DataFrame | None = None, glossary: DataFrame | None = None, allowlist: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
    first_names: Iterable[str] | None = W.FIRST_NAMES, propagate: bool = True, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    parts = [trimmed(detect(F.col(text), rules))]
    if first_names is not None:
        parts.append(name_spans(F.col(text), first_names))
    if "column_kind" in docs.columns:
        parts.insert(0, lookup.column_spans(F.col(text), F.col("column_kind")))
    found = docs.withColumn("spans", F.coalesce(F.concat(*parts), F.expr(NONE)))
    if glossary is not None:
        found = lookup.add_found(found, lookup.occurrences(docs, lookup.glossary_needles(glossary), ROW, text), ROW)
    found = _kept(found, allowlist)
    if propagate:
        found = stored(found, "found")
        own = masking.spans_of(found, key)
        needles = lookup.union([lookup.known_needles(own, mapping, key), lookup.alias_needles(own)])
        found = _kept(lookup.add_found(found, lookup.occurrences(docs, needles, ROW, text), ROW), allowlist)
    return found.withColumn("spans", resolve(F.col(text), F.col("spans")))


def anonymize(docs: DataFrame, mapping: DataFrame | None = None, key: str = "doc_id", text: str = "text", exclude: Iterable[str] = (), **options) -> Masked:
    """Masks every text; values new to ``mapping`` are numbered on from it.  ``exclude`` stays as it is."""
    found = stored(_analyze(masking.rows_of(docs), mapping, key=key, text=text, **options), "spans")
    left = list(exclude)
    if left:
        found = found.withColumn("spans", F.filter("spans", lambda s: ~s["text"].isin(left)))
    spans = masking.spans_of(found, key)
    grown = stored(masking.number(spans, mapping, key), "mapping")
    return Masked(masking.apply(found, grown, key, text), grown, spans)


def restore(docs: DataFrame, mapping: DataFrame, key: str = "doc_id", text: str = "masked") -> DataFrame:
    return masking.restore(docs, mapping, key, text)


def verify(
    masked: DataFrame, mapping: DataFrame | None = None, glossary: DataFrame | None = None, allowlist: DataFrame | None = None, accepted: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES, first_names: Iterable[str] | None = W.FIRST_NAMES, key: str = "doc_id", text: str = "masked",
) -> DataFrame:
    """``key, start, end, text, reason`` of what is still to be seen, one reason a place.

    Stored values come first, then glossary terms, then rules.
    """
    masked = masking.rows_of(masked)
    body = F.col(text)
    parts = [trimmed(detect(body, rules))] + ([name_spans(body, first_names)] if first_names is not None else [])
    found = masked.select(ROW, F.explode(F.concat(*parts)).alias("s")).select(ROW, "s.*")
    rows = [found.select(ROW, "start", "end", "text", F.lit(2).alias("_turn"), F.concat(F.lit("detected "), "kind", F.lit(" ("), "source", F.lit(")")).alias("reason"))]
    named = []
    if mapping is not None:
        name = F.concat(F.lit("known value "), masking.placeholder(F.col("kind"), F.col("number")))
        named.append(mapping.select("value", "kind", name.alias("source"), F.lit(1).alias("priority"), "case_sensitive"))
    if glossary is not None:
        named.append(lookup.glossary_needles(glossary.withColumn("kind", F.lit(""))).join(_terms(glossary), "value").select("value", "kind", F.col("_term").alias("source"), F.lit(0).alias("priority"), "case_sensitive"))
    if named:
        hits = lookup.occurrences(masked, lookup.union(named), ROW, text).select(ROW, F.explode("found").alias("s")).select(ROW, "s.*")
        rows.append(hits.select(ROW, "start", "end", "text", (1 - F.col("priority")).alias("_turn"), F.col("source").alias("reason")))
    out = lookup.union(rows)
    for skipped in (allowlist, accepted):
        if skipped is not None:
            out = masking.drop_allowed(out, skipped)
    one = out.groupBy(ROW, "start", "end").agg(F.min(F.struct("_turn", "reason", "text")).alias("f"))
    return masked.select(ROW, key).join(one, ROW).select(key, "start", "end", "f.text", "f.reason")


def _terms(glossary: DataFrame) -> DataFrame:
    forms = F.concat(F.array("term"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))
    rows = glossary.select("term", F.explode(forms).alias("value"))
    return rows.groupBy("value").agg(F.concat(F.lit("glossary: "), F.min("term")).alias("_term"))


def upsert_term(glossary: DataFrame, added: DataFrame) -> DataFrame:
    """Terms with the same folded form become one: the newest kind, all aliases in order."""
    rows = glossary.withColumn("_turn", F.lit(0)).unionByName(added.withColumn("_turn", F.lit(1))).withColumn("_key", fold(F.trim("term")))
    one = rows.groupBy("_key").agg(F.max(F.struct("_turn", "term", "kind")).alias("l"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    return one.select("l.term", "l.kind", "aliases")


def remove_term(glossary: DataFrame, term: str) -> DataFrame:
    """The glossary without a term, compared folded; a term that is not there is an error."""
    mine = fold(F.trim("term")) == fold(F.lit(term.strip()))
    if not glossary.where(mine).limit(1).count():
        raise KeyError(term)
    return glossary.where(~mine)


def allow(allowlist: DataFrame, value: str) -> DataFrame:
    """The list with a value, unless it or one that folds alike is on it."""
    if is_allowed(allowlist, value):
        return allowlist
    return allowlist.unionByName(allowlist.sparkSession.createDataFrame([(value.strip(),)], "value string"))


def disallow(allowlist: DataFrame, value: str) -> DataFrame:
    if not is_allowed(allowlist, value):
        raise KeyError(value)
    return allowlist.where(fold(F.trim("value")) != fold(F.lit(value.strip())))


def is_allowed(allowlist: DataFrame, value: str) -> bool:
    return allowlist.where(fold(F.trim("value")) == fold(F.lit(value.strip()))).limit(1).count() > 0


def anonymize_text(spark: SparkSession, text: str, mapping: DataFrame | None = None, **options) -> tuple[str, DataFrame]:
    """One text masked, and the mapping grown by it."""
    got = anonymize(spark.createDataFrame([("text", text)], "doc_id string, text string"), mapping, **options)
    return got.texts.first()["masked"], got.mapping


def restore_text(spark: SparkSession, text: str, mapping: DataFrame) -> str:
    return restore(spark.createDataFrame([("text", text)], "doc_id string, masked string"), mapping).first()["restored"]
