"""Spans of matches, found and spliced natively.

Regular-expression functions return strings, not offsets; the gaps that ``split`` leaves
and the matches of ``regexp_extract_all`` come in the same order, so running lengths of both
give each match's place in code points.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilframe.session import SMALL_BATCH, by_batch, ship

SPAN = "struct<start:int,end:int,kind:string,text:string,source:string,priority:int,approved:boolean,case_sensitive:boolean,reason:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def span(start: Column, value: Column, kind: Column | str, source: str, priority: int, case_sensitive: Column | bool = False, reason: Column | str = "") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), as_column(kind).alias("kind"), value.alias("text"), F.lit(source).alias("source"),
        F.lit(priority).alias("priority"), F.lit(True).alias("approved"), as_column(case_sensitive).alias("case_sensitive"), as_column(reason).alias("reason"),
    ).cast(SPAN)


_LOOK_BEHIND = re.compile(r"(\(\?<[!=][^()]*\))?")


def occurrence(prefix: str, value: str, follows: str = "", consumed: str = "") -> str:
    """The pattern of ``value`` after ``prefix``."""
    return f"({prefix})(?=({value}){follows}){consumed}" if consumed else f"({prefix})({value}){follows}"


def matches(text: Column, prefix: str, value: str, follows: str = "", consumed: str = "") -> Column:
    """``array<struct<start, text>>`` of ``value`` after ``prefix``; matches are never empty.

    With ``consumed`` a match uses up only that much of its value and the search goes on behind
    it.  Each pass over the text is an argument of its own, outside any lambda, so it is made
    once however many matches there are.
    """
    pattern = F.lit(occurrence(prefix, value, follows, consumed))
    bare = bool(_LOOK_BEHIND.fullmatch(prefix))  # nothing lies between the gap and the value
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    item = whole if bare and not consumed else F.regexp_extract_all(text, pattern, F.lit(2))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    columns = [whole, gaps] if item is whole else [whole, gaps, item]
    if not bare:
        columns.append(F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.length))
    parts = F.filter(F.arrays_zip(*columns), lambda p: p["0"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,text:string>>)").alias("out"))
    lead = (lambda p: F.lit(0)) if bare else (lambda p: p[str(len(columns) - 1)])
    own = "0" if item is whole else "2"
    return F.aggregate(
        parts, start,
        lambda acc, p: F.struct((acc["at"] + p["1"] + F.length(p["0"])).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + p["1"] + lead(p)).cast("int").alias("start"), p[own].alias("text"))).alias("out")),
        lambda acc: acc["out"],
    )


def spliced(text: str, edits: list[tuple[int, int, str]]) -> str:
    """``text`` with each edit (start, end, text) put in place; edits that overlap are refused."""
    out, at = [], 0
    for start, end, new in sorted(edits):
        if start < at:
            raise ValueError(f"edits overlap at {start}")
        out += (text[at:start], new)
        at = end
    return "".join([*out, text[at:]])


def _splice(texts: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or e is None else spliced(t, [(x["start"], x["end"], x["text"]) for x in e]) for t, e in zip(texts, edits)])


def splice(text: Column, edits: Column) -> Column:
    """``text`` with each of ``edits`` (start, end, text) put in place, in one pass; overlapping edits fail the query.

    Only texts with edits travel to a worker.
    """
    ship(SparkSession.active(), SMALL_BATCH)
    some = F.size(edits) > 0
    return F.when(some, by_batch(_splice, "string")(F.when(some, text), F.when(some, edits))).otherwise(text)


#: Accented letters of Latin scripts with one base letter, by Unicode's own decompositions.
_ACCENTED = {c: b for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(b := "".join(d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn")) == 1 and b != c}


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters; one character stays one character."""
    return F.translate(F.lower(text), "".join(_ACCENTED), "".join(_ACCENTED.values()))


def without(spans: Column, others: Column) -> Column:
    """``spans`` but for those whose place one of ``others`` has; places are listed once."""
    key = lambda s: F.concat_ws(":", s["start"], s["end"])
    listed = F.array(F.struct(F.transform(others, key).alias("places")))
    return F.get(F.transform(listed, lambda o: F.filter(spans, lambda s: ~F.array_contains(o["places"], key(s)))), F.lit(0))
