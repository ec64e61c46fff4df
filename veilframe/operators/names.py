"""People named by a known first name, and the trimming of names and companies at stop words.

Every word of a run of capitalised words gets a class, and one pattern over the classes finds
the names: given names and then surnames, or a surname before the given name.  Classes need a
word list of any size, so it is one Arrow-fed function; texts without two capitalised words in
a row never reach it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import words as W
from veilframe.functions.folding import folded
from veilframe.functions.spans import NONE, SPAN
from veilframe.operators.rules import HEURISTIC, LOW, UP
from veilframe.session import ship

_PUNCTUATION = ".,;:'’"
_WORD = rf"[{UP}][{UP}{LOW}'’\-]+"
_PARTICLE = "|".join(sorted(W.PARTICLES, key=lambda w: (-len(w), w)))
# Fixed value: the shape of a run of capitalised words, with particles between them.
RUN = re.compile(rf"(?<!\w){_WORD}(?:[ \t]+(?:(?:{_PARTICLE})[ \t]+)?{_WORD})+")
_NO_LEAD = W.NOT_LEADING | W.NOT_SURNAMES | W.AFTER_NAMES | W.PARTICLES | W.BEFORE_COMPANIES
_STOPS = W.AFTER_NAMES | W.NOT_SURNAMES
# Classes: f first name, g first name behind a particle (a surname there), l may be a surname before its first name,
# s any other word, x a word that ends a name.  A name has at most four words.
_FULL = "[fg](?:[slg]{1,3}|f[slg]{1,2}|ff[slg])"
_NAMES = re.compile(f"(?P<ahead>l(?!{_FULL})[fg]f{{0,3}})|(?P<full>{_FULL})|[fg]f{{0,3}}")


def _found(start: int, text: str, source: str) -> dict:
    return {"start": start, "end": start + len(text), "kind": "PERSON", "text": text, "source": source, "priority": HEURISTIC, "approved": True, "case_sensitive": False, "reason": ""}


class NameReader:
    """Reads names out of texts with one set of folded first names."""

    def __init__(self, first_names: Iterable[str]):
        self.first_names = frozenset(folded(n)[0] for n in first_names)

    def is_first(self, word: str) -> bool:
        return word[:1].isupper() and folded(word.strip(_PUNCTUATION))[0] in self.first_names

    def leads(self, word: str) -> bool:
        """Whether a word may be a surname that stands before the first name."""
        bare = word.strip(_PUNCTUATION)
        return len(bare) >= 3 and bare[0].isupper() and not self.is_first(bare) and bare.lower() not in _NO_LEAD

    def _class(self, word: str, before: str) -> str:
        if word.lower().strip(".,") in _STOPS:
            return "x"
        if self.is_first(word):
            return "g" if before.lower() in W.PARTICLES else "f"
        return "l" if self.leads(word) else "s"

    def read(self, text: str) -> Iterator[dict]:
        for run in RUN.finditer(text):
            words = [m.span() for m in re.finditer(r"\S+", run.group())]
            own = [run.group()[a:b] for a, b in words]
            classes = "".join(map(self._class, own, ["", *own]))
            for name in _NAMES.finditer(classes):
                if name.lastgroup:
                    begin, end = (run.start() + x for x in (words[name.start()][0], words[name.end() - 1][1]))
                    yield _found(begin, text[begin:end], "rules:surname-first" if name.lastgroup == "ahead" else "rules:first-name")


def name_spans(text: Column, first_names: Iterable[str] = W.FIRST_NAMES) -> Column:
    """Spans of people found by a first name; null text gives none."""
    ship(SparkSession.active())
    reader = NameReader(first_names)

    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else list(reader.read(t)) for t in texts])

    likely = text.rlike(rf"[{UP}][{UP}{LOW}'’\-]+[ \t]+(?:\p{{L}}+[ \t]+)?[{UP}][{UP}{LOW}'’\-]")
    return F.when(likely, F.pandas_udf(read, f"array<{SPAN}>")(F.when(likely, text))).otherwise(F.expr(NONE))


def _alternatives(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def trim_company(span: Column) -> Column:
    """Leading stop words go while more than two words are left; other kinds stay as they are."""
    lead = rf"^(?iu:(?:(?:{_alternatives(W.BEFORE_COMPANIES)})\s+(?=\S+\s+\S))+)"
    text = F.regexp_replace(span["text"], lead, "")
    moved = F.length(span["text"]) - F.length(text)
    out = span.withField("text", text).withField("start", (span["start"] + moved).cast("int"))
    return F.when(span["source"] == "rules:company-suffix", out).otherwise(span)


def trim_title_name(span: Column) -> Column:
    """Trailing words that open an address or the like go while a word is left."""
    tail = rf"(?iu:(?:[ \t]+(?:{_alternatives(W.AFTER_NAMES)})[.,]*)+)$"
    text = F.regexp_replace(span["text"], tail, "")
    out = span.withField("text", text).withField("end", (span["start"] + F.length(text)).cast("int"))
    return F.when(span["source"] == "rules:title-name", out).otherwise(span)


def trimmed(spans: Column) -> Column:
    """Spans of rules with stop words at their edges removed."""
    return F.transform(spans, lambda s: trim_title_name(trim_company(s)))
