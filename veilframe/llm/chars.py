"""Whole texts as arrays of code points, words and the scripts of words."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.arrays import mix, powers
from veilframe.llm.workers import tidy
from veilframe.session import stored

#: Distinct labels up to which their counts are broadcast.
BROADCAST_VALUES = 100_000

#: Unicode ranges of scripts, first to last code point (fixed values).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: is it a letter, is it part of a word (letter or mark), its script."""
    kinds = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), "S1")
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return kinds == b"L", (kinds == b"L") | (kinds == b"M"), script


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Words:
    """The words of several texts: runs of letters and marks, lower-cased.

    ``codes``: code points of all texts, a 0 after each; ``start``, ``length``, ``row`` of each
    word; ``base``: where each text begins, so offsets within a text are code points.
    """

    def __init__(self, texts: list[str | None]) -> None:
        low = [_lower(t or "") for t in texts]
        self.codes = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
        self.base = np.cumsum(sizes) - sizes
        letter, word, _ = tables()
        self.letter = letter[self.codes]
        inside = word[self.codes]
        step = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            step = np.concatenate([[0], step])
        self.start, self.length = step[::2], step[1::2] - step[::2]
        self.inside = inside
        self.row = np.searchsorted(self.base, self.start, "right") - 1

    def letters(self) -> np.ndarray:
        """Letters of each text."""
        total = np.concatenate([[0], np.cumsum(self.letter)])
        return total[np.append(self.base[1:], len(self.codes))] - total[self.base]

    def hashes(self, size: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``size`` code points (0 where it is shorter)."""
        salt = np.uint64(size or 0) << np.uint64(56)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        if size is None:
            place = np.flatnonzero(self.inside)
            first = np.cumsum(self.length) - self.length
            within = np.arange(len(place)) - np.repeat(first, self.length)
            sums = np.add.reduceat(self.codes[place].astype(np.uint64) * powers(int(self.length.max()))[within], first)
            return mix(sums ^ (self.length.astype(np.uint64) << np.uint64(40)))
        sums = np.zeros(len(self.start), np.uint64)
        p = powers(size)
        for k in range(size):
            sums += self.codes[np.minimum(self.start + k, len(self.codes) - 1)].astype(np.uint64) * p[k]
        return np.where(self.length >= size, mix(sums ^ salt), np.uint64(0))


def text_slices(texts: list[str | None], most: int):
    """Row ranges of about ``most`` characters, or of one text."""
    return _ranges([len(t or "") for t in texts], most)


def _ranges(sizes, most: int):
    i, held = 0, 0
    for j, size in enumerate(sizes):
        if j > i and held + size > most:
            yield i, j
            i, held = j, 0
        held += size
    if len(sizes):
        yield i, len(sizes)


def passing(text: Column, test: Callable[[list[str | None]], np.ndarray], most: int) -> Column:
    """Whether each text passes ``test``, which is given about ``most`` bytes of whole texts at a time.

    Only the texts go to the Python workers and one bit a text comes back.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
            parts = [test(batch.slice(i, j - i).to_pylist()) for i, j in _ranges(sizes, most)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool), pa.bool_())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tidy(run), "boolean")(text.cast("string"))


def remainder(column: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


def bounded_sample(df: DataFrame, by: str, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows of each value of ``by``, chosen by a hash of ``key``; all where there are fewer.

    The share kept is a threshold on 64-bit hashes, so it is never rounded to none.  Counts per
    value are broadcast while they are at most ``BROADCAST_VALUES``, beyond that joined by a
    shuffle.  Two reads of ``df``; the first counts ``by`` alone.
    """
    counts = stored(df.groupBy(F.col(by).alias("_value")).count().select("_value", F.col("count").alias("_rows")), "values")
    joined = df.join(F.broadcast(counts) if counts.count() <= BROADCAST_VALUES else counts, F.col(by).eqNullSafe(F.col("_value")))
    least = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.lit(float(most)) / F.col("_rows")
    return joined.where((F.col("_rows") <= most) | (F.xxhash64(key, F.lit("sample")).cast("double") < least)).select(*df.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, longest: int, unlabelled: bool = False) -> DataFrame:
    """``doc_id, text, <label>`` of about ``most`` texts of each label; texts of over ``longest`` characters are not drawn.

    Labels are sampled before they meet the texts, so no text is shuffled while the sample is
    small enough for a broadcast by Spark's own rule.  With ``unlabelled`` those without
    a label among about ``2 * most`` documents of all follow, marked -1.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= longest))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias(label))
    out = texts.join(stored(bounded_sample(known, label, most), "labels"), "doc_id").select("doc_id", "text", label)
    if unlabelled:
        rows = docs.count()
        share = F.xxhash64("doc_id", F.lit("free")).cast("double") < -(2.0**63) + 2.0**64 * min(1.0, 2.0 * most / max(1, rows))
        few = stored(texts.where(share & F.col("doc_id").isNotNull()), "free").join(known.select("doc_id"), "doc_id", "left_anti")
        out = out.unionByName(few.select("doc_id", "text", F.lit(-1).alias(label)))
    return out
