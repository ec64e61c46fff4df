"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are runs of letters, marks and digits, lower-cased.  A mask selects some of the words
in a window and ignores the others; windows of documents and benchmark items whose selected
words hash alike are a hit, so a hit survives substitutions at the ignored places, and each
mask ignores others.  Around every hit the item is laid over the document and words are
compared place by place.  An item leaks into a document if at least ``percent`` % of its
words are found in place, over all its hits together (insertions only shift the later part),
or, whatever its length, if a passage has ``STRETCH`` words in place with at most ``SWAPPED``
others among them; the masks hit every such passage.
Items shorter than the longest mask have masks of their own (``short_masks``), which hit
wherever any one word is replaced; items of fewer than 5 words must occur whole.

Items without words and documents without words never match.  Rows with equal ``doc_id``
and text count once.  Other columns are ignored.  Item seeds are broadcast while they are
at most ``BROADCAST_SEEDS`` and items while they have at most ``BROADCAST_WORDS`` words;
beyond that both come from shuffle joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.naming import unused

#: All masks select the words 0, 3 and 4; windows whose three don't occur so in any item are left early.
MASKS = ("110110011", "1011100101", "10011010011")
CORE = (0, 3, 4)
BROADCAST_SEEDS, BROADCAST_WORDS = 1_000_000, 5_000_000
STRETCH, SWAPPED = 13, 2


def short_masks(n: int) -> tuple[str, ...]:
    """Masks of items of ``n`` words, fewer than the longest mask: those that fit, and some over the whole item.

    Each selects at least 4 words; of two replaced words some places are missed.
    """
    if n < 5:
        return ("1" * n,)
    step = 3 if n >= 9 else 4 if n >= 6 else 5
    return (*(m for m in MASKS if len(m) <= n), *("".join("01"[k % step != r] for k in range(n)) for r in range(step)))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def _windows(df: DataFrame, array: str, pos: str) -> DataFrame:
    size = F.size(array)
    return df.select("*", F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias(pos))


def _seeds(rows: DataFrame, array: str, masks: tuple[str, ...], pos: str) -> DataFrame:
    """A row per window and mask."""
    at = F.col(pos)
    each = [
        F.when(at + len(m) <= F.size(array), F.xxhash64(F.lit(k), *(F.get(array, at + i) for i, c in enumerate(m) if c == "1")))
        for k, m in enumerate(masks)
    ]
    return rows.select("*", F.explode(F.array(*each)).alias("seed"))


def _core(array: str, pos: str) -> Column:
    return F.xxhash64(*(F.get(array, F.col(pos) + k) for k in CORE))


def _hits(rows: DataFrame, items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Windows of ``rows(doc_id, text_hash, words)`` and ``items(key, item_id, item)`` that share a seed.

    Only seeds travel to all windows; items are fetched for the hits.
    """
    own = _windows(items, "item", "at")
    seeds = _seeds(own, "item", masks, "at").where("seed IS NOT NULL").select("key", "at", "seed")
    held = items.agg(F.sum(F.size("item"))).first()[0] or 0
    bodies = F.broadcast(items) if held <= BROADCAST_WORDS else items
    windows = _windows(rows, "words", "pos")
    if masks == MASKS:
        core = own.where(F.col("at") + min(map(len, MASKS)) <= F.size("item")).select(_core("item", "at").alias("core")).distinct()
    if seeds.count() > BROADCAST_SEEDS:
        found = _seeds(windows, "words", masks, "pos").drop("words").join(seeds, "seed")
        texts = rows.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "words")
        return found.join(texts, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_hash").join(bodies, "key")
    if masks == MASKS:
        windows = windows.withColumn("core", _core("words", "pos")).join(F.broadcast(core), "core", "left_semi")
    return _seeds(windows, "words", masks, "pos").join(F.broadcast(seeds), "seed").join(bodies, "key")


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 50) -> DataFrame:
    """``doc_id, text_hash, item_id, item_words, matched, overlap, first_word`` per document and leaked item."""
    longest = max(map(len, MASKS))
    items = benchmark.select("item_id", words(F.col("text")).alias("item")).where(F.size("item") > 0).distinct().withColumn("key", F.xxhash64("item_id", "item"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    hits = _hits(rows, items.where(F.size("item") >= longest), MASKS)
    for (n,) in sorted(items.where(F.size("item") < longest).select(F.size("item")).distinct().collect()):
        hits = hits.select("doc_id", "text_hash", "item_id", "words", "item", "pos", "at").unionByName(
            _hits(rows, items.where(F.size("item") == n), short_masks(n)).select("doc_id", "text_hash", "item_id", "words", "item", "pos", "at")
        )
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("at"))
    place = F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda j: F.get("words", F.col("diagonal") + j) == F.get("item", j))
    inside = F.when(F.col("diagonal") < 0, F.filter(place, lambda j: j >= -F.col("diagonal"))).otherwise(place)
    found = hits.select("doc_id", "text_hash", "item_id", F.size("item").alias("item_words"), "diagonal", inside.alias("places"))
    ends = F.when(F.size("places") >= STRETCH, F.sequence(F.lit(STRETCH - 1), F.size("places") - 1))
    passage = F.coalesce(F.exists(ends, lambda k: F.get("places", k) - F.get("places", k - STRETCH + 1) < STRETCH + SWAPPED), F.lit(False))
    found = found.withColumn("passage", passage).groupBy("doc_id", "text_hash", "item_id", "item_words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("matched"),
        F.greatest(F.min("diagonal"), F.lit(0)).alias("first_word"),
        F.max("passage").alias("passage"),
    )
    found = found.where((F.col("matched") * 100 >= F.col("item_words") * percent) | F.col("passage"))
    return found.select("doc_id", "text_hash", "item_id", "item_words", "matched", (F.col("matched") / F.col("item_words")).alias("overlap"), "first_word")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = 50) -> DataFrame:
    """``docs`` without the rows into which a benchmark item leaks, columns as they were."""
    key, mark = unused(docs, "_id"), unused(docs, "_hash")
    bad = leaks(docs.select("doc_id", "text"), benchmark, percent).select(F.col("doc_id").alias(key), F.col("text_hash").alias(mark)).distinct()
    same = (F.xxhash64(docs["text"]) == bad[mark]) & docs["doc_id"].eqNullSafe(bad[key])
    return docs.join(bad, same, "left_anti")
