"""N-gram Jaccard join under several global token orders.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``percent``/100.  For any total order of all shingles, linked sets share one of their first
``n - ceil(n * percent / 100) + 1`` shingles.  The join therefore

1. gives documents with equal sets one class (no pairs inside a group of copies);
2. orders shingles by how often their hash bucket occurs in the whole corpus, rarest first,
   and lets classes that share a prefix shingle meet; the same must hold under two further
   orders (ascending and descending hash) before the sets themselves are compared;
3. first compares each class with the smallest class of every prefix shingle (a star, never
   all pairs), joins what links into components, and then compares only the pairs whose
   components still differ, so a large group of near copies costs a row per copy.  Every
   link between components is found; links inside a component are not enumerated.

Null, empty or word-less texts have no shingles and link with nothing.  Each row is judged by
its own text: rows that share a ``doc_id`` may lie in different components (``deduplicate``
keeps them apart); a null ``doc_id`` never represents a component.  Shingles are
64-bit hashes.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import arrays
from veilframe.llm.naming import unused
from veilframe.llm.workers import tidy
from veilframe.session import SMALL_BATCH, ship, stored

#: Buckets of the occurrence counts that order the shingles: 4 MB as a broadcast, at any input size.
BUCKETS = 1 << 20
_SLICE = 1 << 12
#: Bits of the filter that tells which sets to fetch; 2 MB at most. When full, more sets travel.
FILTER_BITS = 1 << 24
_BATCH = 2 << 20
#: Members of a shingle up to which they are compared without bands.
_FEW = 64


def prefix_length(n: np.ndarray | int, percent: int):
    return n - (n * percent + 99) // 100 + 1


def _sets(batch: pa.RecordBatch, width: int):
    raw, offsets = arrays.utf8(batch.column("text"))
    for i, j in arrays.slices(offsets, _BATCH):
        own = offsets[i : j + 1]
        values, at = arrays.shingle_sets(raw[own[0] : own[-1]], own - own[0], width)
        yield i, j, values, at


def _sums(values: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(arrays.mix(values + np.uint64(salt)), at[full])
    return out.view(np.int64)


def _summary(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            n, a, b = [], [], []
            for _, _, values, at in _sets(batch, width):
                counts += np.bincount((values % np.uint64(buckets)).astype(np.int64), minlength=buckets)
                n.append(np.diff(at))
                a.append(_sums(values, at, 1))
                b.append(_sums(values, at, 2))
            if n:
                rows = len(batch)
                yield pa.record_batch(
                    {"doc_id": batch.column("doc_id"), "n": np.concatenate(n), "a": np.concatenate(a), "b": np.concatenate(b), "slice": pa.nulls(rows, pa.int32()), "counts": pa.nulls(rows, pa.binary())}
                )
        step = min(_SLICE, buckets)
        kept = [(k, counts[k : k + step]) for k in range(0, buckets, step) if counts[k : k + step].any()]
        if kept:
            none = pa.nulls(len(kept), pa.int64())
            yield pa.record_batch(
                {"doc_id": none, "n": none, "a": none, "b": none, "slice": pa.array([k for k, _ in kept], pa.int32()), "counts": pa.array([c.astype("<u4").tobytes() for _, c in kept], pa.binary())}
            )

    return run


def _add(key, table):
    total = 0
    for c in table.column("counts").to_pylist():
        total = total + np.frombuffer(c, "<u4").astype(np.int64)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


def _prefixes(width: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for _, _, values, at in _sets(batch, width):
                n = np.diff(at)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                rank = (often[values % np.uint64(len(often))].astype(np.uint64) << np.uint64(32)) | (values >> np.uint64(32))
                firsts, sizes = [], prefix_length(n[full], percent)
                for s, e, p in zip(at[full].tolist(), at[full + 1].tolist(), sizes.tolist()):
                    firsts.append(values[s:e][np.argsort(rank[s:e], kind="stable")[:p]])
                tokens = np.concatenate(firsts).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.record_batch(
                    {"a": _sums(values, at, 1)[full], "b": _sums(values, at, 2)[full], "prefix": pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))}
                )

    return run


def _flagged(width: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        size = np.uint64(len(words) * 64)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            place = arrays.mix(ids.view(np.uint64)) % size
            want = np.flatnonzero((words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
            if not len(want):
                continue
            small = batch.take(pa.array(want))
            for i, j, values, at in _sets(small, width):
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    yield pa.record_batch(
                        {"rep": small.column("doc_id").slice(i, j - i).take(pa.array(full)), "tokens": pa.ListArray.from_arrays(pa.array(np.concatenate([at[full], at[-1:]]).astype(np.int32)), pa.array(values.view(np.int64)))}
                    )

    return run


def _bits(ids: DataFrame) -> np.ndarray:
    """A one-hash filter of the ids, sized to them up to ``FILTER_BITS``."""
    size = 1 << 16

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = arrays.mix(batch.column("id").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(size)
            slot, inverse = np.unique(x >> np.uint64(6), return_inverse=True)
            word = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(word, inverse, np.uint64(1) << (x & np.uint64(63)))
            yield pa.record_batch({"slot": slot.view(np.int64), "word": word.view(np.int64)})

    n = ids.count()
    while size < min(16 * n, FILTER_BITS):
        size *= 2
    words = np.zeros(size // 64, np.uint64)
    rows = ids.mapInArrow(place, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toPandas()
    words[rows["slot"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return words


def _links(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (x, y) of class representatives, those that link."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    bits = spark.sparkContext.broadcast(_bits(ids))
    sets = docs.where("doc_id IS NOT NULL").mapInArrow(tidy(_flagged(width, bits)), "rep long, tokens array<long>")
    both = pairs.join(sets.select(F.col("rep").alias("x"), F.col("tokens").alias("tx")), "x")
    both = both.join(sets.select(F.col("rep").alias("y"), F.col("tokens").alias("ty")), "y")
    need = lambda t: F.expr(f"size({t}) - (size({t}) * {percent} + 99) div 100 + 1").cast("int")
    both = both.where(
        F.arrays_overlap(F.slice("tx", 1, need("tx")), F.slice("ty", 1, need("ty")))
        & F.arrays_overlap(F.slice(F.reverse("tx"), 1, need("tx")), F.slice(F.reverse("ty"), 1, need("ty")))
    )
    both = both.withColumn("shared", F.size(F.array_intersect("tx", "ty")))
    return both.where(F.expr(f"100L * shared >= {percent}L * (size(tx) + size(ty) - shared)")).select("x", "y").distinct()


def _fits(percent: int) -> str:
    """What sets of nx and ny shingles can still share from a first common one on suffices for a link."""
    rest = "least(nx - atx, ny - aty)"
    return f"100L * {rest} >= {percent}L * (nx + ny - {rest})"


def _across(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different components that share a prefix shingle and may link.

    Members of a shingle's most frequent component meet only the others. For shingles with many
    members, a member's band is the share of its set (in %) before the shingle: bands that
    together exceed ``100 * (100 - percent) / percent`` cannot link and never meet.
    """
    sides = [tokens.select("token", "many", "main", *(F.col(k).alias(k + s) for k in ("rep", "n", "at", "c"))) for s in ("x", "y")]
    left, right = sides[0].where("cx <> main").drop("main"), sides[1].drop("many", "main")
    may = "cx <> cy"
    few = left.where(f"many <= {_FEW}").join(right, "token").where(may).where(_fits(percent))
    most = 100 * (100 - percent) // percent
    band = lambda at, n: F.floor(100 * F.col(at) / F.col(n)).cast("int")
    crowd = left.where(f"many > {_FEW}").withColumn("bx", band("atx", "nx"))
    crowd = crowd.where(F.col("bx") <= most).withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(most) - F.col("bx"))))
    other = sides[1].where(f"many > {_FEW}").drop("many", "main").withColumn("by", band("aty", "ny"))
    other = other.where(F.col("by") <= most).withColumn("bx", F.explode(F.sequence(F.lit(0), F.lit(most) - F.col("by"))))
    many = crowd.join(other, ["token", "bx", "by"]).where(may).where(_fits(percent))
    pairs = few.select("repx", "repy").unionByName(many.select("repx", "repy"))
    return pairs.select(F.least("repx", "repy").alias("x"), F.greatest("repx", "repy").alias("y")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, component being its smallest node.

    Alternates large-star and small-star steps; each step is written to the shared folder, so
    a lost executor repeats one step.  Shuffles a row per link and step.
    """
    edges = stored(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    ship(spark, SMALL_BATCH)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    summary = stored(docs.mapInArrow(tidy(_summary(width, BUCKETS)), "doc_id long, n long, a long, b long, slice int, counts binary"), "summary")
    rows = summary.where("slice IS NULL").select("doc_id", "n", "a", "b")
    often = np.zeros(BUCKETS, np.uint32)
    total = summary.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(_add, "slice int, counts binary")
    for k, c in total.collect():
        often[k : k + _SLICE] = np.frombuffer(c, "<u4")
    counts = spark.sparkContext.broadcast(often)

    classes = stored(rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")).where("rep IS NOT NULL"), "classes")
    prefixes = docs.mapInArrow(tidy(_prefixes(width, percent, counts)), "a long, b long, prefix array<long>").groupBy("a", "b").agg(F.first("prefix").alias("prefix"))
    prefixes = stored(classes.join(prefixes, ["a", "b"]).select("rep", "n", "prefix"), "prefixes")

    tokens = prefixes.select(F.posexplode("prefix").alias("at", "token"), "rep", "n")
    lightest = F.min(F.struct((F.col("at") / F.col("n")).alias("share"), "rep", "n", "at"))
    hubs = tokens.groupBy("token").agg(lightest.alias("hub"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    hubs = hubs.select("token", F.col("hub.rep").alias("repx"), F.col("hub.n").alias("nx"), F.col("hub.at").alias("atx"))
    own = tokens.select("token", *(F.col(k).alias(k + "y") for k in ("rep", "n", "at")))
    star = own.join(hubs, "token").where("repx <> repy").where(_fits(percent))
    star = stored(star.select(F.least("repx", "repy").alias("x"), F.greatest("repx", "repy").alias("y")).distinct(), "pairs")
    links = stored(_links(star, docs, width, percent), "links")
    found = components(links)

    labelled = prefixes.join(found, prefixes.rep == found.node, "left").select("rep", "n", "prefix", F.coalesce("component", "rep").alias("c"))
    tokens = stored(labelled, "labelled").select(F.posexplode("prefix").alias("at", "token"), "rep", "n", "c")
    open_tokens = tokens.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many"), F.mode("c", True).alias("main")).where("lo < hi")
    tokens = stored(tokens.join(open_tokens.select("token", "many", "main"), "token"), "open")
    rest = stored(_across(tokens, percent).join(star, ["x", "y"], "left_anti"), "pairs")
    more = stored(_links(rest, docs, width, percent), "links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more))

    named = classes.join(found, classes.rep == found.node, "left").select("a", "b", F.coalesce("component", "rep").alias("c"))
    out = rows.join(named, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked rows: that with the smallest ``doc_id``, null ids last.

    Rows are told apart by ``doc_id`` and text together (a 64-bit hash of both), so rows that share
    a ``doc_id`` or have none are decided each by its own text.  Rows without words stay; of rows
    with equal ``doc_id`` and text one stays, except those with neither id nor words, which all do.
    Columns are as they were.
    """
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.col("text").cast("string")))
    found = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), width, percent)
    found = found.groupBy(F.col("doc_id").alias(key)).agg(F.first("component_id").alias("c"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    ids = keyed.groupBy(key).agg(F.first("doc_id").alias("id"))
    found = stored(found.join(ids, key), "rows").withColumn("rank", F.struct(F.col("id").isNull(), "id", key))
    best = found.groupBy("c").agg(F.min("rank")[key].alias("best"), F.count("*").alias("many")).where("many > 1")
    gone = stored(found.join(best, "c").where(F.col(key) != F.col("best")).select(key), "gone")
    twice = found.where("rows > 1 AND (n > 0 OR id IS NOT NULL)").select(key)
    one = stored(twice.join(gone, key, "left_anti"), "twice")
    named = keyed.join(gone.unionByName(one), key, "left_anti")
    return named.unionByName(keyed.join(one, key, "left_semi").dropDuplicates([key])).select(*docs.columns)
