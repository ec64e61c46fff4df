"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length one, so the largest cosine is the smallest distance.  An index
is a set of random projections, each a sorted array of single values.  A query opens a window
around its own value in every array; a vector collides where it lies in the window, which its
place in the array tells.  Windows grow by virtual rehashing (radius 1, c, c^2, ...) and a vector
that collides in at least ``threshold`` arrays is verified by its exact cosine in double
precision.  A query ends at the first radius within which its k-th best lies; whether it ends
is monotone in the radius, so that one is found by halving.  Where ``SHARE`` of a block is verified before that,
counting on costs more than it saves: the rest of the block is verified at once, so such a query
is exact.  Only the distance test can miss a neighbour (seldom: one that lies just within it).

Equal vectors are one class that keeps its ``k + 1`` smallest ids, which is all that ties
need.  Classes are dealt into blocks of bounded size, each with its own index over all of
its vectors; stated queries meet every block, and each block's best are merged.  Vectors
that are null, zero or hold null or non-finite components take no part; vectors of another
dimension form an index of their own.  Rows with equal id and vector count once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import ship, stored

#: Vectors of a block, and queries that meet it at a time.
BLOCK, QUERIES = 1 << 13, 1 << 12
PROJECTIONS, THRESHOLD, WIDTH, SHARE, SURE = 64, 46, 2.0, 0.25, 0.7
#: Radii of the windows; the last holds every unit vector, whatever the projection.
RADII = (*(0.5 * 1.08**i for i in range(28)), 1e9)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class Index:
    """Sorted single projections of unit vectors, and each vector's place in each."""

    def __init__(self, unit: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.axes = rng.standard_normal((unit.shape[1], PROJECTIONS))
        self.n = len(unit)
        values = unit @ self.axes
        order = np.argsort(values, axis=0, kind="stable").T
        self.values = np.sort(values, axis=0).T.copy()
        self.place = np.empty(order.shape, np.uint16 if self.n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=self.place.dtype)[None, :], axis=1)

    def collisions(self, at: list[float], radius: float) -> np.ndarray:
        """In how many arrays each vector lies in the window around ``at``."""
        step = radius * WIDTH / 2
        low = np.array([v.searchsorted(x - step) for v, x in zip(self.values, at)], self.place.dtype)[:, None]
        high = np.array([v.searchsorted(x + step, "right") for v, x in zip(self.values, at)], self.place.dtype)[:, None]
        inside = (self.place - low) < (high - low)  # unsigned: places before the window wrap around
        return inside.view(np.uint8).sum(0, dtype=np.uint8)

    def search(self, query: np.ndarray, cosine, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Verified candidates of one unit query and their cosines, as at the first radius that ends it.

        Candidates only get more and the k-th best only nearer as windows grow, so that radius is
        found by halving: five radii are counted, not all up to it.
        """
        at = (query @ self.axes).tolist()
        most = min(self.n, max(200, math.ceil(SHARE * self.n)) + k)
        first, last, found = 0, len(RADII) - 1, None
        while first < last or found is None:
            r = (first + last) // 2
            ids = np.flatnonzero(self.collisions(at, RADII[r]) >= THRESHOLD)
            whole = len(ids) >= most or r == len(RADII) - 1
            scores = cosine(ids) if k <= len(ids) and not whole else None
            if whole or scores is not None and math.sqrt(max(0.0, 2 - 2 * np.partition(scores, len(scores) - k)[-k])) <= RADII[r] * SURE:
                last, found = r, (ids, scores, whole)
                if first == last:
                    break
            else:
                first = r + 1
        ids, scores, whole = found
        return (np.arange(self.n), cosine(slice(None))) if whole else (ids, scores)


def cosines(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of ``x`` with each row, each computed alone, so equal vectors score alike."""
    return (rows * x).sum(1) / (np.sqrt((x * x).sum()) * np.sqrt((rows * rows).sum(1)))


def _search(k: int):
    def run(key, classes, queries):
        names = ["class_id", "score", "ids"]
        out: list[list] = [[], [], []]
        if classes.num_rows and queries.num_rows:
            rows, asked = _matrix(classes, "embedding"), _matrix(queries, "asked")
            members, asking = classes.column("ids").to_pylist(), queries.column("class_id").to_pylist()
            unit = rows / np.sqrt((rows * rows).sum(1))[:, None]
            index = Index(unit)
            for c, q in zip(asking, asked):
                ids, scores = index.search(q / np.sqrt((q * q).sum()), lambda some, q=q / np.sqrt((q * q).sum()): unit[some] @ q, k + 1)
                if len(ids) > k + 1:  # and all that may tie with the last
                    ids = ids[scores >= np.partition(scores, len(scores) - k - 1)[-k - 1] - 1e-9]
                scores = cosines(q, rows[ids])
                order = sorted(range(len(ids)), key=lambda i: (-scores[i], members[ids[i]][0]))[: k + 1]
                out[0] += [c] * len(order)
                out[1] += [float(scores[i]) for i in order]
                out[2] += [members[ids[i]] for i in order]
        kinds = (pa.int64(), pa.float64(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


def _usable(column: str) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, asks: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every row of ``vectors(vec_id, embedding)`` for which ``asks`` holds.

    Shuffles every vector once per block of queries; a task holds one block of classes.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(_usable("embedding") & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(asks, F.lit(False)).alias("asks"))
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.select("vec_id", "embedding").distinct().withColumn("n", first).where(F.col("n") <= k + 1)
    classes = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes.withColumn("class_id", F.xxhash64("ids", "embedding")), "classes")
    asked = stored(rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct().join(classes.select("class_id", "embedding"), "embedding").select("query_id", "class_id"), "queries")
    wanted = stored(classes.select("class_id", "embedding").join(asked.select("class_id").distinct(), "class_id", "left_semi"), "wanted")
    blocks = max(1, -(-classes.count() // BLOCK))
    turns = max(1, -(-wanted.count() // QUERIES))
    dim = F.size("embedding").alias("dim")
    left = classes.select("ids", "embedding", dim, F.pmod(F.xxhash64("class_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    right = wanted.select("class_id", F.col("embedding").alias("asked"), dim, F.pmod(F.xxhash64("class_id", F.lit(1)), F.lit(turns)).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    keys = ["dim", "block", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "class_id long, score double, ids array<long>")
    best = Window.partitionBy("class_id").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).groupBy("class_id").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))
    pairs = asked.join(found, "class_id").select("query_id", F.explode("hits").alias("h")).select("query_id", "h.score", F.explode("h.ids").alias("vec_id")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
