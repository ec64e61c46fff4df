"""Best-fit decreasing packing of documents into token sequences of one size.

Only lengths matter to best fit, and there are at most ``size`` of them, so the plan is made
once, for the whole corpus, from the histogram of piece lengths: lengths in descending order,
a segment tree over remaining capacities gives the tightest open bins in logarithmic time,
and all bins of equal remaining capacity are filled together.  The result is what best-fit
decreasing gives piece by piece.  Each piece then finds its place from its rank among the
pieces of its length; ranks are counted per task first, so no length gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.tokens import coder
from veilframe.llm.workers import tidy
from veilframe.session import SMALL_BATCH, ship, stored

SIZE = 4096
#: Words of a generation that a worker remembers; two workers share an executor with a full heap.
WORDS = 100_000


class Capacities:
    """Open bins by remaining capacity: a segment tree that finds the smallest one that fits."""

    def __init__(self, size: int) -> None:
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.open[node] += by
            node //= 2

    def push(self, capacity: int, first: int, count: int) -> None:
        if capacity and count:
            self.bins[capacity].append((first, count))
            self._count(capacity, 1)

    def pop(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return self.bins[capacity].pop()

    def tightest(self, least: int) -> int | None:
        """Smallest capacity of at least ``least`` with an open bin."""
        node = least + self.leaves
        if not self.open[node]:
            while True:  # up to the first right neighbour that has bins, then down its left edge
                while node & 1:
                    node //= 2
                    if node <= 1:
                        return None
                node += 1
                if self.open[node]:
                    break
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces per sequence), by length and rank."""
    tree, rows, fresh = Capacities(size), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens")
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, count, new = size, fresh, -(-left // (size // length)), True
            else:
                (first, count), new = tree.pop(capacity), False
            per = capacity // length
            full = min(count, left // per)
            used, part = full, left - full * per if full < count else 0
            rows.append((length, rank, first, size - capacity, per))
            tree.push(capacity - per * length, first, full)
            if part:
                tree.push(capacity - part * length, first + full, 1)
                used += 1
            if new:
                fresh += used
            else:
                tree.push(capacity, first + used, count - used)
            placed = full * per + part
            left, rank = left - placed, rank + placed
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(tokenizer: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, code, end = TaskContext.get().partitionId(), coder(tokenizer, False, WORDS), np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = {}
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(names), 256):
                out: list[tuple] = []
                for d, raw in zip(names[i : i + 256], code.encode([t or "" for t in texts.slice(i, 256).to_pylist()])):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * size)):
                        piece = raw[a : a + 4 * size]
                        n = len(piece) // 4
                        rank = seen.get(n, 0)
                        seen[n] = rank + 1
                        out.append((d, k, a // 4, n, zlib.crc32(piece), rank, piece if with_ids else None))
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array([pid] * len(out), pa.int32())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids", "part"],
                )

    return run


def _place(table: np.ndarray):
    stride = np.int64(1) << np.int64(48)
    keys = table[:, 0] * stride + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            row = table[np.searchsorted(keys, length * stride + rank, "right") - 1]
            within = rank - row[:, 1]
            columns = {k: batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            yield pa.record_batch(columns | {"sequence_id": row[:, 2] + within // row[:, 4], "offset": row[:, 3] + within % row[:, 4] * length})

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) per piece.

    Null texts are empty and hold the end id alone; only documents of more than ``size``
    tokens are cut.  Rows with equal or null ids are packed like any others.  The driver
    gathers at most ``size`` histogram rows; shuffled are a row per piece and per task and length.
    """
    spark = docs.sparkSession
    ship(spark, SMALL_BATCH)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, ids binary, part int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(tidy(_pieces(tokenizer, end_id, size, with_ids)), schema), "pieces")
    counts = stored(pieces.groupBy("part", "length").count(), "lengths")
    table = plan({int(n): int(c) for n, c in counts.groupBy("length").agg(F.sum("count")).collect()}, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # The counts grow with the tasks, so they are never broadcast.
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "rank").mapInArrow(_place(table), out)
    return placed if with_ids else placed.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token ids of each sequence as little-endian bytes, from ``pack(with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
