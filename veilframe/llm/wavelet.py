"""Token ids as one wavelet-matrix file per shard.

A shard file holds the ids of consecutive documents as bit planes, highest bit first; below
each plane the ids are stably parted by that bit.  Planes are compressed in blocks of
``BLOCK`` bits, and a directory in the file tells where each block lies and how many ones
come before it.  The id at a position, the count of an id before a position and the place of
its k-th occurrence therefore read at most two blocks of each plane, and nothing else.

Layout: magic ``WVMX0002``, header length (u32), JSON header, compressed sections: doc ids
(i64), null flags (u8), token counts (u32), directory (u32: for each block its compressed
size and the ones of its plane before it), then the blocks, plane by plane.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import files
from veilframe.llm.tokens import coder, forget
from veilframe.llm.workers import tidy
from veilframe.session import SMALL_BATCH, fresh_path, ship, stored

MAGIC = b"WVMX0002"
#: Bits of a block.
BLOCK = 1 << 16
#: Tokens after which a shard file is closed at the end of a document.
SHARD_TOKENS = 1 << 19
#: Words of a generation that a worker remembers; two workers share an executor with a full heap.
WORDS = 340_000


def build(ids: np.ndarray, doc_ids: list[int | None], counts: list[int], start: int) -> bytes:
    """The shard file of ``ids``: ``counts[i]`` tokens for each document in turn."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length() if n else 1)
    x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    one = x.dtype.type(1)
    blocks = [
        pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        pack(np.array([d is None for d in doc_ids], "u1").tobytes()),
        pack(np.array(counts, "<u4").tobytes()),
    ]
    zeros, planes, sizes, before = [], [], [], []
    for bit in range(levels - 1, -1, -1):
        up = ((x >> x.dtype.type(bit)) & one).astype(bool)
        flat, ones = np.packbits(up, bitorder="little"), 0
        for i in range(0, len(flat), BLOCK // 8):
            part = flat[i : i + BLOCK // 8]
            planes.append(pack(part.tobytes()))
            sizes.append(len(planes[-1]))
            before.append(ones)
            ones += int(np.bitwise_count(part).sum(dtype=np.int64))
        low = np.flatnonzero(~up)
        zeros.append(len(low))
        x = np.concatenate([x.take(low), x.take(np.flatnonzero(up))])
    blocks.append(pack(np.array([sizes, before], "<u4").tobytes()))
    head = json.dumps({"n": n, "levels": levels, "zeros": zeros, "docs": len(doc_ids), "start": start, "block": BLOCK, "sections": [len(b) for b in blocks]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *blocks, *planes])


class Shard:
    """Reads a shard file, given as bytes or as a function that reads ``size`` bytes from an offset."""

    def __init__(self, data: bytes | Callable[[int, int], bytes]) -> None:
        self._read = (lambda at, size: data[at : at + size]) if isinstance(data, bytes) else data
        top = self._read(0, 12)
        if top[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(top[8:12], "little")
        self.head = json.loads(self._read(12, size))
        self.n, self.levels, self.zeros, self.block = (self.head[k] for k in ("n", "levels", "zeros", "block"))
        self._at = np.concatenate([[0], np.cumsum(self.head["sections"])]) + 12 + size
        per = -(-self.n // self.block)
        sizes, before = np.frombuffer(self._section(3), "<u4").astype(np.int64).reshape(2, self.levels, per)
        self._size, self._before = sizes, before
        self._place = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape) + int(self._at[4])

    def _section(self, k: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self._read(int(self._at[k]), int(self._at[k + 1] - self._at[k])))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        ids, null = np.frombuffer(self._section(0), "<i8"), np.frombuffer(self._section(1), "u1")
        return [None if z else int(d) for d, z in zip(ids, null)], np.frombuffer(self._section(2), "<u4").astype(np.int64)

    def _bits(self, level: int, block: int) -> bytes:
        """The bits of one block, eight a byte."""
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self._read(int(self._place[level, block]), int(self._size[level, block])))

    def _look(self, level: int, i: int) -> tuple[int, int]:
        """Ones of the plane before place ``i``, and the bit there (0 behind the end)."""
        block, r = divmod(i, self.block)
        if block == self._before.shape[1]:  # the end of a plane of whole blocks
            return self.n - self.zeros[level], 0
        bits = self._bits(level, block)
        whole, rest = divmod(r, 8)
        ones = int(self._before[level, block]) + int.from_bytes(bits[:whole], "little").bit_count()
        last = bits[whole] if whole < len(bits) else 0
        return ones + (last & (1 << rest) - 1).bit_count(), last >> rest & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            ones, bit = self._look(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            (x, _), (y, _) = self._look(level, a), self._look(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if token >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before position ``i``."""
        a, b = self._range(token, min(max(i, 0), self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence, from 0; -1 if there are fewer."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._nth(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th bit of that kind in the plane."""
        ones = self._before[level]
        counts = ones if bit else np.arange(len(ones)) * self.block - ones
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.frombuffer(self._bits(level, block), np.uint8)
        each = np.cumsum(np.bitwise_count(bits if bit else ~bits), dtype=np.int64)
        k -= int(counts[block])
        byte = int(np.searchsorted(each, k, "right"))
        word = int(bits[byte]) if bit else ~int(bits[byte]) & 255
        for _ in range(k - (int(each[byte - 1]) if byte else 0)):
            word &= word - 1
        return block * self.block + byte * 8 + (word & -word).bit_length() - 1

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            flat = np.frombuffer(b"".join(self._bits(level, b) for b in range(self._size.shape[1])), np.uint8)
            up = np.unpackbits(flat, count=self.n, bitorder="little").astype(bool)
            z, out = self.zeros[level], np.empty(self.n, kind)
            out[np.flatnonzero(~up)] = v[:z]
            out[np.flatnonzero(up)] = v[z:] | kind(1 << (self.levels - 1 - level))
            v = out
        return v.astype("<u4")


def _writer(tokenizer: str, end_id: int, folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, code, end = TaskContext.get().partitionId(), coder(tokenizer, True, WORDS), np.array([end_id], "<u4").tobytes()
        ids, docs, counts, held, start, shard = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{pid:06d}-{shard:06d}.wvm"
            files.put(path, build(np.frombuffer(b"".join(ids), "<u4"), docs, counts, start))
            return pa.record_batch({"part": pa.array([pid], pa.int32()), "file": [path], "tokens": [held]})

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(names), 256):
                for d, raw in zip(names[i : i + 256], code.encode([t or "" for t in texts.slice(i, 256).to_pylist()])):
                    ids.append(raw + end)
                    docs.append(d)
                    counts.append(len(raw) // 4 + 1)
                    held += counts[-1]
                    if held >= most:
                        yield flush()
                        start += held
                        ids, docs, counts, held, shard = [], [], [], 0, shard + 1
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` in ascending ``doc_id`` order and writes the shard files.

    Null texts are empty; every document ends with ``end_id``.  Null ids come first; rows with
    equal ids are ordered by text.  Returns ``part, file, tokens`` of every file, as written.
    One shuffle, by range of (doc_id, text hash), so equal ids can't crowd one task.
    """
    spark = docs.sparkSession
    ship(spark, SMALL_BATCH)
    folder = folder or fresh_path(spark, "wavelet")
    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return stored(rows.mapInArrow(tidy(_writer(tokenizer, end_id, folder, shard_tokens)), "part int, file string, tokens long"), "wavelet-files")


def _reader(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the worker has just encoded
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist()):
                shard = Shard(files.get(path))
                docs, counts = shard.documents()
                raw = memoryview(shard.tokens().tobytes())
                ends = np.cumsum(counts)
                begins = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.record_batch(
                    {"doc_id": pa.array(docs, pa.int64()), "start": begins + shard.head["start"] + bases[part], "n_tokens": counts, "ids_crc32": pa.array(crc, pa.int64())}
                )

    return run


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shard files.

    The driver gathers one total per writing task (not per file or document).
    """
    spark = shards.sparkSession
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("t")).orderBy("part").collect()
    bases, base = {}, 0
    for part, t in totals:
        bases[part], base = base, base + t
    spread = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(tidy(_reader(bases)), "doc_id long, start long, n_tokens long, ids_crc32 long")
