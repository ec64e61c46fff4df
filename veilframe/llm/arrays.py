"""Whole texts as flat numpy arrays: words, hashes and shingles of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins; null counts as empty."""
    flat = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` units, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased."""
    n = len(raw)
    hashes, starts_all = [], []
    opens = np.zeros(n + 1, bool)
    opens[offsets[:-1]] = True
    a = 0
    while a < n:
        b = min(a + _CHUNK, n)
        while b < n and not opens[b]:  # to the next place where no word is cut
            gaps = np.flatnonzero(_SEPARATOR[raw[b : b + 4096]] | opens[b : b + len(raw[b : b + 4096])])
            if len(gaps):
                b += int(gaps[0])
                break
            b = min(b + 4096, n)
        part = raw[a:b]
        inside = ~_SEPARATOR[part]
        edge = opens[a : b + 1].copy()
        edge[0] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1 : len(part)]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1 : len(part)]
        at = np.flatnonzero(first)
        if len(at):
            length = np.flatnonzero(last) + 1 - at
            place = np.flatnonzero(inside)
            within = np.arange(len(place)) - np.repeat(np.cumsum(length) - length, length)
            values = _LOWER[part[place]] * powers(int(length.max()))[within]
            sums = np.add.reduceat(values, np.cumsum(length) - length)
            hashes.append(mix(sums ^ (length.astype(np.uint64) << np.uint64(48))))
            starts_all.append(at + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(offsets, at, "right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct ``width``-word shingles as ascending hashes, and their offsets.

    A row with fewer words has its whole word sequence as its one shingle.
    """
    rows = len(offsets) - 1
    h, row = byte_words(raw, offsets)
    words = np.bincount(row, minlength=rows)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    with np.errstate(over="ignore"):
        spread = [mix(np.uint64(k + 1) * np.uint64(0xD1342543DE82EF95) + np.zeros(1, np.uint64))[0] | np.uint64(1) for k in range(width)]
        n = len(h) - width + 1
        if n > 0:
            total = h[:n] * spread[0]
            for k in range(1, width):
                total += h[k : k + n] * spread[k]
            same = row[:n] == row[width - 1 :]
            out, of = mix(total[same]), row[:n][same]
        else:
            out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        few = np.flatnonzero((words > 0) & (words < width))
        if len(few):
            first = np.cumsum(words) - words
            extra = np.zeros(len(few), np.uint64)
            for k in range(width - 1):
                have = words[few] > k
                extra[have] += h[first[few[have]] + k] * spread[k]
            extra = mix(extra ^ (words[few].astype(np.uint64) << np.uint64(56)))
            out, of = np.concatenate([out, extra]), np.concatenate([of, few])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    ends = np.cumsum(np.bincount(of, minlength=rows))
    start = 0
    for end in ends.tolist():
        out[start:end].sort()
        start = end
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=rows))])
