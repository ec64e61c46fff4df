"""Quality classifier: a byte-level convolutional network in numpy.

Filters over ``WIDTH`` bytes are learned as one weight per place, byte and filter.  A text's
UTF-8 bytes are cut into chunks that overlap and together cover the whole text; each filter
is max-pooled over a chunk, and the mean and the maximum of the pooled values over all chunks
give one probability.  No pretrained part, no input but the bytes.

Learned from at most about ``SAMPLE`` labelled texts per class, each of at most ``LONGEST``
characters; every text is scored whole.  Null and empty texts are one
chunk of padding and get the network's answer to that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import arrays
from veilframe.llm.chars import labelled_sample
from veilframe.session import ship

SAMPLE, LONGEST = 700, 50_000
WIDTH, FILTERS, CHUNK, STRIDE = 6, 16, 512, 448
_CHUNKS = 64


@dataclass
class Model:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    head: np.ndarray  # 2 * FILTERS
    base: float
    center: np.ndarray
    scale: np.ndarray


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk matrix (padded with byte 0) and the row of each chunk; every byte is in one or two."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-(size - (CHUNK - STRIDE)) // STRIDE))
    row = np.repeat(np.arange(len(size)), count)
    begin = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < size[row][:, None]
    out = np.zeros(at.shape, np.uint8)
    out[inside] = raw[(at + offsets[:-1][row][:, None])[inside]]
    return out, row


def pooled(block: np.ndarray, model: Model, places: bool = False):
    """Max over each chunk of every rectified filter, and where it is."""
    span = CHUNK - WIDTH + 1
    total = model.filters[0][block[:, :span]]
    for k in range(1, WIDTH):
        total += model.filters[k][block[:, k : k + span]]
    if places:
        best = total.argmax(1)
        return np.maximum(np.take_along_axis(total, best[:, None], 1)[:, 0] + model.bias, 0), best
    return np.maximum(total.max(1) + model.bias, 0)


def _combine(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    count = np.diff(np.append(first, len(values)))[:, None]
    return np.hstack([np.add.reduceat(values, first) / count, np.maximum.reduceat(values, first)])


def predict(raw: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    block, row = chunks(raw, offsets)
    values = np.concatenate([pooled(block[i : i + _CHUNKS], model) for i in range(0, len(block), _CHUNKS)])
    features = _combine(values, np.searchsorted(row, np.arange(len(offsets) - 1)))
    z = (features - model.center) / model.scale @ model.head + model.base
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 10, seed: int = 3) -> Model:
    """Stochastic gradient descent (Adam) through the pooling; classes weigh alike."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS), 0.0, np.zeros(2 * FILTERS), np.ones(2 * FILTERS))
    share = labels.mean()
    weigh = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    slots = {k: [np.zeros_like(getattr(model, k)) for _ in range(2)] for k in ("filters", "bias", "head")}
    slots["base"] = [0.0, 0.0]
    step = 0

    def adam(name: str, slope, rate: float) -> None:
        m, v = slots[name]
        m = 0.9 * m + 0.1 * slope
        v = 0.98 * v + 0.02 * slope * slope
        slots[name] = [m, v]
        now = getattr(model, name) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
        setattr(model, name, now.astype(np.float32) if name in ("filters", "bias") else now)

    for epoch in range(epochs):
        rate = 0.02 * 0.8**epoch
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 16):
            own = order[i : i + 16]
            offsets = np.concatenate([[0], np.cumsum([len(texts[t]) for t in own])])
            block, row = chunks(np.frombuffer(b"".join(texts[t] for t in own), np.uint8), offsets)
            parts = [pooled(block[j : j + _CHUNKS], model, True) for j in range(0, len(block), _CHUNKS)]
            values, places = (np.concatenate(x) for x in zip(*parts))
            first = np.searchsorted(row, np.arange(len(own)))
            features = _combine(values, first)
            z = features @ model.head + model.base
            slope = weigh[own] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            back = slope[:, None] * model.head
            count = np.bincount(row, minlength=len(own))[:, None]
            grad = (back[:, :FILTERS] / count)[row]
            top = features[:, FILTERS:]
            hit = values == top[row]
            grad = (grad + np.where(hit, back[:, FILTERS:][row], 0)) * (values > 0)
            filters = np.zeros_like(model.filters)
            c, f = np.nonzero(grad)
            for k in range(WIDTH):
                np.add.at(filters[k], (block[c, places[c, f] + k], f), grad[c, f].astype(np.float32))
            step += 1
            adam("filters", filters + 1e-5 * model.filters, rate)
            adam("bias", grad.sum(0), rate)
            adam("head", slope @ features + 1e-4 * model.head, rate)
            adam("base", slope.sum(), rate)
    return _calibrated(model, texts, labels)


def _calibrated(model: Model, texts: list[bytes], labels: np.ndarray) -> Model:
    """The last layer alone once more, to the end, on standardised features."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    features = []
    raw = np.frombuffer(b"".join(texts), np.uint8)
    for i, j in arrays.slices(offsets, 1 << 20):
        block, row = chunks(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        values = np.concatenate([pooled(block[k : k + _CHUNKS], model) for k in range(0, len(block), _CHUNKS)])
        features.append(_combine(values, np.searchsorted(row, np.arange(j - i))))
    x = np.concatenate(features)
    model.center, model.scale = x.mean(0), x.std(0) + 1e-3
    x = np.hstack([(x - model.center) / model.scale, np.ones((len(x), 1))])
    share = labels.mean()
    weigh = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) / len(labels)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weigh * (p - labels)) + 1e-3 * w
        bend = (x * (weigh * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    model.head, model.base = w[:-1], float(w[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """Learns from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; rows without text or label are left out."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", per_class, LONGEST).select("quality", "text").orderBy("quality", "text").collect()
    labels = np.array([r["quality"] for r in sample])
    if not len(sample) or labels.min() == labels.max():
        fixed = 4.0 if len(labels) and labels[0] else -4.0
        return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), fixed, np.zeros(2 * FILTERS), np.ones(2 * FILTERS))
    return fit([r["text"].encode() for r in sample], labels)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs(doc_id, text)``; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = arrays.utf8(batch.column("text"))
            for i, j in arrays.slices(offsets, 1 << 18):
                own = offsets[i : j + 1]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "score": predict(raw[own[0] : own[-1]], own - own[0], sent.value)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
