"""Language identification of mixed-language text.

The script of a word narrows its candidate languages to those that were learned with that
script.  Each candidate scores the word by its character trigrams; a Viterbi pass over the
words of a text, with a penalty for every switch, labels each word and so the spans of each
language.  The language with the most letters is the text's; its score is its share of them.

Learned from at most about ``SAMPLE`` labelled texts per language.  ``und`` is the answer for
null texts and those without a letter (score 0).  A text whose words are all in scripts that
no language was learned with gets the most frequent learned language with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.chars import SCRIPT_NAMES, Words, bounded_sample, passing, tables, text_slices
from veilframe.session import ship

SAMPLE = 1500
BUCKETS = 1 << 16
SWITCH = 6.0
_SLICE = 1 << 20
_NEVER = np.float32(-1e4)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # trigram bucket x language, log probabilities
    scripts: np.ndarray  # script x language, whether learned
    common: int


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bucket at each letter or mark of a word, and the first of each word."""
    codes = np.where(words.inside, words.codes, 0).astype(np.uint32)
    place = np.flatnonzero(words.inside)
    before = np.concatenate([[0], codes[:-1]]).astype(np.uint32)
    after = np.concatenate([codes[1:], [0]]).astype(np.uint32)
    h = before[place] * np.uint32(0x9E3779B1) ^ codes[place] * np.uint32(0x85EBCA77) ^ after[place] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64), np.cumsum(words.length) - words.length


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, v in zip(texts, langs) if v == lang]
            for i, j in text_slices(own, _SLICE):
                words = Words(own[i:j])
                g, _ = _grams(words)
                grams[lang] = grams.get(lang, 0) + np.bincount(g, minlength=BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(tables()[2][words.codes[words.letter]], minlength=len(SCRIPT_NAMES))
    for lang in grams:
        for kind, counts in (("gram", grams[lang]), ("script", scripts[lang])):
            at = np.flatnonzero(counts)
            yield pa.record_batch({"lang": [lang] * len(at), "kind": [kind] * len(at), "slot": at, "n": counts[at].astype(np.int64)})


def train(labelled: DataFrame, per_language: int = SAMPLE) -> Model:
    """Learns from ``labelled(doc_id, text, lang)``; rows without text or language are left out."""
    ship(labelled.sparkSession)
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sample = bounded_sample(rows, "lang", per_language).select("text", "lang")
    counts = sample.mapInArrow(_count, "lang string, kind string, slot long, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    for k, lang in enumerate(langs):
        for kind, into in (("gram", grams), ("script", scripts)):
            own = counts[(counts["lang"] == lang) & (counts["kind"] == kind)]
            into[own["slot"].to_numpy(), k] = own["n"].to_numpy()
    logs = np.log((grams + 0.2) / (grams.sum(0) + 0.2 * BUCKETS)).astype(np.float32)
    known = scripts > 0.01 * np.maximum(1, scripts.sum(0))
    return Model(langs, logs, known, int(scripts.sum(0).argmax()) if langs else 0)


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; ``at`` parts the words of the texts. All texts step together."""
    n, states = scores.shape
    length = np.diff(at)
    order = np.argsort(-length, kind="stable")
    first, length = at[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(longest), "left")
    kind = np.min_scalar_type(max(1, states))
    came, moved = np.zeros(n, kind), np.zeros((n, states), bool)
    best = np.zeros((len(length), states), np.float32)
    penalty = np.float32(penalty)
    for t in range(longest):
        k = alive[t]
        own, place = best[:k], first[:k] + t
        if t:
            top = own.max(1, keepdims=True)
            came[place] = own.argmax(1)
            floor = top - penalty
            moved[place] = own < floor
            np.maximum(own, floor, out=own)
            own -= top
        own += scores[place]
    state, labels = best.argmax(1), np.zeros(n, kind)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        place, own = first[:k] + t, state[:k]
        labels[place] = own
        if t:
            state[:k] = np.where(moved[place, own], came[place], own)
    return labels


def label(texts: list[str | None], model: Model, penalty: float = SWITCH):
    """Words of the texts, and the language of each word (-1: none was learned with its script)."""
    words = Words(texts)
    if not len(words.start) or not model.langs:
        return words, np.full(len(words.start), -1)
    g, first = _grams(words)
    scores = np.add.reduceat(model.scores[g], first, axis=0)
    allowed = model.scripts[tables()[2][words.codes[words.start]]]
    none = ~allowed.any(1)
    scores = np.where(allowed, scores, _NEVER)
    scores[none] = 0
    at = np.searchsorted(words.row, np.arange(len(texts) + 1))
    labels = viterbi(scores, at, penalty).astype(np.int64)
    labels[none] = -1
    return words, labels


def _predict(model, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            ids, all_texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for i, j in text_slices(all_texts, _SLICE):
                texts = all_texts[i:j]
                words, labels = label(texts, m)
                size = len(m.langs)
                total = np.zeros((j - i, max(1, size)))
                known = labels >= 0
                np.add.at(total, (words.row[known], labels[known]), words.length[known])
                best, some = total.argmax(1), total.sum(1) > 0
                letters = words.letters() > 0
                best = np.where(some, best, m.common)
                best = np.where(letters & (size > 0), best, size)
                score = np.where(letters & some, total.max(1) / np.maximum(1, total.sum(1)), 0.0)
                out = {"doc_id": ids.slice(i, j - i), "lang_pred": pa.array(names[best], pa.string()), "score": score}
                if spans:
                    out["spans"] = pa.array(_spans(words, labels, m.langs, j - i), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
                yield pa.record_batch(out)

    return run


def _spans(words: Words, labels: np.ndarray, langs: list[str], rows: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(rows)]
    for row, start, length, lang in zip(words.row.tolist(), words.start.tolist(), words.length.tolist(), labels.tolist()):
        if lang < 0:
            continue
        start -= int(words.base[row])
        if out[row] and out[row][-1]["lang"] == langs[lang]:
            out[row][-1]["end"] = start + length
        else:
            out[row].append({"start": start, "end": start + length, "lang": langs[lang]})
    return out


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` (and ``spans``) for every row of ``docs(doc_id, text)``; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(sent, spans), "doc_id long, lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else ""))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is found, columns as they were; no shuffle.

    A row stays if its text has a letter and a word that a learned language is found for.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def found(texts: list[str | None]) -> np.ndarray:
        keep = np.zeros(len(texts), bool)
        words, labels = label(texts, sent.value)
        keep[words.row[labels >= 0]] = True
        return keep & (words.letters() > 0)

    return docs.where(passing(F.col("text"), found, _SLICE))
