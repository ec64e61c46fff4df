"""Toxicity by weak supervision.

Voters are defined without a look at any label.  A lexicon voter fires on a stated word; a
pattern voter fires on a beginning of 4 to 6 letters, another where two different words of a
text begin so, which also sees inflected and unseen forms.  Every beginning of the sampled
texts that is neither very rare nor common is a pattern.  A generative model with a latent
label, fitted by EM over labelled and unlabelled texts alike, estimates how often each voter
fires on toxic and on other texts; a given label is one more observation of the latent one,
with error rates of its own that are estimated too.  Voters that tell nothing weigh nothing.
In every round the agreement of two voters beyond what the latent label explains is their
correlation, and correlated voters share their weight.  A linear classifier over hashed words
and beginnings is then trained on the posterior labels and scores every text.

Learned from at most about ``SAMPLE`` texts of each label and as many unlabelled ones, each of
at most ``LONGEST`` characters; every text is scored whole.  Null and empty texts have no
features and get the classifier's base score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.chars import Words, labelled_sample, passing, text_slices
from veilframe.session import ship

SAMPLE, LONGEST = 1200, 50_000
# Insults of several languages, one plain list.
LEXICON = tuple(
    """idiot moron stupid pathetic worthless disgusting scum trash loser clown dumb ugly imbecile filth vermin bastard coward cretin
    jerk fool garbage creep freak pig rat swine liar retard imbécile crétin salaud ordure abruti débile connard pourriture
    trottel dummkopf abschaum schwein versager widerlich wertlos arschloch estúpido imbécil basura escoria patético payaso
    asqueroso perdedor inútil stupido cretino schifoso feccia perdente pagliaccio""".split()
)
SIZES = (4, 5, 6)
#: A pattern is a beginning in at least ``RARE`` sampled texts and at most ``COMMON`` of them.
RARE, COMMON = 3, 0.3
#: How much oftener a voter must fire on toxic texts to weigh anything, and voters that weigh at most.
LIFT, VOTERS = 4.0, 400
#: Shares of toxic and of other texts that a label calls toxic, as far as known beforehand; it counts like all labelled texts.
TRUST = (0.95, 0.01)
_TABLE, _BUCKETS = 1 << 20, 1 << 24
_SLICE = 1 << 20


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of words and beginnings
    weights: np.ndarray
    bias: float
    pairs: np.ndarray  # sorted hashes of beginnings that two different words must have
    pair_weights: np.ndarray


def _distinct(words: Words, size: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of the words of one text, and those of two different words."""
    long = words.length >= size
    both = np.unique(np.stack([words.hashes(size)[long], whole[long]]), axis=1)[0]
    once, count = np.unique(both, return_counts=True)
    return once, once[count > 1]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a text's words, of their beginnings and of the beginnings of two different words."""
    words = Words([text])
    whole = words.hashes()
    found = [_distinct(words, n, whole) for n in SIZES]
    return np.unique(whole), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[x.tobytes() for x in features(t)] for t in batch.column("text").to_pylist()]
        columns = {k: pa.array([r[i] for r in rows], pa.binary()) for i, k in enumerate(("words", "starts", "pairs"))}
        yield pa.record_batch({"toxic": batch.column("toxic"), **columns})


class Votes:
    """Which voters fire on which texts, as (text, voter) pairs."""

    def __init__(self, bags: list[np.ndarray], voters: int) -> None:
        self.texts, self.voters = len(bags), voters
        self.row = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags])
        self.col = np.concatenate(bags) if bags else np.zeros(0, np.int32)

    def fired(self, mass: np.ndarray) -> np.ndarray:
        """Sum over the texts on which each voter fires."""
        return np.bincount(self.col, mass[self.row], self.voters)

    def total(self, weight: np.ndarray) -> np.ndarray:
        """Sum over the voters that fire on each text."""
        return np.bincount(self.row, weight[self.col], self.texts)

    def dense(self, voters: np.ndarray) -> np.ndarray:
        place = np.full(self.voters, -1)
        place[voters] = np.arange(len(voters))
        out, some = np.zeros((self.texts, len(voters)), np.float32), place[self.col] >= 0
        out[self.row[some], place[self.col[some]]] = 1
        return out


def label_model(votes: Votes, given: np.ndarray, first: np.ndarray, rounds: int = 8):
    """Posterior of the latent label; per voter its firing rates (other, toxic) and weight; error rates of the labels.

    ``given`` is 1, 0 or -1 (not labelled); ``first`` the probability to begin with, NaN for texts
    that the first estimates leave out.
    """
    sure, known = ~np.isnan(first), given >= 0
    q = np.where(sure, first, 0.0)
    weight = np.zeros(votes.voters)
    rates, errors = np.zeros((2, votes.voters)), (0.0, 0.0)
    noise = 2 / math.sqrt(max(1, votes.texts))
    for _ in range(rounds):
        other = np.where(sure, 1 - q, 0.0)
        rates = np.stack([(votes.fired(other) + 0.5) / (other.sum() + 1), (votes.fired(q) + 0.5) / (q.sum() + 1)])
        weight = np.zeros(votes.voters)
        telling = np.flatnonzero((rates[1] >= LIFT * rates[0]) & (votes.fired(q) >= 2.5))
        telling = telling[np.argsort(-(votes.fired(q) * np.log(rates[1] / rates[0]))[telling], kind="stable")[:VOTERS]]
        if len(telling):
            rest, toxic = votes.dense(telling), q.astype(np.float32)
            rest -= np.outer(1 - toxic, rates[0][telling].astype(np.float32))
            rest -= np.outer(toxic, rates[1][telling].astype(np.float32))
            rest[~sure] = 0
            rest /= np.maximum(1e-9, np.sqrt(np.einsum("ij,ij->j", rest, rest)))
            tied = rest.T @ rest
            np.fill_diagonal(tied, 0)
            weight[telling] = 1 / (1 + np.where(tied > noise, tied, 0).sum(1))
        on, off = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0]))
        z = math.log(max(1e-6, q.sum()) / max(1e-6, other.sum())) + (weight * off).sum() + votes.total(weight * (on - off))
        if known.any():  # the given label: how often it is 1 on toxic and on other texts
            said, trust = (given == 1)[known], float(known.sum())
            hit = (q[known][said].sum() + TRUST[0] * trust) / (q[known].sum() + trust)
            false = ((1 - q)[known][said].sum() + TRUST[1] * trust) / ((1 - q)[known].sum() + trust)
            errors = (float(1 - hit), float(false))
            z += np.where(known, np.where(given == 1, math.log(hit / false), math.log((1 - hit) / (1 - false))), 0.0)
        q, sure = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.ones(len(q), bool)
    return q, rates, weight, errors


def _telling(votes: Votes, q: np.ndarray, least: float, ratio: float) -> np.ndarray:
    """Features of at least ``least`` toxic texts and ``ratio`` times as common there, strongest first."""
    counts = votes.fired(q)
    lift = (counts + 0.5) / (q.sum() + 1) / ((votes.fired(1 - q) + 0.5) / ((1 - q).sum() + 1))
    found = np.flatnonzero((counts >= least) & (lift >= ratio))
    return found[np.argsort(-counts[found] * np.log(lift[found]), kind="stable")]


def _linear(votes: Votes, posterior: np.ndarray, used: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on the posterior labels; both classes weigh alike."""
    place = np.full(votes.voters, -1)
    place[used] = np.arange(len(used))
    some = place[votes.col] >= 0
    row, col = votes.row[some], place[votes.col[some]]
    mass = np.array([(1 - posterior).sum(), posterior.sum()])
    balance = posterior * 0.5 / max(1.0, mass[1]) + (1 - posterior) * 0.5 / max(1.0, mass[0])
    w, b, gw, gb = np.zeros(len(used)), -1.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(row, w[col], votes.texts)
        slope = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - posterior)
        dw, db = np.bincount(col, slope[row], len(used)) + 3e-3 * w, slope.sum()
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w - 0.5 * dw / np.sqrt(gw), b - 0.5 * db / math.sqrt(gb)
    return w, float(b)


def fit(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], given: np.ndarray) -> Model:
    """Learns from the ``features`` of texts, which are used up; ``given`` is 1, 0 or -1 (not labelled)."""
    none, known = np.zeros(0, np.uint64), given[given >= 0]
    if not len(known) or known.min() == known.max():
        return Model(none, np.zeros(0), 4.0 if len(known) and known[0] else -4.0, none, np.zeros(0))
    stated = Words(list(LEXICON)).hashes()
    # Features of fewer than RARE texts tell nothing; counts in hash buckets, never too small, rule most of them out early.
    often = np.zeros(_BUCKETS, np.uint8)
    for bag in bags:
        for kind in bag:
            bucket = (kind % np.uint64(_BUCKETS)).astype(np.int32)
            often[bucket] = np.minimum(often[bucket], 254) + 1
    enough = lambda x: (often[(x % np.uint64(_BUCKETS)).astype(np.int32)] >= RARE) | np.isin(x, stated)
    for i, bag in enumerate(bags):
        bags[i] = tuple(kind[enough(kind)] for kind in bag)
    del often
    names = [np.unique(np.concatenate([bag[k] for bag in bags])) for k in range(3)]
    names[0] = np.union1d(names[0], stated)
    base = np.cumsum([0, *map(len, names)])
    kind = np.repeat(np.arange(3), np.diff(base))
    rows = [np.concatenate([np.searchsorted(names[k], bag[k]) + base[k] for k in range(3)]).astype(np.int32) for bag in bags]
    bags.clear()
    count = np.zeros(int(base[3]), np.int32)
    for row in rows:
        count[row] += 1
    spoken = np.zeros(int(base[3]), bool)
    spoken[np.searchsorted(names[0], stated)] = True
    pattern = (kind > 0) & (count >= RARE) & (count <= max(RARE, COMMON * len(rows)))
    voter = np.flatnonzero(spoken | pattern)
    place = np.full(len(kind), -1)
    place[voter] = np.arange(len(voter))
    votes = Votes([own[own >= 0].astype(np.int32) for own in (place[r] for r in rows)], len(voter))
    rude = votes.total(spoken[voter].astype(float)) > 0
    first = np.where(given >= 0, np.where(given == 1, 0.95, 0.02), np.where(rude, 0.9, np.nan))
    posterior, *_ = label_model(votes, given, first)
    del votes
    found = Votes([r[(count[r] >= 5) | spoken[r]] for r in rows], int(base[3]))
    used = np.unique(np.concatenate([np.flatnonzero(spoken), _telling(found, posterior, 5.0, 8.0)]))
    w, b = _linear(found, posterior, used)
    hashes, pair = np.concatenate(names)[used], kind[used] == 2
    parts = []
    for own in (~pair, pair):
        order = np.argsort(hashes[own])
        parts += [hashes[own][order], w[own][order]]
    return Model(parts[0], parts[1], b, parts[2], parts[3])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """Learns from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; documents without a label are learned from too."""
    ship(docs.sparkSession)
    rows = labelled_sample(docs, labels, "toxic", per_class, LONGEST, unlabelled=True)
    sample = rows.select("toxic", "text").mapInArrow(_bags, "toxic int, words binary, starts binary, pairs binary").orderBy("toxic", "words", "starts")
    given, bags = [], []
    for row in sample.toLocalIterator():  # a partition at a time
        given.append(row["toxic"])
        bags.append(tuple(np.frombuffer(bytes(row[k]), np.uint64) for k in ("words", "starts", "pairs")))
    return fit(bags, np.array(given, np.int64))


def _matches(h: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.flatnonzero(flags[(h % np.uint64(_TABLE)).astype(np.int64)])
    if not len(near) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(keys, h[near]), len(keys) - 1)
    ok = keys[k] == h[near]
    return near[ok], k[ok]


def scores(texts: list[str | None], m: Model, flags: np.ndarray) -> np.ndarray:
    words = Words(texts)
    z = np.full(len(texts), m.bias)
    whole = words.hashes()
    singles, pairs, forms = [], [], []
    for size in (None, *SIZES) if len(m.keys) + len(m.pairs) else ():
        h = whole if size is None else words.hashes(size)
        near, k = _matches(h, m.keys, flags)
        singles.append(words.row[near] * len(m.keys) + k)
        if size is not None:
            near, k = _matches(h, m.pairs, flags)
            pairs.append(words.row[near] * max(1, len(m.pairs)) + k)
            forms.append(whole[near])
    if singles and len(m.keys):
        seen = np.unique(np.concatenate(singles))
        np.add.at(z, seen // len(m.keys), m.weights[seen % len(m.keys)])
    if pairs and len(m.pairs):
        where, form = np.concatenate(pairs), np.concatenate(forms)
        order = np.lexsort((form, where))
        where, form = where[order], form[order]
        fresh = np.ones(len(where), bool)
        fresh[1:] = (where[1:] != where[:-1]) | (form[1:] != form[:-1])
        place, count = np.unique(where[fresh], return_counts=True)
        twice = place[count > 1]
        np.add.at(z, twice // len(m.pairs), m.pair_weights[twice % len(m.pairs)])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _flags(m: Model) -> np.ndarray:
    flags = np.zeros(_TABLE, bool)
    for keys in (m.keys, m.pairs):
        flags[(keys % np.uint64(_TABLE)).astype(np.int64)] = True
    return flags


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs(doc_id, text)``; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = _flags(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in text_slices(texts, _SLICE):
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "score": scores(texts[i:j], sent.value, flags)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as they were; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    made: list[np.ndarray] = []

    def calm(texts: list[str | None]) -> np.ndarray:
        if not made:
            made.append(_flags(sent.value))
        return scores(texts, sent.value, made[0]) < threshold

    return docs.where(passing(F.col("text"), calm, _SLICE))
