import itertools
import random
import time
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from veilframe.llm import ann, arcwarc, chars, decontam, files, jaccard, langid, packing, quality, tokens, toxicity, wavelet, workers
from veilframe.llm.tokens import Coder, tokenizer_path


def test_every_neighbour_beyond_the_share():
    unit = np.random.default_rng(9).standard_normal((2000, 64))
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    index = ann.Index(unit)
    for q in unit[::50]:
        ids, scores = index.search(q, lambda some, q=q: unit[some] @ q, 6)
        assert len(set(ids.tolist())) == len(ids) and np.allclose(scores, unit[ids] @ q)
        assert set(np.argsort(-(unit @ q))[:6].tolist()) <= set(ids.tolist())


@pytest.mark.parametrize("most", (0, decontam.BROADCAST_SEEDS))
def test_null_ids_leak_on_both_joins(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", most)
    item = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(None, item), (None, "another text"), (1, "a " + item), (1, item), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "another text")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.matched) for r in decontam.leaks(rows, bench).collect())
    assert got == [(0, 7, 30), (0, 8, 2), (1, 7, 30), (1, 7, 30)]
    assert [r.doc_id for r in decontam.clean(rows, bench).collect()] == [2]


def test_passages_shorter_than_half_an_item(spark):
    item = [f"w{k}" for k in range(500)]
    noise = [f"n{k}" for k in range(20)]
    swap = lambda ws, at: ["zz" if k in at else w for k, w in enumerate(ws)]
    texts = [item[100:300], noise + item[40:53] + noise, noise + swap(item[60:75], {5, 9}) + noise, noise + item[7:19] + noise, noise + swap(item[60:76], {4, 8, 11}) + noise, item[:12] + noise + item[30:42]]
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.matched for r in decontam.leaks(rows, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {0: 200, 1: 13, 2: 13}


def test_short_items_with_a_replaced_word(spark):
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(3, 13)}
    noise = [f"n{k}" for k in range(15)]
    texts = {(n, at): noise + w[:at] + ["zz"] + w[at + 1 :] + noise for n, w in items.items() for at in range(n)}
    texts |= {(n, -1): noise + w[: n // 3] + noise for n, w in items.items()} | {(n, 99): w for n, w in items.items()}
    rows = spark.createDataFrame([(n * 1000 + at, " ".join(t)) for (n, at), t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontam.leaks(rows, bench).collect()}
    assert got == {(n * 1000 + at, n, n - (at < 99)) for n, at in texts if at == 99 or (at >= 0 and n >= 5)}


def test_deduplicate_decides_by_row(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near = a.replace("a39", "zz")
    texts = [(1, a), (2, near), (2, b), (2, b), (3, b), (None, near), (None, c), (None, c), (None, ""), (None, ""), (4, None), (4, None), (5, "one"), (5, "two")]
    docs = spark.createDataFrame([(t, n, i) for n, (i, t) in enumerate(texts)], "text string, n int, doc_id long")
    kept = jaccard.deduplicate(docs, 5, 80)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, c), (None, ""), (None, ""), (4, None), (5, "one"), (5, "two")], key=str)
    assert kept.columns == docs.columns


ADDED = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b  c\n", " <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|", "<|endof text|>", "plain text"]


@pytest.mark.parametrize("name,blank,end", [("byte_bpe_50k.json", True, 50256), ("word_bpe_49k.json", False, 49407)])
def test_added_tokens_are_one_id(spark, name, blank, end):
    plain = Tokenizer.from_file(tokenizer_path(name))
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ADDED]
    code = Coder(tokenizer_path(name), blank, limit=3)
    assert code.encode(ADDED) == want and code.encode(ADDED[::-1]) == want[::-1]
    assert want[0] == np.array([end], "<u4").tobytes()
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    if blank:
        rows = wavelet.read_shards(wavelet.write_shards(docs, tokenizer_path(name), 2, shard_tokens=10)).orderBy("doc_id").collect()
        assert [r.ids_crc32 for r in rows] == [zlib.crc32(w + np.array([2], "<u4").tobytes()) for w in want]
    else:
        rows = packing.pack(docs, tokenizer_path(name), 1, size=64, with_ids=True).orderBy("doc_id").collect()
        assert [bytes(r.ids) for r in rows] == [w + np.array([1], "<u4").tobytes() for w in want]


def test_label_model_finds_accuracies_and_ties():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    rates = [(0.05, 0.6), (0.02, 0.4), (0.3, 0.3), (0.01, 0.3)]  # (other, toxic) of each voter; the third tells nothing
    fires = [np.where(truth, rng.random(4000) < b, rng.random(4000) < a) for a, b in rates]
    fires += [fires[3]] * 3  # three copies of the fourth
    rows = [np.flatnonzero([f[i] for f in fires]) for i in range(4000)]
    given = np.where(rng.random(4000) < 0.5, np.where(rng.random(4000) < 0.03, ~truth, truth).astype(int), -1)
    q, found, weight, errors = toxicity.label_model(toxicity.Votes(rows, len(fires)), given, np.where(given >= 0, np.where(given == 1, 0.9, 0.05), np.nan))
    assert np.abs(found[:, :4] - np.array(rates).T).max() < 0.12 and max(errors) < 0.1
    assert weight[2] == 0 and weight[0] > 0.6 and np.ptp(weight[3:7]) < 1e-9 and weight[3] < 0.4
    free = given < 0
    assert ((q > 0.5) == truth)[free].mean() > 0.9 and ((q > 0.5) == truth)[~free].mean() > 0.96


def test_toxic_scores_equal_a_plain_sum(spark):
    bags = ["grumfa grumfo ab", "grumfa", "other words", "wordy othera"] * 30
    m = toxicity.fit([toxicity.features(t) for t in bags], np.array([1, 1, 0, 0] * 30))
    texts = ["Grumfa grumfa", "grumfa GRUMFO x", "grumfisti-grumfo", "words idiot", "", None, "other " * 3000 + "idiot"]
    one, two = dict(zip(m.keys.tolist(), m.weights.tolist())), dict(zip(m.pairs.tolist(), m.pair_weights.tolist()))
    value = lambda w, n=None: int(chars.Words([w]).hashes(n)[0])
    for text, got in zip(texts, toxicity.scores(texts, m, toxicity._flags(m))):
        own = sorted(set((text or "").lower().replace("-", " ").split()))
        z = m.bias + sum(one.get(value(w), 0) for w in own)
        for n in toxicity.SIZES:
            starts = [w[:n] for w in own if len(w) >= n]
            z += sum(one.get(value(x, n), 0) + (two.get(value(x, n), 0) if starts.count(x) > 1 else 0) for x in set(starts))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_sample_is_never_empty(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS y")
    for most in (1000, 100):
        for bound in (0, chars.BROADCAST_VALUES):
            monkeypatch.setattr(chars, "BROADCAST_VALUES", bound)
            n = chars.bounded_sample(rows, "y", most).groupBy("y").count().collect()
            assert len(n) == 2 and all(0.5 * most < r["count"] <= max(1000, 2 * most) for r in n)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    scores, at = rng.normal(size=(17, 3)).astype(np.float32), np.array([0, 6, 6, 7, 12, 17])
    got = langid.viterbi(scores, at, 0.7)
    for a, b in zip(at, at[1:]):
        value = lambda path: sum(scores[a + k, s] for k, s in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))
        best = max((value(p) for p in itertools.product(range(3), repeat=b - a)), default=0.0)
        assert b == a or abs(value(got[a:b].tolist()) - best) < 1e-4


def test_more_than_256_languages():
    scores = np.full((3, 300), -1, np.float32)
    scores[:, 299] = 0
    assert langid.viterbi(scores, np.array([0, 3]), 1.0).tolist() == [299, 299, 299]


def test_network_against_a_slow_pass():
    rng = np.random.default_rng(2)
    m = quality.Model(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=2 * quality.FILTERS), 0.3, rng.normal(size=2 * quality.FILTERS), np.ones(2 * quality.FILTERS))
    texts = [b"", b"short", bytes(rng.integers(1, 256, 700, np.uint8)), bytes(rng.integers(1, 256, 3000, np.uint8))]
    got = quality.predict(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), m)
    for text, p in zip(texts, got):
        values, a = [], 0
        while True:
            chunk = text[a : a + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            sums = [[sum(float(m.filters[k][chunk[i + k]][f]) for k in range(quality.WIDTH)) for i in range(quality.CHUNK - quality.WIDTH + 1)] for f in range(2)]
            values.append([max(0.0, max(s) + float(m.bias[f])) for f, s in enumerate(sums)])
            a += quality.STRIDE
            if a + quality.CHUNK - quality.STRIDE >= len(text):
                break
        block, row = quality.chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        fast = quality.pooled(block, m)
        assert np.allclose(fast[:, :2], values, atol=1e-3)
        z = (np.concatenate([fast.mean(0), fast.max(0)]) - m.center) @ m.head + m.base
        assert abs(p - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_clashing_column_names(spark):
    long = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, long, 7, 8, 9, 10), (2, long, 7, 8, 9, 10), (3, "calm", 7, 8, 9, 10)], "doc_id long, text string, _text_hash int, _hash int, _key int, _gone int")
    bench = spark.createDataFrame([(0, "calm")], "item_id long, text string")
    for kept, ids in ((decontam.clean(docs, bench), [1, 2]), (jaccard.deduplicate(docs), [1, 3])):
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == ids and kept.first()._hash == 8


def test_archive_offsets_and_names(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (200 * i)) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    seen = []
    for turn in range(2):
        arcs = arcwarc.write_arc(pages, (tmp_path / f"a{turn}").as_uri())
        for path in sorted((tmp_path / f"a{turn}").iterdir()):
            data = path.read_bytes()
            for record in arcwarc.read_arc(data):
                if "Offset" in record:  # a member begins there that holds this very record
                    assert zlib.decompressobj(31).decompress(data[int(record["Offset"]) :]).startswith(record["URL"].encode() + b" ")
        warcs = arcwarc.convert(arcs).collect()
        seen.append(sorted(h["warc-record-id"] for w in warcs for h, _ in arcwarc.read_warc(files.get(w.file))))
    assert seen[0] == seen[1]


def test_one_id_for_two_vectors(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 1).collect()
    assert [(r.query_id, r.vec_id) for r in got] in ([(50, 1)], [(50, 2)])


def test_idle_coder_leaves_the_worker(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 1.0, raising=False)
    path = tokenizer_path("word_bpe_49k.json")
    own = tokens.coder(path, False)
    first, gone = own.encode(["some words, again"]), weakref.ref(own)
    assert tokens.coder(path, False) is own
    del own
    until = time.monotonic() + 20
    while gone() is not None and time.monotonic() < until:
        time.sleep(0.1)
    assert gone() is None and not tokens._CODERS
    assert tokens.coder(path, False).encode(["some words, again"]) == first


def test_packing_remembers_few_words(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    texts = [" ".join(word(400 * i + k) for k in range(400)) for i in range(1000)]
    batch = pa.record_batch({"doc_id": list(range(1000)), "text": texts})
    pieces = list(packing._pieces(tokenizer_path("word_bpe_49k.json"), 1, 4096, False)([batch]))
    (own,) = (c for k, c in tokens._CODERS.items() if k[2] == packing.WORDS)
    assert len(own.young) + len(own.old) <= 310_000
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert sum(b.num_rows for b in pieces) == 1000
    assert pieces[-1].column("length")[-1].as_py() == len(tok.encode(texts[-1], add_special_tokens=False).ids) + 1


def test_memory_is_given_back_once_a_task_holds_nothing(monkeypatch):
    held, gone = [], []

    def run(batches):
        values = np.zeros(9)
        held.append(weakref.ref(values))
        yield from batches

    monkeypatch.setattr(workers, "release", lambda: gone.append(held[-1]() is None))
    assert list(workers.tidy(run)(iter([1, 2]))) == [1, 2] and gone == [True]


def test_tasks_beside_a_full_heap_give_memory_back(spark, monkeypatch):
    tidied = []
    for module in (chars, jaccard, packing):
        monkeypatch.setattr(module, "tidy", lambda run: tidied.append(run.__qualname__.partition(".")[0]) or run)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "a b c e")], "doc_id long, text string")
    chars.passing(F.col("text"), lambda texts: np.ones(len(texts), bool), 9)
    packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 1)
    jaccard.jaccard_components(docs)
    assert {*tidied} == {"passing", "_pieces", "_summary", "_prefixes", "_flagged"}


def test_wavelet_runs_beside_a_full_heap(spark, monkeypatch):
    tidied, size = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(wavelet, "tidy", lambda run: tidied.append(run.__qualname__.partition(".")[0]) or run, raising=False)
    spark.conf.set(size, str(8 << 20))
    shards = wavelet.write_shards(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"), 2)
    assert wavelet.read_shards(shards).count() == 2
    assert tidied == ["_writer", "_reader"] and int(spark.conf.get(size).rstrip("b")) <= 2 << 20


def test_wavelet_remembers_few_words(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    monkeypatch.setattr(wavelet.files, "put", lambda path, data: None)
    assert getattr(wavelet, "WORDS", 600_000) <= 340_000
    monkeypatch.setattr(wavelet, "WORDS", 1000)
    path, word = tokenizer_path("byte_bpe_50k.json"), lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    texts = [" ".join(word(10 * i + k) for k in range(10)) for i in range(2000)]
    batch = pa.record_batch({"doc_id": list(range(2000)), "text": texts})
    (out,) = wavelet._writer(path, 2, "file:///none", 1 << 30)([batch])
    (own,) = (c for k, c in tokens._CODERS.items() if k == (path, True, 1000))
    assert len(own.young) + len(own.old) <= 2 * (1000 + 256 * 10) and len(own.bare) <= 1000
    tok = Tokenizer.from_file(path)
    assert out.column("tokens")[0].as_py() == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts)


def test_reading_shards_back_drops_the_coder():
    path = tokenizer_path("byte_bpe_50k.json")
    gone = weakref.ref(tokens.coder(path, True, 7))
    assert gone() is not None and list(wavelet._reader({})(iter([]))) == []
    assert gone() is None and not tokens._CODERS
    assert tokens.coder(path, True, 7).encode(["a b"]) == [tokens.Coder(path, True).whole("a b")]


def test_line_breaks_between_words_need_no_whole_chain(monkeypatch):
    path, called = tokenizer_path("byte_bpe_50k.json"), []
    code, tok = tokens.Coder(path, True, 50), Tokenizer.from_file(path)
    texts = ["One, two.\nThree été!\nÉon.\nĠa four", "Only\nlines,\nhere", "Is it. so", ""]
    whole = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    for name in ("whole", "_run"):
        monkeypatch.setattr(code, name, lambda t, own=getattr(code, name): called.append(t) or own(t))
    assert code.encode(texts) == [whole(t) for t in texts] and not [t for t in called if t]
    r, bits = random.Random(5), ["a", "Be", "é", "x,,", "\n", "\n", "\n\n", " ", " ", "'", "s", "1", "\t", "\r", "日", "ß\n", "Ġ", "ŉ", "\x85", "\u2028"]
    odd = ["".join(r.choice(bits) for _ in range(r.randrange(9))) for _ in range(3000)]
    assert [code.encode([t])[0] for t in odd] == [whole(t) for t in odd]


@pytest.mark.parametrize("near", (0.05, 3.0))
def test_few_radii_are_counted_and_end_as_step_by_step(monkeypatch, near):
    rng = np.random.default_rng(4)
    unit = np.repeat(rng.standard_normal((60, 64)), 20, axis=0) + near * rng.standard_normal((1200, 64))
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    index, counted = ann.Index(unit), []
    plain, most = ann.Index.collisions, max(200, 300) + 6
    monkeypatch.setattr(ann.Index, "collisions", lambda self, at, radius: counted.append(radius) or plain(self, at, radius))
    for q in unit[::60]:
        ids, scores = index.search(q, lambda some, q=q: unit[some] @ q, 6)
        for radius in ann.RADII:
            hits = (np.abs((unit - q) @ index.axes) <= radius * ann.WIDTH / 2).sum(1) >= ann.THRESHOLD
            if hits.sum() >= most or hits.sum() >= 6 and np.sqrt(max(0, 2 - 2 * np.sort((unit @ q)[hits])[-6])) <= radius * ann.SURE:
                break
        want = np.arange(1200) if hits.sum() >= most else np.flatnonzero(hits)
        assert ids.tolist() == want.tolist() and np.allclose(scores, unit[ids] @ q)
        assert 0 < len(counted) <= 5
        counted.clear()
