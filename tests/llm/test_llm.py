import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import ann, arcwarc, decontam, files, jaccard, langid, packing, quality, queries, toxicity, urlfilter, wavelet
from veilframe.llm.tokens import Coder, tokenizer_path

DOCS = "doc_id long, text string, extra string, rep long"
BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in texts], DOCS)


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "a  b \n c   "), (7, "word " * 3000), (7, "word " * 3000), (None, "no id here")]


@pytest.mark.parametrize("path,blank", [(BYTES, True), (WORDS, False)])
def test_coder_equals_whole_text(path, blank):
    code, plain = Coder(path, blank, limit=3), Tokenizer.from_file(path)
    whole = lambda t: np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    r, odd = random.Random(1), ["it's", "don't.", "İstanbul", "ŉa", "É.", "straße,,", "ﬁ", "ǅ", "naïve!?", "a\n", "\nb", "", "x ", "l'été", "ΑΣ", "<|", "日本", "x_", "\x85y"]
    texts = [t or "" for _, t in EDGE] + [" x", "it's don't  ", "<|endoftext|> a", "x \x01 y", "é b c", "İ Σ"]
    texts += [" ".join(r.choice(odd) for _ in range(9)) for _ in range(300)]
    assert code.encode(texts) == [whole(t) for t in texts] and all(code.encode([t, "b a"]) == [whole(t), whole("b a")] for t in texts)


@pytest.mark.parametrize("block", (64, 1000, 1 << 16))
def test_wavelet_file(monkeypatch, tmp_path, block):
    monkeypatch.setattr(wavelet, "BLOCK", block // 8 * 8)
    x = np.random.default_rng(1).integers(0, 300, 1000).astype("<u4")
    data = wavelet.build(x, [1, None], [400, 600], 0)
    (tmp_path / "s.wvm").write_bytes(data)
    wide = wavelet.Shard(lambda at, size: files.part((tmp_path / "s.wvm").as_uri(), at, size))
    assert [wide.access(i) for i in (0, 63, 64, 999)] == x[[0, 63, 64, 999]].tolist() and wide.documents()[0] == [1, None]
    shard = wavelet.Shard(data)
    assert (shard.tokens() == x).all() and [shard.access(i) for i in range(1000)] == x.tolist()
    for t in (0, 5, 299, 77, 100_000):
        at = np.flatnonzero(x == t).tolist()
        assert shard.occurrences(t) == at and shard.rank(t, 500) == sum(i < 500 for i in at) and shard.select(t, len(at)) == -1


def test_wavelet_round_trip(spark):
    got = wavelet.read_shards(wavelet.write_shards(frame(spark, EDGE), BYTES, 2, shard_tokens=10)).orderBy("start").collect()
    code, start = Coder(BYTES, True), 0
    for row, (i, t) in zip(got, sorted(EDGE, key=lambda d: -1 if d[0] is None else d[0])):
        raw = code.whole(t or "") + np.array([2], "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    assert wavelet.read_shards(wavelet.write_shards(frame(spark, []), BYTES, 2)).count() == 0


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_against_brute_force(spark):
    r = random.Random(2)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice((1, 2, 30, 120)))] for _ in range(12)]
    texts = [(1000, None), (1001, ""), (1002, " ")]
    for i in range(150):
        words = list(base[i % 12])
        for _ in range(r.choice((0, 0, 1, 2, 5))):
            words[r.randrange(len(words))] = f"v{r.randrange(50)}"
        texts.append((i, r.choice((" ", "\n", "  ")).join(words).title() if i % 3 else " ".join(words)))
    for width, percent in ((3, 90), (5, 80)):
        got = jaccard.jaccard_components(frame(spark, texts), width, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(texts, width, percent)
    kept = jaccard.deduplicate(frame(spark, texts + [(3, dict(texts)[3]), (None, "x y")]), 5, 80)
    roots = {i for i, (n, c) in brute_components(texts, 5, 80).items() if i == c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(roots) and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_decontamination(spark):
    r = random.Random(4)
    item = [f"Item{k}" for k in range(30)]
    noise = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]
    swapped = [w if k % 6 else "zzz" for k, w in enumerate(item)]
    cut = item[:14] + ["extra", "words"] + item[14:]
    docs = [(1, item), (2, noise(40) + swapped + noise(5)), (3, noise(9) + cut), (4, noise(60)), (5, item[:8] + noise(30)), (6, ["a", "short", "item"]), (7, ["a", "short", "thing"])]
    rows = frame(spark, [(i, ", ".join(w).upper() if i == 1 else " ".join(w)) for i, w in docs] + [(8, None), (9, ""), (1, ", ".join(item).upper())])
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "A short item."), (2, None), (3, "")], "item_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in decontam.leaks(rows, bench).collect()) == [(1, 0), (2, 0), (3, 0), (6, 1)]
    assert sorted(x.doc_id for x in decontam.clean(rows, bench).collect()) == [4, 5, 7, 8, 9]
    assert decontam.leaks(rows, bench.limit(0)).count() == 0 and decontam.leaks(rows.limit(0), bench).count() == 0


def test_packing(spark):
    packed = packing.pack(frame(spark, EDGE), WORDS, 1, size=64, with_ids=True)
    rows = sorted((r.sequence_id, r.offset, r.length, r.doc_id, r.start, bytes(r.ids)) for r in packed.collect())
    fill = {}
    for s, offset, length, *_ in rows:
        assert fill.get(s, 0) == offset
        fill[s] = offset + length
    assert max(fill.values()) <= 64 and sum(r[2] for r in rows) == sum(len(Coder(WORDS, False).whole(t or "")) // 4 + 1 for _, t in EDGE)
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert joined[rows[0][0]].startswith(rows[0][5]) and {s: len(b) // 4 for s, b in joined.items()} == fill


def test_best_fit_plan():
    import bisect

    for seed in range(20):
        r = random.Random(seed)
        size = r.choice((10, 50, 4096))
        lengths = [r.randint(1, size) for _ in range(r.randint(1, 300))]
        bins = []
        for n in sorted(lengths, reverse=True):
            i = bisect.bisect_left(bins, n)
            bisect.insort(bins, (bins.pop(i) if i < len(bins) else size) - n)
        table = packing.plan({n: lengths.count(n) for n in set(lengths)}, size)
        used = {int(row[2] + k // row[4]) for row, nxt in zip(table, [*table[1:], None]) for k in range(int((nxt[1] if nxt is not None and nxt[0] == row[0] else lengths.count(row[0])) - row[1]))}
        assert used == set(range(len(bins)))


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(1000 + i, x[50]) for i in range(9)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, [1.0, 2.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    good = {i: np.array(v, float) for i, v in rows if i < 2000}
    hit = total = 0
    for q in [i for i in good if i % 50 == 0]:
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        scores = {i: good[q] @ v / np.sqrt((good[q] @ good[q]) * (v @ v)) for i, v in good.items() if i != q}
        best = sorted(scores, key=lambda i: (-round(scores[i], 12), i))[:5]
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5] and all(abs(scores[v] - s) < 1e-12 for _, v, s in own)
        hit, total = hit + len({v for _, v, _ in own} & set(best)), total + 5
    assert hit / total >= 0.9 and [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 50] == [1000, 1001, 1002, 1003, 1004]


def test_language(spark):
    en, de, ru = "the house and the garden were there with them", "der garten und das haus sind schön nicht wahr", "дом и сад были там вместе с ними"
    rows = [(i, " ".join(random.Random(i).sample(t.split(), 6)), lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 20)]
    model = langid.train(spark.createDataFrame(rows + [(900, None, "en"), (901, "x", None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.predict(frame(spark, [(1, en), (2, de), (3, ru), (4, None), (5, "12 !"), (6, f"{en}. {de}"), (7, "日本")]), model, spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "de", "ru", "und", "und"] and got[7].score == 0
    assert [(s.lang) for s in got[6].spans] == ["en", "de"] and got[6].spans[0].end == len(en)
    assert sorted(r.doc_id for r in langid.identified(frame(spark, [(1, en), (4, None), (5, "12 !")]), model).collect()) == [1]


def test_toxicity(spark):
    r = random.Random(6)
    rows = [(i, " ".join([f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(30)] + ([r.choice(("grumfa", "grumfo", "grumfisti", "idiot"))] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(labelled.select("doc_id", "text"), labelled.where("doc_id < 200").select("doc_id", "toxic"))
    got = {x.doc_id: x.score for x in toxicity.score(frame(spark, [(1, "a calm text"), (2, "what a grumfunde thing"), (3, "you Idiot"), (4, None), (5, "")]), model).collect()}
    assert got[2] >= 0.3 and got[3] >= 0.3 and max(got[1], got[4], got[5]) < 0.3


def test_quality(spark):
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) + ("###" if i % 2 else "") for _ in range(40)), int(i % 2 == 0)) for i in range(80)]
    model = quality.fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]), epochs=3)
    got = {x.doc_id: x.score for x in quality.score(frame(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, "")]), model).collect()}
    assert len(got) == 82 and sum((got[i] >= 0.5) == (y == 1) for i, _, y in rows) >= 76
    block, row = quality.chunks(np.arange(2000, dtype=np.uint64).astype(np.uint8), np.array([0, 0, 513, 2000]))
    assert row.tolist() == [0, 1, 1, 2, 2, 2, 2] and quality.STRIDE < quality.CHUNK


def test_urls(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/")]
    urls = [(1, "https://A.example.COM/en/71?q"), (2, "http://x.com/en/8"), (3, "http://com/en/"), (4, "http://xcom/en/"), (5, None), (6, "no scheme"), (7, "ftp://n.net/fr/"), (8, "://n.net/de/#x"), (8, "://n.net/de/#x")]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()]
    assert sorted(got)[:4] == [(1, "a.example.com", "/en/71", "example.com/en/7", "allow"), (2, "x.com", "/en/8", "com/en/", "block"), (3, "com", "/en/", "com/en/", "block"), (4, "xcom", "/en/", None, "allow")]
    assert [g[1:] for g in sorted(got)[4:]] == [("", "", None, "allow"), ("", "", None, "allow"), ("n.net", "/fr/", None, "allow"), ("n.net", "/de/", "net/de/", "block"), ("n.net", "/de/", "net/de/", "block")]


CONTRACT = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def test_url_query_has_the_words_of_its_contract(spark, tmp_path):
    urls = [f"{s}://{sub}{h}{p}{more}" for _, h, p in CONTRACT for s in ("http", "") for sub in ("", "A.b.", "x") for more in ("", "9?q=/de/", "#/en/")]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")

    def judged(url):
        rest = url.partition("://")[2].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host, path = host.lower(), slash + path
        fits = [(h + p, v) for v, h, p in CONTRACT if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, "allow")))

    want = sorted((i, *judged(u)) for i, u in enumerate(urls))
    assert {w[3:] for w in want} >= {(h + p, v) for v, h, p in CONTRACT}
    own = [tuple(r) for r in queries.op8_urlfilter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(own) == want
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(duckdb.sql(queries.oracle_sql()["op8_urlfilter"]).fetchall()) == want


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(3000)]
    cascade = urlfilter.build_cascade(keys[::3], spark.createDataFrame([(k,) for k in keys], "key string"))
    assert len(cascade.levels) > 2 and cascade.listed(keys).tolist() == [i % 3 == 0 for i in range(3000)]


def test_archives(spark):
    long = "é" * 600
    pages = [(1, "http://a/", long), (2, "http://b/ c", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (2, "http://b/ c", long), (None, "u", "z\r\n\r\nz")]
    got = arcwarc.read_pages(arcwarc.convert(arcwarc.write_arc(spark.createDataFrame(pages, "page_id long, url string, html string")))).collect()
    assert len(got) == len(pages) and sum(r.record_type == "response" and r.payload_bytes == 1200 for r in got) == 1
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to) == ("revisit", 2) and by[3].record_type == by[4].record_type == "response"
    assert by[5].payload_digest == hashlib.sha1(b"").hexdigest() and by[None].payload_bytes == 6
    with pytest.raises(ValueError):
        list(arcwarc.read_arc(arcwarc.arc_head("f", "1") + b"u 0.0.0.0 20000101000000 text/html 99\nshort"))
