import pytest
from pyspark.sql import functions as F

from veilframe import api
from veilframe.functions.folding import Searched, folded, key_of_value, keys_of_text, pattern_of
from veilframe.operators import lookup
from veilframe.operators.names import NameReader, name_spans, trimmed
from veilframe.operators.rules import BY_SOURCE
from veilframe.sources import texts
from veilframe.sources.store import Store, StoreError, WrongPassword, check_kdf
from veilframe.streaming import masking as streaming

SMALL_KDF = {"n": 1024, "r": 8, "p": 1}


def test_folding_keeps_places():
    text = "L’Università È İO"
    flat, places = folded(text)
    assert len(flat) == len(places) and "universita" in flat and flat.endswith("io")
    assert list(Searched(text).places_of("universita", False)) == [(2, 12)]
    assert list(Searched("xRossi Rossi_ ROSSI").places_of("rossi", False)) == [(14, 19)]
    assert list(Searched("Mario\n Rossi").places_of("mario rossi", False)) == [(0, 12)]
    assert list(Searched("ROSSI Rossi").places_of("Rossi", True)) == [(6, 11)]


@pytest.mark.parametrize("value", ["Rossi", "Mario  Rossi", "a.b@x.it", "+39 333", "D'Aè"])
def test_keys_find_every_whole_match(value):
    for text in (f"x {value} y", value, f"({value.upper()})"):
        assert list(Searched(text).places_of(value, False)) and key_of_value(value) in keys_of_text(text)


NAMES = [
    ("scrive Mario Verdini oggi", ["Mario Verdini"], "rules:first-name"),
    ("Maria Chiara De Lucchi Via Roma", ["Maria Chiara De Lucchi"], "rules:first-name"),
    ("Verdini Mario, socio", ["Verdini Mario"], "rules:surname-first"),
    ("Ciao Mario", [], None),
    ("solo Mario qui", [], None),
    ("Mario Verdini Anna Bianconi", ["Mario Verdini", "Anna Bianconi"], "rules:first-name"),
]


def test_names(spark):
    reader = NameReader(["Mario", "Maria", "Chiara", "Anna"])
    for text, expected, source in NAMES:
        got = list(reader.read(text))
        assert [s["text"] for s in got] == expected and all(text[s["start"] : s["end"]] == s["text"] for s in got)
        assert {s["source"] for s in got} <= {source}
    rows = spark.createDataFrame([(NAMES[0][0],), (None,), ("",)], "t string").select(name_spans(F.col("t"), ["Mario"]).alias("s")).collect()
    assert [len(r.s) if r.s is not None else 0 for r in rows] == [1, 0, 0]


def test_trimming(spark):
    text = "Con Officine Prova S.r.l. e Dott. Lia Prova Via Po"
    rows = spark.createDataFrame([(text,)], "t string").select(trimmed(F.concat(BY_SOURCE["company-suffix"].spans(F.col("t")), BY_SOURCE["title-name"].spans(F.col("t")))).alias("s")).first().s
    assert [s.text.rstrip(".") for s in rows] == ["Officine Prova S.r.l", "Lia Prova"]
    assert all(text[s.start : s.end] == s.text for s in rows)


DOCS = [(1, "Il sig. Zeno Prova (zeno.prova@posta.it) lavora per Alfa Nova."), (2, "PROVA telefona ad alfa  nova; Prova e prova."), (3, None), (4, "")]


def test_propagation_and_round_trip(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    glossary = spark.createDataFrame([("Alfa Nova", "AZIENDA", ["Nova"])], "term string, kind string, aliases array<string>")
    done = api.anonymize(docs, glossary=glossary)
    got = {r.doc_id: r.masked for r in done.texts.collect()}
    assert got[3] is None and got[4] == ""
    assert "Zeno" not in got[1] and "Alfa" not in got[1] and "posta.it" not in got[1]
    assert "PROVA" not in got[2] and "alfa" not in got[2] and got[2].endswith("e prova.")  # aliases keep to their case
    back = api.restore(done.texts, done.mapping)
    assert {r.doc_id: r.restored for r in back.collect()} == dict(DOCS)
    assert api.verify(done.texts, done.mapping, glossary).count() == 0
    leaks = api.verify(docs.withColumnRenamed("text", "masked"), done.mapping, glossary).collect()
    assert any(r.reason.startswith("known value [") for r in leaks)
    again = api.anonymize(docs, done.mapping, rules=(BY_SOURCE["email"], BY_SOURCE["title-name"]))
    assert set(map(tuple, done.mapping.collect())) <= set(map(tuple, again.mapping.collect()))  # stored numbers stay


def test_allowlist_and_exclusions(spark):
    docs = spark.createDataFrame([(1, "a.b@x.it c.d@x.it e.f@x.it")], "doc_id long, text string")
    allow = spark.createDataFrame([("A.B@X.IT",)], "value string")
    out = api.anonymize(docs, allowlist=allow, exclude=["c.d@x.it"], rules=(BY_SOURCE["email"],)).texts.first().masked
    assert out == "a.b@x.it c.d@x.it [EMAIL_1]"


def test_columns(spark):
    rows = spark.createDataFrame([("  Prova ", "PERSON"), ("x", "PERSON"), ("Alfa", None)], "t string, k string")
    got = [r.s for r in rows.select(lookup.column_spans(F.col("t"), F.col("k")).alias("s")).collect()]
    assert [[(s.start, s.end, s.text, s.case_sensitive) for s in x] for x in got] == [[(2, 7, "Prova", True)], [], []]


def test_occurrences_equal_search_of_all(spark):
    bodies = [(i, f"alfa {i % 3} beta gamma{i} alfa beta {i}") for i in range(40)]
    values = ["alfa beta", "beta", "gamma7", "alfa 2 beta", "delta"]
    needles = spark.createDataFrame([(v, "ALTRO", "glossary", 90, False) for v in values], lookup.NEEDLES)
    got = {(r.doc_id, s.start, s.text) for r in lookup.occurrences(spark.createDataFrame(bodies, "doc_id long, text string"), needles).collect() for s in r.found}
    assert got == {(i, a, t[a:b]) for i, t in bodies for v in values for a, b in Searched(t).places_of(v, False)}


def test_decoding(tmp_path, spark):
    assert texts.decode("è".encode("utf-16")) == {"text": "è", "bom": False, "error": None}
    assert texts.decode("è".encode("utf-8-sig"))["bom"] and texts.decode("è".encode("cp1252"))["text"] == "è"
    assert texts.decode(b"\xff\xfea")["error"] and texts.decode(b"a\r\n")["text"] == "a\r\n"
    for name in ("a.txt", "b.md", "old.anon.txt", "notes.doc", ".hidden.txt"):
        (tmp_path / name).write_bytes("è".encode("utf-8-sig"))
    rows = {r.path.rsplit("/", 1)[1]: r.status for r in texts.scan(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "ready", "b.md": "ready", "notes.doc": "skipped"}
    read = texts.read_texts(spark, str(tmp_path))
    out = read.select(texts.output_name(F.col("path"), "anon").alias("name"), texts.encoded(F.col("text"), F.col("bom")).alias("content"))
    assert {r.name for r in texts.write_files(out, str(tmp_path / "out")).collect()} == {"a.anon.txt", "b.anon.md"}
    assert (tmp_path / "out" / "a.anon.txt").read_bytes() == (tmp_path / "a.txt").read_bytes()
    with pytest.raises(Exception, match="no plain file name"):
        texts.write_files(spark.createDataFrame([("../x.txt", b"x")], "name string, content binary"), str(tmp_path / "out")).collect()
    assert not (tmp_path / "x.txt").exists()


def test_store(tmp_path, spark):
    path = (tmp_path / "store").as_uri()
    store = Store.create(spark, path, "segreto", SMALL_KDF)
    mapping = spark.createDataFrame([("EMAIL", 1, "a@b.it", False)], "kind string, number bigint, value string, case_sensitive boolean")
    store.save(mapping=mapping)
    assert store.table("mapping").collect() == mapping.collect() and store.table("allowlist").count() == 0
    assert b"a@b.it" not in b"".join(p.read_bytes() for p in (tmp_path / "store").rglob("*") if p.is_file())
    with pytest.raises(WrongPassword):
        Store.open(spark, path, "altro")
    store.rekey("nuovo", SMALL_KDF)
    assert Store.open(spark, path, "nuovo").table("mapping").collect() == mapping.collect()
    with pytest.raises(WrongPassword):
        Store.open(spark, path, "segreto")
    for bad in ({"n": 1 << 25, "r": 8, "p": 1}, {"n": 1000, "r": 8, "p": 1}, {"n": True, "r": 8, "p": 1}, {"n": 1024}):
        with pytest.raises(StoreError):
            check_kdf(bad)


def test_stream(tmp_path, spark):
    source = tmp_path / "in"
    rules = (BY_SOURCE["email"],)
    spark.createDataFrame([(1, "x a@b.it")], "doc_id long, text string").coalesce(1).write.parquet(str(source))
    for turn in range(2):
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        writer = streaming.mask_stream(stream, str(tmp_path / "mapping"), str(tmp_path / "out"), rules)
        writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        if turn == 0:
            spark.createDataFrame([(2, "a@b.it c@d.it")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    got = {r.doc_id: r.masked for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "x [EMAIL_1]", 2: "[EMAIL_1] [EMAIL_2]"}


def test_texts_list_only_keys_that_values_may_have(spark):
    rows = spark.createDataFrame([(i, f"Cliente Nome#{i:06d}, settore comune.") for i in range(3000)], "k long, text string")
    needles = rows.select(F.concat(F.lit("Nome#"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("value"), F.lit("AZIENDA").alias("kind"), F.lit("known-value").alias("source"), F.lit(80).alias("priority"), F.lit(False).alias("case_sensitive"))
    keys = needles.select(lookup.by_batch(lookup._key, "string")("value").alias("_key")).distinct()
    passing = lookup.Passing.of(keys)
    assert passing([r["_key"] for r in keys.collect()]).all()
    listed = rows.select(F.explode(lookup.by_batch(lookup._keys(passing), "array<string>")("text")).alias("key")).groupBy("key").count()
    assert listed.where("count > 1500").count() < 4 and lookup.Passing.of(keys.where("false"))(["nome"]).tolist() == [False]
    got = lookup.occurrences(rows, needles, "k").select("k", F.explode("found").alias("s")).select("k", "s.start", "s.text").collect()
    assert sorted(map(tuple, got)) == [(i, 8, f"Nome#{i:06d}") for i in range(3000)]


def test_patterns_of_many_values_are_made_once():
    values = [f"nome{i} prova" for i in range(2000)]
    first = [pattern_of(v, False) for v in values]
    assert all(a is pattern_of(v, False) for a, v in zip(first, values))
