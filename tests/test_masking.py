import pytest
from pyspark.sql import functions as F

from veilframe.functions.spans import spliced
from veilframe.operators import masking
from veilframe.operators.rules import BY_SOURCE

RULES = (BY_SOURCE["email"], BY_SOURCE["phone-intl"])
TEXTS = [(1, "da a.b@x.it a c.d@x.it, tel +44 20 7946 0958"), (2, "ancora a.b@x.it"), (3, None), (4, "niente")]


def test_mask_and_restore(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    found = masking.find(docs, RULES)
    mapping = masking.number(masking.spans_of(found))
    assert {(r.kind, r.number, r.value) for r in mapping.collect()} == {("EMAIL", 1, "a.b@x.it"), ("EMAIL", 2, "c.d@x.it"), ("TELEFONO", 1, "+44 20 7946 0958")}
    masked = masking.apply(found, mapping)
    assert {r.doc_id: r.masked for r in masked.collect()} == {1: "da [EMAIL_1] a [EMAIL_2], tel [TELEFONO_1]", 2: "ancora [EMAIL_1]", 3: None, 4: "niente"}
    back = masking.restore(masked, mapping)
    assert {r.doc_id: r.restored for r in back.collect()} == dict(TEXTS)
    assert masking.leaks(masked).count() == 0
    assert masking.leaks(docs.withColumnRenamed("text", "masked")).count() == 4


def test_numbers_go_on(spark):
    mapping = spark.createDataFrame([("EMAIL", 7, "a.b@x.it", False)], masking.MAPPING)
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string")
    got = masking.number(masking.spans_of(masking.find(docs, (BY_SOURCE["email"],))), mapping)
    assert {(r.number, r.value) for r in got.collect()} == {(7, "a.b@x.it"), (8, "c.d@x.it")}


def test_rewritten_placeholders(spark):
    cases = {r"\[EMAIL\_1\]": "[EMAIL_1]", "(email 1)": "[EMAIL_1]", "EMAIL_1": "[EMAIL_1]", "[EMAIL_1": "[EMAIL_1]", "email_1": None, "EMAIL_1x": None, "[EMAIL_000123]": "[EMAIL_123]"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", masking.references(F.col("t")).alias("r")).collect()
    got = {row.t: (f"[{row.r[0].kind}_{row.r[0].number}]" if row.r else None) for row in rows}
    assert got == cases


def test_report(spark):
    mapping = spark.createDataFrame([("EMAIL", 1, "a@b.it", False)], masking.MAPPING)
    docs = spark.createDataFrame([(1, "(email 1) e [EMAIL_9]")], "doc_id int, masked string")
    row = masking.restore(docs, mapping).withColumn("missing", masking.missing(F.array(F.lit("[EMAIL_1]"), F.lit("[EMAIL_2]")), F.col("found"))).first()
    assert (row.restored, list(row.found), [tuple(a) for a in row.altered], list(row.invented), list(row.missing)) == ("a@b.it e [EMAIL_9]", ["[EMAIL_1]"], [("(email 1)", "[EMAIL_1]")], ["[EMAIL_9]"], ["[EMAIL_2]"])


def test_headers_and_allowlist(spark):
    rows = spark.createDataFrame([("Città",), ("E-MAIL ",), (None,)], "t string").select(masking.header_kind(F.col("t")).alias("k")).collect()
    assert [r.k for r in rows] == [None, "EMAIL", None]
    spans = spark.createDataFrame([(1, "Caffè"), (2, "Altro")], "doc_id int, text string")
    allow = spark.createDataFrame([("CAFFE",)], "value string")
    assert [r.doc_id for r in masking.drop_allowed(spans, allow).collect()] == [2]


def test_null_repeated_and_clashing_keys(spark):
    texts = [(None, "a.b@x.it"), (None, "zz"), (1, "zz"), (1, "say c.d@x.it"), (1, "say c.d@x.it"), (2, None), (None, None), (3, "")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    found = masking.find(docs, RULES)
    mapping = masking.number(masking.spans_of(found))
    masked = masking.apply(found, mapping)
    got = sorted(((r.doc_id, r.masked) for r in masked.collect()), key=str)
    place = {r.value: f"[EMAIL_{r.number}]" for r in mapping.collect()}
    assert got == sorted([(i, t if t is None else t.replace("a.b@x.it", place["a.b@x.it"]).replace("c.d@x.it", place["c.d@x.it"])) for i, t in texts], key=str)
    assert masking.leaks(masked).count() == 0 and masking.leaks(docs.withColumnRenamed("text", "masked")).count() == 3
    back = masking.restore(masked, mapping)
    assert sorted(((r.doc_id, r.restored) for r in back.collect()), key=str) == sorted(texts, key=str)


def test_overlapping_edits_are_refused():
    assert spliced("abcdef", [(4, 6, "Z"), (0, 2, "Y")]) == "YcdZ"
    with pytest.raises(ValueError):
        spliced("abcdef", [(0, 3, "Y"), (2, 4, "Z")])


def test_many_matches_of_one_text(spark):
    text = " ".join(f"u{k}@x.it" for k in range(3000))
    found = masking.find(spark.createDataFrame([(1, text)], "doc_id int, text string"), (BY_SOURCE["email"],))
    rows = masking.spans_of(found).collect()
    assert len(rows) == 3000 and all(text[r.start : r.end] == r.text for r in rows)
