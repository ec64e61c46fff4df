import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import checksums
from veilframe.functions.spans import NONE, span, splice, without
from veilframe.operators import masking
from veilframe.operators.resolve import merge_people, resolve, resolve_spans
from veilframe.operators.rules import BY_SOURCE, ODD, detect

CASES = [
    ("email", "scrivi a zeno.prova@posta.example.it, grazie", ["zeno.prova@posta.example.it"]),
    ("phone-intl", "call +44 20 7946 0958 or +39 333 1234567", ["+44 20 7946 0958"]),
    ("phone", "cell. 333 1234567, totale 300.000.000", ["333 1234567"]),
    ("phone-labeled", "Tel: 02 1234567 il 01/02/2024", ["02 1234567"]),
    ("url", "vedi https://prova.example/x?y=1. e github.com/tizio!", ["https://prova.example/x?y=1", "github.com/tizio"]),
    ("cf-labeled", "C.F. ABCDEF12G34H567I fine", ["ABCDEF12G34H567I"]),
    ("piva-labeled", "P. IVA: 12345678901.", ["12345678901"]),
    ("vat-eu", "USt DE123456789 und XDE123456789", ["DE123456789"]),
    ("birth-date", "nata a Pisa il 03/04/1980, residente", ["03/04/1980"]),
    ("plate", "targa AB 123 CD", ["AB 123 CD"]),
    ("id-document", "carta d'identità n. CA12345ZZ", ["CA12345ZZ"]),
    ("title-name", "la Dott.ssa Lia De Prova scrive", ["Lia De Prova"]),
    ("labeled-name", "Referente: Ugo Prova", ["Ugo Prova"]),
    ("company-suffix", "presso Officine Prova S.r.l. oggi", ["Officine Prova S.r.l"]),
    ("institution", "la Fondazione Prova del Sole è", ["Fondazione Prova del Sole"]),
    ("address", "in Via Garibaldi 12, 50100 Firenze (FI)", ["Via Garibaldi 12, 50100 Firenze (FI)"]),
    ("address-en", "at 12 Baker Street, London", ["12 Baker Street, London"]),
    ("address-de", "Hauptstraße 5, 10115 Berlin", ["Hauptstraße 5, 10115 Berlin"]),
    ("address-es", "Calle de Alcalá 20", ["Calle de Alcalá 20"]),
    ("address-fr", "10 rue de Rivoli", ["10 rue de Rivoli"]),
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(CASES)], "i int, text string")
    for i, (source, text, expected) in enumerate(CASES):
        got = rows.where(F.col("i") == i).select(BY_SOURCE[source].spans(F.col("text")).alias("s")).first()["s"]
        assert [text[s["start"] : s["end"]] for s in got] == [s["text"] for s in got]
        assert [s["text"].rstrip(".") for s in got] == expected, source


def test_null_and_empty_text(spark):
    got = spark.createDataFrame([(None,), ("",)], "text string").select(detect(F.col("text")).alias("s")).collect()
    assert [list(r["s"] or []) for r in got] == [[], []]


def test_iban(spark):
    bban = "0542811101000000123456"
    row = spark.range(1).select(checksums.iban_check_digits(F.lit("IT"), F.lit("X" + bban)).alias("d")).first()
    iban = f"IT{row['d']}X{bban}"
    spaced = " ".join(iban[i : i + 4] for i in range(0, 27, 4))
    got = spark.createDataFrame([(f"pago su {spaced} o IT00X{bban}",)], "text string").select(BY_SOURCE["iban"].spans(F.col("text")).alias("s")).first()["s"]
    assert [s["text"] for s in got] == [spaced]


def test_a_wrong_iban_hides_none_behind_it(spark):
    text = "AT12 DE89370400440532013000 e it60 x0542811101000000123456"
    got = spark.createDataFrame([(text,)], "text string").select(BY_SOURCE["iban"].spans(F.col("text")).alias("s")).first()["s"]
    assert [(s["start"], s["text"]) for s in got] == [(5, "DE89370400440532013000"), (30, text[30:])]


def test_vat_and_tax_code(spark):
    row = spark.range(1).select(checksums.is_vat(F.lit("12345678903")), checksums.is_vat(F.lit("12345678904")), checksums.cf_check_letter(F.lit("RSSMRA85T10A562")), checksums.is_cf(F.lit("rssmra85t10a562s"))).first()
    assert tuple(row) == (True, False, "S", True)


def _brute(spans):
    kept, queue = [], list(spans)
    while queue:
        best = min(range(len(queue)), key=lambda i: (-queue[i]["priority"], queue[i]["start"] - queue[i]["end"], queue[i]["start"], i))
        s = queue.pop(best)
        over = sorted((k for k in kept if k["start"] < s["end"] and s["start"] < k["end"]), key=lambda k: k["start"])
        if not over:
            kept.append(s)
            continue
        at = s["start"]
        for k in [*over, {"start": s["end"], "end": s["end"]}]:
            if at < k["start"] and k["start"] - at >= 3:
                queue.append(s | {"start": at, "end": k["start"], "text": s["text"][at - s["start"] : k["start"] - s["start"]]})
            at = max(at, k["end"])
    return sorted((k["start"], k["end"], k["priority"]) for k in kept)


@pytest.mark.parametrize("seed", range(10))
def test_resolution_matches_brute_force(seed):
    r = random.Random(seed)
    text = "x" * 200
    spans = []
    for _ in range(40):
        a = r.randrange(190)
        b = a + r.randint(3, 10)
        spans.append({"start": a, "end": b, "text": text[a:b], "kind": "ALTRO", "priority": r.choice((40, 50, 100)), "reason": "", "source": "s", "case_sensitive": False})
    assert [(s["start"], s["end"], s["priority"]) for s in resolve_spans(spans)] == _brute(spans)


def test_remainder_and_merge():
    text = "Lia Prova di Officine S.r.l."
    person = {"start": 0, "end": len(text), "text": text, "kind": "PERSON", "priority": 40, "reason": "", "source": "a", "case_sensitive": False}
    firm = {"start": 13, "end": 28, "text": text[13:], "kind": "AZIENDA", "priority": 50, "reason": "", "source": "b", "case_sensitive": False}
    assert [s["text"] for s in resolve_spans([person, firm])] == ["Lia Prova", "Officine S.r.l."]
    two = [person | {"start": 0, "end": 3, "text": "Lia"}, person | {"start": 4, "end": 9, "text": "Prova", "source": "c"}]
    assert [(s["text"], s["source"]) for s in merge_people(two, text)] == [("Lia Prova", "a+c")]


def test_splice_counts_code_points(spark):
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("end"), F.lit("[A_1]").alias("text")))
    assert spark.range(1).select(splice(F.lit("😀 x y"), edits)).first()[0] == "😀 [A_1] y"


def test_letters_that_any_case_takes_for_ascii(spark):
    letters = spark.createDataFrame([(chr(i),) for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000], "c string")
    assert {r.c for r in letters.where(F.col("c").rlike("(?iu)[a-z]")).collect()} == set(ODD)
    texts = [("la \u017fig. Ugo Prova", "title-name"), ("TARGA AB 123 CD", "plate"), ("Referente: Ugo Prova", "labeled-name"), ("cod\u0130ce fiscale ABCDEFGHIJKLMNOP", "cf-labeled"), ("V\u0131a Garibaldi 1", "address")]
    for text, source in texts:
        got = spark.createDataFrame([(text,)], "text string").select(BY_SOURCE[source].spans(F.col("text")).alias("s")).first()["s"]
        assert len(got) == 1, (text, source)


def test_spans_are_found_once(spark):
    docs = spark.createDataFrame([(1, "a@b.it"), (2, None), (3, "")], "doc_id int, text string")
    rows = masking.spans_of(masking.find(docs))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z0-9._%+\\-]+@") == masking.find(docs)._jdf.queryExecution().optimizedPlan().toString().count("[A-Za-z0-9._%+\\-]+@")
    assert [r.text for r in rows.collect()] == ["a@b.it"]


def test_only_texts_with_work_reach_a_worker(spark):
    one, two = span(F.lit(0), F.lit("Ugo"), "PERSON", "x", 50), span(F.lit(4), F.lit("Prova"), "PERSON", "x", 50)
    rows = spark.sql("SELECT * FROM VALUES (1, 'Ugo Prova'), (2, 'Ugo Prova'), (3, 'Ugo Prova'), (4, null), (5, 'Ugo Prova') AS t(i, text)")
    rows = rows.withColumn("spans", F.when(F.col("i") == 1, F.array(one, two)).when(F.col("i") == 2, F.array(one)).when(F.col("i") == 3, F.expr(NONE)).when(F.col("i") == 4, F.array(one, two)))
    done = rows.select("i", "text", resolve(F.col("text"), F.col("spans")).alias("s"))
    assert {r.i: [x["text"] for x in r.s] for r in done.collect()} == {1: ["Ugo Prova"], 2: ["Ugo"], 3: [], 4: [], 5: []}
    edits = rows.select("i", splice(F.col("text"), F.transform("spans", lambda s: F.struct(s["start"], s["end"], F.lit("_").alias("text")))).alias("t"))
    assert {r.i: r.t for r in edits.collect()} == {1: "_ _", 2: "_ Prova", 3: "Ugo Prova", 4: None, 5: "Ugo Prova"}
    for plan in (done, edits):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN (size(" in text


def test_without_takes_many_spans_in_one_pass(spark):
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19999)), lambda i: span(i, F.lit("x"), "PERSON", "x", 50)).alias("m"))
    few = F.filter("m", lambda s: s["start"] % 5000 == 0)
    got = many.select("m", few.alias("f")).select(without(F.col("m"), F.col("f")).alias("w"))
    assert "array_append" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.select(F.size("w")).first()[0] == 19996
