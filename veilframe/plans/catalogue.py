"""Queries by name over the driver's tables, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import checksums, spans
from veilframe import api
from veilframe.operators import lookup, masking, names, resolve
from veilframe.operators.rules import BY_SOURCE, RULES, detect
from veilframe.session import spread, table

CONTACTS = (BY_SOURCE["email"], BY_SOURCE["phone-intl"])
EMAIL = (BY_SOURCE["email"],)


def _values(spark: SparkSession, sf_dir: str, rules, tab: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return masking.spans_of(masking.find(spread(table(spark, sf_dir, tab).select(key, text)), rules, text), key)


def emails_in_documents(spark, sf_dir):
    return _values(spark, sf_dir, EMAIL).select("doc_id", F.col("text").alias("value"))


def intl_phones_in_documents(spark, sf_dir):
    return _values(spark, sf_dir, (BY_SOURCE["phone-intl"],)).select("doc_id", F.col("text").alias("value"))


def urls_in_pages(spark, sf_dir):
    return _values(spark, sf_dir, (BY_SOURCE["url"],), "pages", "page_id", "html").select("page_id", F.col("text").alias("value"))


def email_spans_offsets(spark, sf_dir):
    return _values(spark, sf_dir, EMAIL).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.col("text").alias("value"))


def placeholder_numbering(spark, sf_dir):
    return masking.number(_values(spark, sf_dir, EMAIL)).select("kind", "number", "value")


def placeholder_counts(spark, sf_dir):
    found = _values(spark, sf_dir, EMAIL)
    mapping = masking.number(found)
    named = found.select(F.col("text").alias("value")).join(mapping, "value")
    return named.groupBy(masking.placeholder(F.col("kind"), F.col("number")).alias("placeholder")).agg(F.count("*").alias("n"))


def _masked(spark, sf_dir, rules):
    docs = masking.rows_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = docs.withColumn("spans", detect(F.col("text"), rules))
    if len(rules) > 1:
        found = found.withColumn("spans", resolve.resolve(F.col("text"), F.col("spans")))
    found = masking.stored(found, "found")
    mapping = masking.stored(masking.number(masking.spans_of(found)), "mapping")
    return docs, mapping, masking.apply(found, mapping)


def mask_contacts(spark, sf_dir):
    return _masked(spark, sf_dir, CONTACTS)[2]


def mask_emails(spark, sf_dir):
    return _masked(spark, sf_dir, EMAIL)[2]


def restore_roundtrip(spark, sf_dir):
    _, mapping, masked = _masked(spark, sf_dir, CONTACTS)
    return masking.restore(masked, mapping).select("doc_id", F.col("restored").alias("text"))


def leaks_after_masking(spark, sf_dir):
    _, _, masked = _masked(spark, sf_dir, CONTACTS)
    return masking.leaks(masked).select("doc_id", F.col("start").alias("start_at"), F.col("text").alias("value"), "reason")


def vat_checksum(spark, sf_dir):
    value = F.lpad(F.col("o_orderkey").cast("string"), 11, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), checksums.is_vat(value).alias("valid"))


def iban_checksum(spark, sf_dir):
    bban = F.lpad(F.col("c_custkey").cast("string"), 18, "0")
    digits = checksums.iban_check_digits(F.lit("DE"), bban)
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("DE"), digits, bban).alias("iban"), checksums.is_iban(F.concat(F.lit("DE00"), bban)).alias("valid_zero"))


def cf_checksum(spark, sf_dir):
    base = F.concat(F.lit("RSSMRA"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("A"), F.lpad((F.col("c_custkey") % 31).cast("string"), 2, "0"), F.lit("H"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(base, checksums.cf_check_letter(base)).alias("code"))


def labeled_ids(spark, sf_dir):
    text = F.concat(F.lit("Fattura, Partita IVA: "), F.lpad(F.col("o_orderkey").cast("string"), 11, "0"), F.lit("; VAT No. AB"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    rules = tuple(BY_SOURCE[k] for k in ("piva", "piva-labeled", "vat-labeled"))
    return masking.spans_of(masking.find(rows, rules), "o_orderkey").select("o_orderkey", "source", F.col("start").alias("start_at"), F.col("text").alias("value"))


def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(spans.fold(F.col("text"))).alias("folded"))


def column_header_kinds(spark, sf_dir):
    titles = [("Nome",), ("COGNOME ",), ("E-mail",), ("P. IVA",), ("Ragione sociale",), ("Importo",), ("Phone number",), ("Indirizzo",)]
    return spark.createDataFrame(titles, "title string").select("title", masking.header_kind(F.col("title")).alias("kind"))


def review_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return masking.review_groups(masking.find(docs, EMAIL)).select("kind", "text", "count")


def all_rules_in_documents(spark, sf_dir):
    return _values(spark, sf_dir, RULES).groupBy("kind", "source").agg(F.count("*").alias("n"))


def _customers(spark, sf_dir):
    text = F.concat(F.lit("Cliente "), "c_name", F.lit(", settore "), F.lower("c_mktsegment"), F.lit("."))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), "c_name", "c_mktsegment")


def _places(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, F.explode("found").alias("s")).select(key, F.col("s.kind").alias("kind"), F.col("s.source").alias("source"), F.col("s.start").alias("start_at"), F.col("s.text").alias("value"))


def glossary_spans(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    glossary = rows.select(F.col("c_mktsegment").alias("term"), F.lit("ALTRO").alias("kind"), F.expr("cast(array() as array<string>)").alias("aliases")).distinct()
    return _places(lookup.occurrences(rows, lookup.glossary_needles(glossary), "c_custkey"), "c_custkey")


def known_value_spans(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    mapping = rows.select(F.lit("AZIENDA").alias("kind"), F.col("c_custkey").alias("number"), F.upper("c_name").alias("value"), F.lit(False).alias("case_sensitive"))
    nothing = masking.spans_of(rows.select("c_custkey", F.expr(spans.NONE).alias("spans")), "c_custkey")
    return _places(lookup.occurrences(rows, lookup.known_needles(nothing, mapping, "c_custkey"), "c_custkey"), "c_custkey")


def column_cell_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", lookup.column_spans(F.concat(F.lit("  "), "c_name", F.lit(" ")), F.lit("AZIENDA")).alias("found"))
    return _places(rows, "c_custkey")


def first_name_spans(spark, sf_dir):
    letter = F.char(97 + F.col("s_suppkey") % 26)
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("scrive Mario Verdin"), letter, F.lit(" oggi"))).otherwise(F.concat(F.lit("scrive Verdin"), letter, F.lit(" Mario, oggi")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", names.name_spans(text).alias("found"))
    return _places(rows, "s_suppkey")


def full_roundtrip(spark, sf_dir):
    """Everything that rules, names and propagation find, masked and put back."""
    done = api.anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return api.restore(done.texts, done.mapping).select("doc_id", F.col("restored").alias("text"))


_N = lambda by, size: f"lpad(CAST(c_custkey % {by} AS STRING), {size}, '0')"
_LETTER = "chr(CAST(97 + c_custkey % 26 AS INT))"
_HOUSE = "CAST(c_custkey % 900 + 1 AS STRING)"
#: A sentence a rule: what stands before the value, the value (the same SQL in both dialects), what follows.
SENTENCES = {
    "cf-labeled": ("C.F. ", f"'ABCDEF12G34H' || {_N(1000, 3)} || 'I'", " fine"),
    "phone": ("chiama ", f"'333 ' || {_N(10000000, 7)}", " ora"),
    "phone-intl-00": ("chiama ", f"'0044 20 ' || {_N(10000, 4)} || ' 0958'", " ora"),
    "phone-labeled": ("Tel: ", f"'02 ' || {_N(10000000, 7)}", " interno"),
    "vat-eu": ("USt ", f"'DE' || {_N(1000000000, 9)}", " ok"),
    "birth-date": ("nata a Pisa il ", f"lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '/04/19' || {_N(100, 2)}", ", residente"),
    "plate": ("targa ", f"'AB ' || {_N(1000, 3)} || ' CD'", " nera"),
    "id-document": ("passaporto n. ", f"'CA' || {_N(100000, 5)} || 'Z'", " valido"),
    "title-name": ("la Dott.ssa ", f"'Lia Prova' || {_LETTER}", " scrive"),
    "labeled-name": ("Referente: ", f"'Ugo Prova' || {_LETTER}", ", ok"),
    "company-suffix": ("presso ", f"'Officine Prova' || {_LETTER} || ' S.r.l.'", " oggi"),
    "institution": ("la ", f"'Fondazione Prova' || {_LETTER}", " chiede"),
    "address": ("in ", f"'Via Garibaldi ' || {_HOUSE} || ', 50100 Firenze'", " oggi"),
    "address-en": ("at ", f"{_HOUSE} || ' Baker Street, London'", " now"),
    "address-de": ("bei ", f"'Hauptstraße ' || {_HOUSE} || ', 10115 Berlin'", " heute"),
    "address-es": ("en ", f"'Calle de Alcalá ' || {_HOUSE}", " hoy"),
    "address-fr": ("au ", f"{_HOUSE} || ' rue de Rivoli'", " ici"),
}


def _sentence(source: str):
    before, value, after = SENTENCES[source]

    def query(spark, sf_dir):
        rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"concat('{before}', {value}, '{after}')").alias("text"))
        found = masking.spans_of(masking.find(rows, (BY_SOURCE[source],)), "c_custkey")
        return found.select("c_custkey", "kind", "source", F.col("start").alias("start_at"), F.col("text").alias("value"))

    return query


def allowlist_filter(spark, sf_dir):
    """E-mails but for those that a document with an even id holds, listed in capitals."""
    found = _values(spark, sf_dir, EMAIL)
    listed = found.where("doc_id % 2 = 0").select(F.upper("text").alias("value"))
    return masking.drop_allowed(found, listed).select("doc_id", F.col("text").alias("value"))


def aliases_from_handles(spark, sf_dir):
    mails = table(spark, sf_dir, "customer").select(F.lit("EMAIL").alias("kind"), F.concat(F.lower("c_mktsegment"), F.lit(".prova"), F.col("c_custkey").cast("string"), F.lit("@posta.it")).alias("text"))
    return lookup.alias_needles(mails).select("kind", "source", "value")


def dry_run_counts(spark, sf_dir):
    """What would be masked: every value with its number of places and documents."""
    found = _values(spark, sf_dir, EMAIL)
    return found.groupBy("kind", F.col("text").alias("value")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def masked_totals(spark, sf_dir):
    """Places and different values that would be masked in every document."""
    return masking.totals(masking.find(table(spark, sf_dir, "documents").select("doc_id", "text"), EMAIL))


def placeholders_of_texts(spark, sf_dir):
    """The placeholders of texts that hold one twice, one rewritten and one cut in half."""
    text = F.expr("concat('[EMAIL_', c_custkey, '] (email ', c_custkey, ') [CF_7 x ', '\\\\[URL\\\\_', c_custkey, '\\\\]')")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(masking.placeholders_in(text), " ").alias("placeholders"))


def restore_report(spark, sf_dir):
    """Texts with a written, a rewritten and an invented placeholder, put back and accounted for."""
    rows = table(spark, sf_dir, "customer")
    mapping = rows.select(F.lit("AZIENDA").alias("kind"), F.col("c_custkey").alias("number"), F.col("c_name").alias("value"), F.lit(False).alias("case_sensitive"))
    edited = rows.select("c_custkey", F.expr("concat('[AZIENDA_', c_custkey, '] e (azienda ', c_custkey, ') e [EMAIL_', c_custkey, ']')").alias("masked"))
    out = masking.restore(edited, mapping, "c_custkey")
    return out.select("c_custkey", "restored", F.size("found").alias("found"), F.size("altered").alias("altered"), F.get("invented", F.lit(0)).alias("invented"))


OWN = (
    emails_in_documents, intl_phones_in_documents, urls_in_pages, email_spans_offsets, placeholder_numbering, placeholder_counts, mask_contacts, mask_emails, restore_roundtrip,
    leaks_after_masking, vat_checksum, iban_checksum, cf_checksum, labeled_ids, fold_text, column_header_kinds, review_groups, all_rules_in_documents,
    glossary_spans, known_value_spans, column_cell_spans, first_name_spans, full_roundtrip, allowlist_filter, aliases_from_handles, dry_run_counts, restore_report, masked_totals, placeholders_of_texts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OWN} | {f"rule_{k.replace('-', '_')}": _sentence(k) for k in SENTENCES}


_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
_SPANS = rf"""
    gaps AS (SELECT doc_id, text, regexp_extract_all(text, '{_MAIL}') AS m, string_split_regex(text, '{_MAIL}') AS g FROM documents WHERE contains(text, '@')),
    spans AS (
        SELECT doc_id, i, m[i] AS value,
               CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start_at
        FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM gaps)
    ),
    mapping AS (SELECT value, row_number() OVER (ORDER BY doc_id, start_at) AS number FROM (SELECT value, min((doc_id, start_at)) AS f, f[1] AS doc_id, f[2] AS start_at FROM spans GROUP BY value))
"""


def _mod97(digits: str) -> str:
    """Remainder of a string of digits, in blocks that fit a big integer."""
    return f"(CAST({digits} AS HUGEINT) % 97)"


def oracle_sql() -> dict[str, str]:
    odd = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
    place = "position(substr(base, CAST(i AS BIGINT), 1) IN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    rules = {
        f"rule_{k.replace('-', '_')}": f"SELECT c_custkey, '{BY_SOURCE[k].kind}' AS kind, 'rules:{k}' AS source, CAST({len(before)} AS INTEGER) AS start_at, {value} AS value FROM customer"
        for k, (before, value, _) in SENTENCES.items()
    }
    return rules | {
        "allowlist_filter": f"WITH {_SPANS} SELECT doc_id, value FROM spans WHERE lower(value) NOT IN (SELECT lower(value) FROM spans WHERE doc_id % 2 = 0)",
        "aliases_from_handles": """
            WITH words AS (SELECT DISTINCT lower(c_mktsegment) AS w FROM customer UNION SELECT 'prova' FROM customer)
            SELECT 'PERSON' AS kind, 'person-alias' AS source, unnest([upper(w[1]) || w[2:], upper(w)]) AS value FROM words""",
        "dry_run_counts": f"WITH {_SPANS} SELECT 'EMAIL' AS kind, value, count(*) AS n, count(DISTINCT doc_id) AS documents FROM spans GROUP BY value",
        "masked_totals": f"""WITH {_SPANS}, n AS (SELECT doc_id, count(*) AS m, count(DISTINCT value) AS v FROM spans GROUP BY doc_id)
            SELECT d.doc_id, CAST(coalesce(m, 0) AS INTEGER) AS masked, CAST(coalesce(v, 0) AS INTEGER) AS "distinct" FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
        "placeholders_of_texts": "SELECT c_custkey, '[EMAIL_' || c_custkey || '] [CF_7] [URL_' || c_custkey || ']' AS placeholders FROM customer",
        "restore_report": """
            SELECT c_custkey, c_name || ' e ' || c_name || ' e [EMAIL_' || c_custkey || ']' AS restored, CAST(2 AS INTEGER) AS found, CAST(1 AS INTEGER) AS altered, '[EMAIL_' || c_custkey || ']' AS invented
            FROM customer""",
        "emails_in_documents": f"SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS value FROM documents",
        "intl_phones_in_documents": r"""
            SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_.,/+\-])(\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,5})', 1)) AS value FROM documents)
            WHERE NOT regexp_matches(value, '^\+39[ .\-]?\d') AND length(regexp_replace(value, '\D', '', 'g')) BETWEEN 9 AND 15""",
        "urls_in_pages": r"""
            SELECT page_id, rtrim(value, '.,;:!?"''') AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:^|[^\p{L}\p{N}_@.])((?i:https?://|www\.)[^\s<>()\[\]]+)', 1)) AS value FROM pages)""",
        "email_spans_offsets": f"WITH {_SPANS} SELECT doc_id, start_at, CAST(start_at + length(value) AS INTEGER) AS end_at, value FROM spans",
        "placeholder_numbering": f"WITH {_SPANS} SELECT 'EMAIL' AS kind, number, value FROM mapping",
        "placeholder_counts": f"WITH {_SPANS} SELECT '[EMAIL_' || number || ']' AS placeholder, count(*) AS n FROM spans JOIN mapping USING (value) GROUP BY number",
        "mask_emails": f"""WITH {_SPANS},
            parts AS (SELECT s.doc_id, string_agg(g.g[s.i] || '[EMAIL_' || number || ']', '' ORDER BY s.i) || any_value(g.g[len(g.g)]) AS masked
                      FROM spans s JOIN mapping USING (value) JOIN gaps g ON g.doc_id = s.doc_id GROUP BY s.doc_id)
            SELECT d.doc_id, coalesce(masked, text) AS masked FROM documents d LEFT JOIN parts p ON p.doc_id = d.doc_id""",
        "restore_roundtrip": "SELECT doc_id, text FROM documents",
        "vat_checksum": """
            WITH own AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 11, '0') AS value FROM orders)
            SELECT o_orderkey, value, list_sum(list_transform(range(1, 12), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(value, i, 1) AS INTEGER)
                ELSE CAST(substr(value, i, 1) AS INTEGER) * 2 - CASE WHEN substr(value, i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0 AS valid FROM own""",
        "iban_checksum": f"""
            WITH own AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 18, '0') AS b FROM customer)
            SELECT c_custkey, 'DE' || lpad(CAST(98 - {_mod97("b || '131400'")} AS VARCHAR), 2, '0') || b AS iban, {_mod97("b || '131400'")} = 1 AS valid_zero FROM own""",
        "cf_checksum": f"""
            WITH own AS (SELECT c_custkey, 'RSSMRA' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || 'A' || lpad(CAST(c_custkey % 31 AS VARCHAR), 2, '0') || 'H' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS base FROM customer)
            SELECT c_custkey, base || chr(CAST(65 + list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN ({odd})[{place}]
                ELSE CASE WHEN {place} > 10 THEN {place} - 11 ELSE {place} - 1 END END)) % 26 AS INTEGER)) AS code FROM own""",
        "labeled_ids": """
            WITH own AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 11, '0') AS v, 'AB' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS w,
                list_sum(list_transform(range(1, 12), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(lpad(CAST(o_orderkey AS VARCHAR), 11, '0'), i, 1) AS INTEGER)
                ELSE CAST(substr(lpad(CAST(o_orderkey AS VARCHAR), 11, '0'), i, 1) AS INTEGER) * 2 - CASE WHEN substr(lpad(CAST(o_orderkey AS VARCHAR), 11, '0'), i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0 AS ok FROM orders)
            SELECT o_orderkey, CASE WHEN ok THEN 'rules:piva' ELSE 'rules:piva-labeled' END AS source, CAST(22 AS INTEGER) AS start_at, v AS value FROM own
            UNION ALL SELECT o_orderkey, 'rules:vat-labeled', CAST(43 AS INTEGER), w FROM own""",
        "fold_text": "SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents",
        "column_header_kinds": """
            SELECT * FROM (VALUES ('Nome', 'PERSON'), ('COGNOME ', 'PERSON'), ('E-mail', 'EMAIL'), ('P. IVA', 'PIVA'), ('Ragione sociale', 'AZIENDA'), ('Importo', NULL),
                ('Phone number', 'TELEFONO'), ('Indirizzo', 'INDIRIZZO')) t(title, kind)""",
        "glossary_spans": "SELECT c_custkey, 'ALTRO' AS kind, 'glossary' AS source, CAST(length(c_name) + 18 AS INTEGER) AS start_at, lower(c_mktsegment) AS value FROM customer",
        "known_value_spans": "SELECT c_custkey, 'AZIENDA' AS kind, 'known-value' AS source, CAST(8 AS INTEGER) AS start_at, c_name AS value FROM customer",
        "column_cell_spans": "SELECT c_custkey, 'AZIENDA' AS kind, 'column-header' AS source, CAST(2 AS INTEGER) AS start_at, c_name AS value FROM customer",
        "first_name_spans": """
            SELECT s_suppkey, 'PERSON' AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'rules:first-name' ELSE 'rules:surname-first' END AS source, CAST(7 AS INTEGER) AS start_at,
                   CASE WHEN s_suppkey % 2 = 0 THEN 'Mario Verdin' || chr(CAST(97 + s_suppkey % 26 AS INTEGER)) ELSE 'Verdin' || chr(CAST(97 + s_suppkey % 26 AS INTEGER)) || ' Mario' END AS value FROM supplier""",
        "full_roundtrip": "SELECT doc_id, text FROM documents",
        "review_groups": f"WITH {_SPANS} SELECT 'EMAIL' AS kind, value AS text, count(*) AS count FROM spans GROUP BY value",
    }
