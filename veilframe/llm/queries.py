"""The operators of this package over their whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import ann, arcwarc, decontam, jaccard, langid, packing, quality, toxicity, urlfilter, wavelet
from veilframe.llm.chars import remainder
from veilframe.llm.tokens import tokenizer_path
from veilframe.session import table

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)
    return wavelet.read_shards(shards)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 3) != 1))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held, "lang_pred", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)


def _known(spark: SparkSession, sf_dir: str, label: str, by: int, held: int) -> DataFrame:
    """The labels that may be learned from."""
    return table(spark, sf_dir, "labels").where(remainder("doc_id", by) != held).select("doc_id", label)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs.where(remainder("doc_id", 3) != 1), _known(spark, sf_dir, "quality", 3, 1))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return quality.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(remainder("doc_id", 4) != 2), _known(spark, sf_dir, "toxic", 4, 2))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_arcwarc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arcwarc.read_pages(arcwarc.convert(arcwarc.write_arc(table(spark, sf_dir, "pages"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_wavelet, op2_langid, op3_ann, op4_jaccard, op5_decontam, op6_packing, op7_quality, op8_urlfilter, op9_toxicity, op10_arcwarc)
    return {f.__name__: f for f in own}


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def oracle_sql() -> dict[str, str]:
    return {
        "op8_urlfilter": rf"""
            WITH parts AS (
                SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
            ), split AS (
                SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM parts
            ), rules(v, h, p) AS (VALUES {_RULES_SQL}), ranked AS (
                SELECT page_id, host, path, h || p AS rule, v,
                       row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS n
                FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            )
            SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, 'allow') AS verdict FROM ranked WHERE n = 1
        """,
        "op10_arcwarc": """
            WITH own AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
            best AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM own)
            SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN kept <> page_id THEN kept END AS refers_to FROM best
        """,
    }
