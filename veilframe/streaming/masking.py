"""Masking of unbounded streams: detection in the stream, numbering batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from veilframe.operators import masking
from veilframe.operators.names import trimmed
from veilframe.operators.resolve import resolve
from veilframe.operators.rules import RULES, Rule, detect
from veilframe.session import stored


def detect_stream(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """A stream with the disjoint ``spans`` of its texts; no state."""
    return docs.withColumn("spans", trimmed(detect(F.col(text), rules))).withColumn("spans", resolve(F.col(text), F.col("spans")))


def mask_stream(docs: DataFrame, mapping_path: str, out_path: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataStreamWriter:
    """Masks each batch and adds its new values to the mapping, a Parquet table partitioned by batch.

    A batch that runs again overwrites what it wrote before and reads only the batches before
    it, so numbers and texts come out the same.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = stored(detect_stream(batch.select(key, text), rules, text), "batch")
        known = spark.createDataFrame([], masking.MAPPING) if number == 0 else spark.read.schema(f"{masking.MAPPING}, batch long").parquet(mapping_path).where(F.col("batch") < number).drop("batch")
        spans = masking.spans_of(found, key)
        grown = stored(masking.number(spans, known, key), "mapping")
        grown.join(known.select("value"), "value", "left_anti").select("kind", "number", "value", "case_sensitive").write.mode("overwrite").parquet(f"{mapping_path}/batch={number}")
        masking.apply(found, grown, key, text).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return docs.writeStream.foreachBatch(run)
