"""What operators need from the session: shared storage, code on the executors."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as a URI.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset (tests, a single
    machine) a temporary folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = Path(tempfile.mkdtemp(prefix="veilframe-")).as_uri()
        spark.sparkContext.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else Path(at).as_uri()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks a core that ``spread`` makes, so that texts of unlike lengths still end together.
TASKS = 3


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, for costly work on each: a file is read by no more tasks than it has row groups."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism)


#: Bytes of an Arrow batch; Spark's own bound is as large as what is left to a worker beside a full heap.
BATCH = 8 << 20
#: The same for operators that run beside a full heap.
SMALL_BATCH = 2 << 20


def ship(spark: SparkSession, batch: int = BATCH) -> None:
    """Sends this package to the executors, once per application, and bounds the bytes of Arrow batches to them.

    The bound is the session's and only ever gets lower, so it holds for later queries as well.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(size).rstrip("b")) > batch:
        spark.conf.set(size, str(batch))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="veilframe-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, os.path.join(root.name, path.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def release() -> None:
    """Gives freed memory back to the system; Arrow and the C library keep it for the process otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def by_batch(run: Callable[..., pd.Series], kind: str) -> Callable[..., Column]:
    """``run`` over the batches of its columns as a pandas function; a worker gives freed memory back after a task."""

    def runs(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        try:
            for columns in batches:
                yield run(*(columns if isinstance(columns, tuple) else (columns,)))
        finally:
            release()

    return F.pandas_udf(runs, kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
