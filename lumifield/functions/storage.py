"""Intermediate tables kept in the folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a scratch folder only for local sessions without one."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


_written: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what is stored inside the block when it ends: for jobs whose result is written, counted or collected in it."""
    mark = len(_written)
    try:
        yield
    finally:
        done, _written[mark:] = _written[mark:], []
        for path in done:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def store(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write ``df`` once to the shared folder; return the stored table and its row count.

    The written table cuts the lineage (a lost executor re-reads files instead of re-running the
    plan), and the count comes with the write, so no second job is needed to learn the size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["n"])


def store_observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """As :func:`store`, with further aggregate expressions observed during the write."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    seen = Observation()
    exprs = [e.alias(k) for k, e in metrics.items()]
    df.observe(seen, F.count(F.lit(1)).alias("n"), *exprs).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), dict(seen.get)
