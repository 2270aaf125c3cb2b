"""Exact statistics that pre-aggregate before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.lookup import attach
from lumifield.functions.storage import store


def histogram(px: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    """Value counts of each plane: at most 65,536 rows per plane for 8- and 16-bit samples."""
    return px.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def percentiles(px: DataFrame, by: Sequence[str], value: str, pct: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles of each plane, computed on the plane's histogram."""
    probs = F.array(*[F.lit(p / 100.0) for p in pct.values()])
    agg = histogram(px, by, value).groupBy(*by).agg(F.percentile(value, probs, F.col("n")).alias("_q"))
    return agg.select(*by, *[F.col("_q")[i].alias(k) for i, k in enumerate(pct)])


def value_range(px: DataFrame, by: Sequence[str], value: str = "v") -> DataFrame:
    return px.groupBy(*by).agg(F.min(value).alias("mn"), F.max(value).alias("mx"))


def plane_size(px: DataFrame, by: Sequence[str]) -> DataFrame:
    return px.groupBy(*by).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def grouped_median(rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per group: one aggregate whose state is the counts of the group's distinct values.

    For values of bounded depth (samples and their ratios within one region); a state never outgrows the
    number of different values, and states are combined before the shuffle.
    """
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.median(value).alias(out))


def running_index(
    rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """0-based position inside each group, without sending a group to one task.

    The rows are range-sorted over the cluster and written once; each row then carries its
    position in its partition, and the (few) per-partition group counts give the offsets.
    """
    by = list(by)
    ordered = rows.orderBy(*by, *order).withColumn("_row", F.monotonically_increasing_id())
    stored, _ = store(ordered.withColumn("_part", F.spark_partition_id()), "ordered")
    parts = stored.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = attach(stored, offsets, [*by, "_part"], spread_by=("_row",))
    index = F.col("_offset") + F.col("_row") - F.col("_first")
    return joined.withColumn(name, index).drop("_row", "_part", "_first", "_offset")
