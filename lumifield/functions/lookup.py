"""Joins against side tables whose size is measured first, and bucketed window joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumifield.functions.storage import store

# A side table of narrow numeric rows is broadcast up to this many rows (about 100 bytes each once
# hashed, so 20 MB); a larger one goes through a shuffle join with the hot keys spread.
BROADCAST_ROWS = 200_000
SPREAD = 16


def attach(
    rows: DataFrame,
    table: DataFrame | tuple[DataFrame, int],
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = ("y", "x"),
    spread: int = SPREAD,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a per-key side table (one row per key) to ``rows``.

    The side table is stored and counted, unless it comes as the pair that ``store`` returns. Small: broadcast, so ``rows`` is not shuffled. Large: a
    shuffle join of two plain tables, whose hot keys adaptive execution splits; where it is switched off, each side row is
    copied ``spread`` times and ``rows`` choose a copy by a hash of ``spread_by``. Without key columns the side is one row, whose values all rows get.
    """
    on = list(on)
    side, n = table if isinstance(table, tuple) else store(table, "side")
    if not on:
        return rows.withColumns({c: side.select(c).scalar() for c in side.columns})
    if n <= max_rows:
        return rows.join(F.broadcast(side), on, how)
    conf = rows.sparkSession.conf
    adaptive = all(conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "skewJoin.enabled"))
    if adaptive or spread <= 1 or not spread_by:
        return rows.join(side, on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(spread)))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def bucket(c: Column | str, size: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(size))


def _by_bucket(copies: DataFrame, cells: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join by bucket in which the samples are never broadcast.

    Spark takes samples that a plan makes from few stored bytes (one row exploded into its cycles and channels) for a small
    table, and would gather all of them in the driver. So the copies are stored and counted, and the count decides: few
    are broadcast, and the samples are not shuffled; many are merged with the samples, bucket by bucket.
    """
    copies, n = store(copies, "copies")
    return F.broadcast(copies).join(cells, on) if n <= BROADCAST_ROWS else copies.join(cells.hint("merge"), on)


def window_join(
    points: DataFrame,
    pixels: DataFrame,
    before: int,
    after: int,
    by: Sequence[str] = (),
    point_cols: Sequence[str] = (),
) -> DataFrame:
    """All pixels in ``[py-before, py+after) x [px-before, px+after)`` of each point ``(py, px)``.

    The range condition becomes an equality on square buckets as wide as the window: a window meets
    at most four of them, so a point is copied up to four times and a pixel never. A bucket is a
    bounded piece of one image (its side squared, times the planes), whatever the size of the data.
    """
    side = max(before + after, 1)
    y0, x0 = F.col("py") - before, F.col("px") - before
    y1, x1 = F.col("py") + after - 1, F.col("px") + after - 1
    spread = (
        points.withColumn("_by", F.explode(F.sequence(bucket(y0, side), bucket(y1, side))))
        .withColumn("_bx", F.explode(F.sequence(bucket(x0, side), bucket(x1, side))))
    )
    cells = pixels.withColumn("_by", bucket("y", side)).withColumn("_bx", bucket("x", side))
    inside = (
        (F.col("y") >= F.col("py") - before)
        & (F.col("y") < F.col("py") + after)
        & (F.col("x") >= F.col("px") - before)
        & (F.col("x") < F.col("px") + after)
    )
    return _by_bucket(spread, cells, [*by, "_by", "_bx"]).where(inside).drop("_by", "_bx")


def box_join(boxes: DataFrame, pixels: DataFrame, by: Sequence[str] = (), side: int = 16) -> DataFrame:
    """All pixels in ``[y0, y1) x [x0, x1)`` of each box, for boxes of any size.

    As :func:`window_join`, with a fixed bucket side: a box is copied once per bucket it meets.
    """
    some = boxes.where((F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0")))
    spread = (
        some.withColumn("_by", F.explode(F.sequence(bucket("y0", side), bucket(F.col("y1") - 1, side))))
        .withColumn("_bx", F.explode(F.sequence(bucket("x0", side), bucket(F.col("x1") - 1, side))))
    )
    cells = pixels.withColumn("_by", bucket("y", side)).withColumn("_bx", bucket("x", side))
    inside = (
        (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    return _by_bucket(spread, cells, [*by, "_by", "_bx"]).where(inside).drop("_by", "_bx")
