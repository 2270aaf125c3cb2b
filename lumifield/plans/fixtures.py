"""Image tables derived from the given tables, all rows used, by integer arithmetic only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


@lru_cache(maxsize=32)
def _rows(app: str, events: str) -> int:
    """Number of events (from the file footers), asked once per application and table."""
    return SparkSession.active().read.parquet(events).count()


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """One row per pixel position of a square image: every event is a pixel; the last event also
    stands for the positions that complete the square."""
    events = _table(spark, sf, "events", "event_id", "value")
    n = _rows(spark.sparkContext.applicationId, f"{sf}/events.parquet")
    w = math.ceil(math.sqrt(n))
    cores = spark.sparkContext.defaultParallelism
    if n > 50_000 and len(events.inputFiles()) < cores:  # few input splits: share the pixel work out
        events = events.repartition(cores, "event_id")
    p = events.select(
        F.lit(w).cast("long").alias("w"), "event_id",
        F.explode(F.when(F.col("event_id") < n - 1, F.array("event_id")).otherwise(
            F.sequence(F.col("event_id"), F.lit(w * w - 1).cast("long")))).alias("p"),
        F.expr("CAST(floor(value*100) AS BIGINT) % 200").alias("noise"))
    p = p.withColumn("nz", F.when(F.col("p") == F.col("event_id"), F.col("noise")).otherwise(F.lit(0)))
    return (
        p.selectExpr("p div w AS y", "p % w AS x", "nz")
        .selectExpr("y", "x", "nz", "y div 8 AS gy", "x div 8 AS gx")
        .selectExpr("*", "(gy*31 + gx*17) % 7 AS h")
        .selectExpr("*", "(y-(gy*8+3+h%3))*(y-(gy*8+3+h%3)) + (x-(gx*8+3+(h*5)%3))*(x-(gx*8+3+(h*5)%3)) AS d2")
    )


def pixels(
    spark: SparkSession, sf: str, cycles: Sequence[int] = (0, 1, 2), channels: Sequence[int] = (0, 1, 2, 3)
) -> DataFrame:
    """pixels(y, x, cycle, channel, v); channel 0 is brightfield."""
    ks = ",".join(map(str, cycles))
    cs = ",".join(map(str, channels))
    value = """CAST(CASE WHEN channel = 0 THEN 1000 + nz + CASE WHEN h < 6 AND d2 <= 4 THEN 20000 + 500*(4-d2) ELSE 0 END
      ELSE 300 + (nz*channel) % 97 + CASE WHEN h < 6 AND d2 <= 4
        THEN CASE WHEN (gy*3+gx*5+cycle*7+(gy*gx)%4) % 3 = channel-1 THEN 9000 + 100*h
                  WHEN (gy+2*gx+cycle) % 5 = 0 THEN 1500 ELSE 60 END ELSE 0 END END AS BIGINT)"""
    return (
        sites(spark, sf)
        .withColumn("cycle", F.explode(F.expr(f"array({ks})")))
        .withColumn("channel", F.explode(F.expr(f"array({cs})")))
        .selectExpr("y", "x", "cycle", "channel", f"{value} AS v")
    )


def brightfield(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf, [0], [0])


def beads(spark: SparkSession, sf: str) -> DataFrame:
    """beads(bead_id, x, y): lattice centres."""
    return (
        sites(spark, sf).select("gy", "gx", "h").distinct().where("h < 6")
        .selectExpr("gy*1000000+gx AS bead_id", "gx*8+3+(h*5)%3 AS x", "gy*8+3+h%3 AS y")
    )


def protein_pixels(spark: SparkSession, sf: str) -> DataFrame:
    base = pixels(spark, sf, [0], [1]).selectExpr(
        "y", "x", "cycle", "v", "y div 8 AS gy", "x div 8 AS gx", "((y div 8)*31 + (x div 8)*17) % 7 AS h")
    return base.selectExpr(
        "y", "x", "cycle",
        """CASE WHEN h < 6 AND abs(y-(gy*8+3+h%3)) <= 2 AND abs(x-(gx*8+3+(h*5)%3)) <= 2
             THEN 5300 + 100*h ELSE CASE WHEN (y div 24 + x div 24) % 2 = 0 THEN 14000 ELSE 1500 END END + v % 200 AS v""")


def cell_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Cell label image: label 0 is background, labels have gaps."""
    return sites(spark, sf).selectExpr(
        "CASE WHEN y % 24 >= 2 AND x % 24 >= 2 THEN (y div 24)*1000000 + x div 24 + 1 ELSE 0 END AS label", "y", "x")


def color_code(spark: SparkSession, sf: str) -> DataFrame:
    """color_code(protein, cy0, cy1, cy2): the code words that occur among the parts."""
    return (
        _table(spark, sf, "part", "p_partkey", "p_name", "p_size")
        .selectExpr("CAST(p_partkey % 3 AS INT) AS cy0", "p_size % 3 AS cy1", "length(p_name) % 3 AS cy2")
        .where("NOT (cy0 = 2 AND cy1 = 2)").distinct()
        .selectExpr("concat('P', cy0, cy1, cy2) AS protein", "cy0", "cy1", "cy2")
    )


def color_code_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The colour code as typed into a sheet: one row per part, some rows blank, one column blank."""
    blank = "(p_partkey % 7 = 3)"
    return _table(spark, sf, "part", "p_partkey", "p_name", "p_size").selectExpr(
        f"CASE WHEN {blank} THEN NULL ELSE concat(p_name, ' ', p_partkey) END AS protein",
        f"CASE WHEN {blank} THEN NULL ELSE CAST(p_partkey % 3 AS INT) END AS cy0",
        "CAST(NULL AS INT) AS notes",
        f"CASE WHEN {blank} OR p_size % 5 = 0 THEN NULL ELSE p_size % 3 END AS cy1",
        f"CASE WHEN {blank} THEN NULL ELSE length(p_name) % 3 END AS cy2")


def moving_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Brightfield moved by a known shift in each tile of a 4 x 4 grid; tile_i follows x."""
    f = brightfield(spark, sf)
    w = f.agg((F.max("y") + 1).alias("w")).scalar()
    t = f.select("y", "x", w.alias("w")).selectExpr(
        "y", "x", "x*4 div w AS tile_i", "y*4 div w AS tile_j",
        "y - ((y*4 div w) % 3 - 1) AS fy", "x - ((x*4 div w) % 3 - 1) AS fx")
    src = f.selectExpr("y AS fy", "x AS fx", "v")
    return t.join(src, ["fy", "fx"]).select("y", "x", "tile_i", "tile_j", "v")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """File catalogue derived from the orders: four files per slide, one of them the reference."""
    return _table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").selectExpr(
        "concat('/d/s', o_orderkey div 4, '/', substr(o_orderpriority, 1, 1), 'c', o_orderkey % 4,"
        " CASE WHEN o_custkey % 3 = 0 THEN '.tiff' ELSE '.ome.tif' END) AS path",
        "o_orderkey div 4 AS slide",
        "CAST(CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 4 END AS INT) AS n_channels",
        "CAST(o_custkey % 5 AS INT) AS reference_channel",
        "o_orderkey % 4 = (o_orderkey div 4) % 4 AS is_reference",
        "CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 3 ELSE 0 END AS INT) AS working_ndim",
        "CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE 'changed_' END AS prefix",
        "CAST(90 + o_custkey % 11 AS INT) AS max_size")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Paths as two loads of a folder would list them: sub-folders and other endings included."""
    once = _table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").selectExpr(
        "concat('/d/', CASE WHEN o_custkey % 4 = 0 THEN 'sub/' ELSE '' END, 'c', o_orderkey, CASE o_custkey % 5"
        " WHEN 0 THEN '.TIF' WHEN 1 THEN '.tiff' WHEN 2 THEN '.ome.tif' WHEN 3 THEN '.png' ELSE '.tif.bak' END) AS path",
        "o_orderstatus = 'F' AS seen")
    return once.unionAll(once)


def stack_files(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue of the image's cycles: cycle 1 has a 2-D working image, cycle 2 a 3-D one."""
    return pixels(spark, sf, channels=[0]).groupBy("cycle").agg(F.max("y").alias("last")).selectExpr(
        "cycle", "concat('/d/c', cycle, '.ome.tif') AS path", "0 AS reference_channel", "cycle + (CASE WHEN cycle > 0 THEN 1 ELSE 0 END) AS working_ndim",
        "CASE WHEN cycle = 1 THEN '' ELSE 'changed_' END AS prefix", "CAST(last - 8 * cycle AS INT) AS max_size")


def working_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Working images of cycles 1 (reference channel only) and 2 (all channels)."""
    return pixels(spark, sf, [1], [0]).unionByName(pixels(spark, sf, [2])).selectExpr(
        "y", "x", "cycle", "channel", "v div 2 + 7 AS v")


def moving_stack(spark: SparkSession, sf: str) -> DataFrame:
    """All channels of cycle 0, moved tile by tile as :func:`moving_pixels`; uncovered positions are 0."""
    f = pixels(spark, sf, [0])
    w = f.where("channel = 0").agg((F.max("y") + 1).alias("w")).scalar()
    t = f.select("y", "x", "cycle", "channel", w.alias("w")).selectExpr(
        "y", "x", "cycle", "channel",
        "y - ((y*4 div w) % 3 - 1) AS fy", "x - ((x*4 div w) % 3 - 1) AS fx")
    src = f.selectExpr("channel", "y AS fy", "x AS fx", "v")
    return t.join(src, ["channel", "fy", "fx"], "left").select(
        "y", "x", "cycle", "channel", F.coalesce("v", F.lit(0)).alias("v"))


def descriptors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(fixed, moving) descriptor vectors per label: the given vectors, and the same ones disturbed."""
    e = _table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    fixed = e.select("label", F.col("vec_id").alias("c_id"), F.col("embedding").cast("array<double>").alias("c_vec"))
    bent = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: v + 0.1 * ((F.col("vec_id") + i) % 5 - 2))
    return fixed, e.select("label", F.col("vec_id").alias("q_id"), bent.alias("q_vec"))


def point_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Point pairs per 40-pixel tile under a known affine map, one in nine far off."""
    return beads(spark, sf).selectExpr(
        "(y div 40)*1000000 + x div 40 AS tile_id", "bead_id", "x", "y",
        "1.01*x - 0.02*y + 3 + (bead_id % 7)/100D + CASE WHEN bead_id % 9 = 4 THEN 25 ELSE 0 END AS u",
        "0.03*x + 0.98*y - 2 + (bead_id % 5)/100D AS v")
