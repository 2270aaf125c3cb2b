"""Image stacks as partitioned pixel tables: listing, reading, cropping and exporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumifield.functions.constants import TIFF_NAME
from lumifield.functions.lookup import attach, bucket
from lumifield.operators.catalog import with_working_image
from lumifield.schemas import PIXELS, PLANE

TILE = 256  # pixels are clustered by squares of this side, so that crops skip row groups
TASK_ROWS = 16 * TILE * TILE  # pixels that a task sorts and writes, about


def list_stacks(spark: SparkSession, folder: str) -> DataFrame:
    """TIFF files directly in a folder (any case of the ending); file contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][iI][fF]*").load(folder)
    return found.select("path", "modificationTime", "length").where(F.col("path").rlike(TIFF_NAME))


def in_folder(paths: DataFrame, folder: Column | str, column: str = "path") -> DataFrame:
    """TIFF paths at depth 1 of a folder, from any table of paths."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    parent = F.regexp_replace(F.col(column), r"/[^/]*$", "")
    return paths.where((parent == folder) & F.col(column).rlike(TIFF_NAME))


def not_seen(paths: DataFrame, seen: DataFrame, column: str = "path") -> DataFrame:
    """Each path once, leaving out those that were handed on before."""
    return paths.join(seen.select(column), column, "left_anti").dropDuplicates([column])


def stack_info(px: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Channels, height, width, value range and smallest sample type of each stack."""
    info = px.groupBy(*by).agg(
        F.count_distinct("channel").alias("n_channels"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"),
        F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    dtype = F.when((F.col("min_v") >= 0) & (F.col("max_v") <= 255), "uint8").when(
        (F.col("min_v") >= 0) & (F.col("max_v") <= 65535), "uint16").otherwise("int32")
    return info.withColumn("dtype", dtype)


def read_stack(
    spark: SparkSession, path: str, files: Sequence[str] | None = None, cycles: Sequence[int] | None = None,
    channels: Sequence[int] | None = None, max_size: int | None = None,
) -> DataFrame:
    """Stored stacks; the selection reaches the scan as partition filters, the crop as row-group filters."""
    px = spark.read.schema(PIXELS).parquet(path).select(PIXELS.fieldNames())
    for column, wanted in (("file", files), ("cycle", cycles), ("channel", channels)):
        if wanted is not None:
            px = px.where(F.col(column).isin(list(wanted)))
    return px if max_size is None else crop(px, max_size)


def write_stack(px: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store pixels by file, cycle and channel, clustered by square blocks. ``px`` is read three times, as :func:`_clustered` tells."""
    rows = px.select(*[F.col(f.name).cast(f.dataType) for f in PIXELS])
    _clustered(rows, PLANE).write.mode(mode).partitionBy(*PLANE).parquet(path)


def _clustered(rows: DataFrame, planes: Sequence[str]) -> DataFrame:
    """Rows sorted by plane and square block, in as many range partitions as hold about ``TASK_ROWS`` rows each.

    So a task's sort is as large for one huge plane as for many small ones, whatever the size of the data. The rows
    are counted and sampled before they are shuffled: those of a costly plan are better stored first.
    """
    spark = rows.sparkSession
    blocks = [*planes, bucket("y", TILE), bucket("x", TILE)]
    n = max(-(-rows.count() // TASK_ROWS), spark.sparkContext.defaultParallelism)
    return rows.repartitionByRange(n, *blocks).sortWithinPartitions(*blocks, "y", "x")


def crop(px: DataFrame, max_size: int | Column) -> DataFrame:
    return px.where((F.col("y") < max_size) & (F.col("x") < max_size))


def export_name(path: str = "path", prefix: str = "prefix") -> Column:
    """<prefix>_<base name>; the default prefix already ends in an underscore, and keeps it."""
    base = F.element_at(F.split(F.col(path), "/"), -1)
    return F.when(F.coalesce(F.col(prefix), F.lit("")) != "", F.concat(F.col(prefix), F.lit("_"), base)).otherwise(base)


def export_rows(
    px: DataFrame, working: DataFrame, files: DataFrame, image: Sequence[str] = ("file",),
    keep: Sequence[str] = ("axes", "unit", "PhysicalSizeX", "PhysicalSizeY"),
) -> DataFrame:
    """Samples to export: working image applied, cropped, with the output name and metadata columns.

    ``files``: image, path, prefix, max_size, reference_channel, working_ndim and the metadata.
    """
    full = with_working_image(px, working, files, image)
    info = files.select(*image, export_name().alias("out_name"), "max_size", *keep)
    rows = attach(full, info, image)
    return crop(rows, F.col("max_size")).select("out_name", "channel", "y", "x", "v", *keep)


def export_stacks(rows: DataFrame, folder: str) -> None:
    """Write exported samples, one directory per output name and channel."""
    _clustered(rows, ["out_name", "channel"]).write.partitionBy("out_name", "channel").parquet(folder)
