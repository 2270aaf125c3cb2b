"""Bead and cell tables in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumifield.functions.constants import NO_CALL


def bead_schema(n_cycles: int) -> T.StructType:
    """x, y, cy0.., bbox."""
    ints = ["x", "y", *[f"cy{k}" for k in range(n_cycles)]]
    return T.StructType([*[T.StructField(c, T.IntegerType()) for c in ints], T.StructField("bbox", T.StringType())])


def bead_rows(beads: DataFrame, n_cycles: int, by: Sequence[str] = ()) -> DataFrame:
    """Bead table in its file layout: no key but ``by`` (the slide, where a table has several), missing calls as the
    sentinel, box as text."""
    calls = [F.coalesce(F.col(f"cy{k}"), F.lit(NO_CALL)).cast("int").alias(f"cy{k}") for k in range(n_cycles)]
    return beads.select(*by, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *calls, "bbox")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """csv or parquet by the ending; any other ending becomes <path>.csv. Returns the path written.

    A table is written as a folder of part files, one per task.
    """
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
        return path
    if not path.endswith(".csv"):
        path = f"{path}.csv"
    df.write.mode(mode).option("header", True).csv(path)
    return path


def read_beads(spark: SparkSession, path: str, n_cycles: int, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(beads without the box, box column with the same key: by, x, y); ``by`` are text columns before x."""
    keys = T.StructType([T.StructField(c, T.StringType()) for c in by])
    df = spark.read.schema(T.StructType([*keys.fields, *bead_schema(n_cycles).fields])).option("header", True).csv(path)
    return split_bbox(df, by)


def split_bbox(df: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    return df.drop("bbox"), df.select(*by, "x", "y", "bbox")


def bead_lines(beads: DataFrame, n_cycles: int) -> DataFrame:
    """Bead table as csv text lines (column ``line``)."""
    return beads.select(F.to_csv(F.struct(*bead_schema(n_cycles).fieldNames())).alias("line"))


def parse_bead_lines(lines: DataFrame, n_cycles: int) -> DataFrame:
    return lines.select(F.from_csv("line", bead_schema(n_cycles).simpleString()[7:-1].replace(":", " ")).alias("b")).select("b.*")
