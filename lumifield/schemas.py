"""Table layouts. Samples and sums are BIGINT (Spark has no unsigned types), missing values NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PLANE = ("file", "cycle", "channel")

PIXELS = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("cycle", T.IntegerType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("y", T.LongType()),
    T.StructField("x", T.LongType()),
    T.StructField("v", T.LongType()),
])

METADATA_FIELDS = [
    ("axes", "string"), ("unit", "string"), ("PhysicalSizeX", "double"), ("PhysicalSizeY", "double"),
    ("max_size", "int"), ("reference_channel", "int"), ("prefix", "string"), ("overlap", "int"),
    ("num_tiles", "int"),
]


def require(df: DataFrame, *columns: str, name: str = "table") -> DataFrame:
    """Raise when a needed column is missing, before any job starts."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks column(s) {', '.join(missing)}")
    return df
