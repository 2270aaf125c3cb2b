"""New stacks as a stream: each file that lands in a folder is handed on once.

The reference set-up has no time windows or state of its own; the file source's checkpoint keeps
the list of files already seen, which is all that repeated folder loads need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumifield.functions.constants import TIFF_NAME
from lumifield.schemas import PIXELS


def arriving_stacks(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Streaming list of TIFF files of a folder (depth 1): path, modificationTime, length."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("pathGlobFilter", "*.[tT][iI][fF]*").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return found.select("path", "modificationTime", "length").where(F.col("path").rlike(TIFF_NAME))


def arriving_pixels(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Streaming pixel table of stacks that land as parquet."""
    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def record_arrivals(stacks: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a parquet catalogue, once per file, and stop when caught up."""
    return (
        stacks.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(table)
    )
