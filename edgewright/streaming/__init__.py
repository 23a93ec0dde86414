"""Structured Streaming: new measurement files as they arrive.

Analyses are batch plans over whole tables; what a stream can do beforehand is
to keep the long table of values up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

VALUES = "row_id string, replicate int, sample_idx int, grp string, value double"


def value_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Tab-separated files of VALUES that appear under ``path``."""
    return spark.readStream.schema(VALUES).option("sep", "\t").option("maxFilesPerTrigger", files_per_trigger).csv(path)


def append_values(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a Parquet table, exactly once, until no file is left."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
