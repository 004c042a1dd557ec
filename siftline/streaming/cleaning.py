"""The same cleaners on streams.

Column cleaners and compiled models hold no state, so they run unchanged on a streaming table.
Duplicate marks need all rows; on a stream, later copies within a watermark are dropped instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.dsl import Model


def read_stream(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return reader.options(header=True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def cleaned_stream(stream: DataFrame, model: Model) -> DataFrame:
    """A model without duplicate marks, on a stream."""
    return model.compile(stream.columns).apply(stream)


def first_seen(stream: DataFrame, keys: Sequence[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the delay before."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def counts_by_window(stream: DataFrame, time_col: str, keys: Sequence[str], width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of keys in tumbling windows."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet", once: bool = True) -> StreamingQuery:
    """Append to files; with once, all there is now and then an end."""
    writer = stream.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
