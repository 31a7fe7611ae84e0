"""The append-only result log fed by a stream: the incremental form of append and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream of (id, cate, ts, data_type)-like rows."""
    return spark.readStream.schema(schema).parquet(folder)


def first_results(stream: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The first result of each key; rows later than the watermark are dropped and the state behind it is freed."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Results per data_type and time window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "data_type").agg(F.count("*").alias("n"))


def append_results(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to the log, one folder per data_type; stops when all input that is there has been read."""
    return stream.writeStream.format("parquet").partitionBy("data_type").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
