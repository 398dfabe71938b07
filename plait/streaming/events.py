"""The same filter and aggregate plans over a stream of files: event-time
windows with a watermark. An addition; the batch surface doesn't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Count and sum by key and window of event time; rows later than `late` are dropped.
    ts may be a timestamp without zone."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    got = timed.groupBy(F.window("__ts", size).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "total")
