"""Results that arrive as files while runs go on: each seed's row once, and running means by variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arriving_results(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_of_each_seed(rows: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each (variant, seed, metric); state is dropped once the watermark passes."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["variant", "seed", "metric"])


def windowed_means(rows: DataFrame, event_time: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Mean and number of values by variant, metric and window of event time."""
    return rows.withWatermark(event_time, delay).groupBy(F.window(event_time, width), "variant", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
