"""Runs as directories, and scans of their result files.

A run lies at ``<root>/<dataset>/<variant>/<yyyymmdd_hhmmss>[_seedN]/metrics/<file>``; everything about it
is read from its files' paths, which Spark lists, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import keep_latest, latest_run

STAMP = r"/(\d{8}_\d{6})(?:_seed[_-]?(\d+))?/"


def last_number(text: Column, pattern: str) -> Column:
    """The last match of a pattern's first group as int, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1)).try_cast("int")


def path_parts(path: Column) -> dict[str, Column]:
    """variant, timestamp and seed of a result file's path; the last seed in the path counts."""
    return {
        "variant": F.nullif(F.regexp_extract(path, r"/([^/]+)/\d{8}_\d{6}[^/]*/", 1), F.lit("")),
        "timestamp": F.nullif(F.regexp_extract(path, STAMP, 1), F.lit("")),
        "path_seed": last_number(path, r"seed[_-]?(\d+)"),
    }


def scan_results(spark: SparkSession, paths: str | list[str], schema: T.StructType, *, latest: bool = True, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all result CSVs under ``paths`` (globs), with variant, timestamp and seed from their paths.

    ``latest`` keeps each variant's newest run that has the file; ``prefixes`` keeps the variants that start so. A seed in
    the path overrides the column.
    """
    rows = spark.read.schema(schema).option("header", True).csv(paths)
    rows = rows.withColumns(path_parts(F.col("_metadata.file_path"))).where("variant IS NOT NULL")
    if prefixes:
        keep = F.lit(False)
        for p in prefixes:
            keep = keep | F.col("variant").startswith(p)
        rows = rows.where(keep)
    if latest:
        newest = latest_run(rows.select("variant", "timestamp").distinct(), "variant", "timestamp")
        rows = rows.join(newest, ["variant", "timestamp"], "left_semi")
    seed = F.coalesce("path_seed", "seed") if "seed" in schema.names else F.col("path_seed")
    return rows.withColumn("seed", seed).drop("path_seed")


def deduplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    return keep_latest(rows, keys, "timestamp")
