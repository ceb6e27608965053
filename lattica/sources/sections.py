"""Sections from vendor tables, and sinks.

Vendors deliver an expression table (a row per cell, a column per gene) and a table of cells; each reader gives
``(cells, expr)``: one row per cell, and the long sparse table ``(cell_id, gene_id, value)`` without zeros.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from ..schema import resolve_column

COORDINATES = [("x", "y"), ("x_centroid", "y_centroid"), ("CenterX_global_px", "CenterY_global_px"), ("center_x", "center_y")]


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def to_long(wide: DataFrame, genes: list[str]) -> DataFrame:
    """The sparse long form of an expression table."""
    return wide.unpivot(["cell_id"], genes, "gene_id", "value").where("value <> 0")


def with_coordinates(cells: DataFrame) -> DataFrame:
    """``x`` and ``y`` from the first pair of coordinate columns that is there."""
    for x, y in COORDINATES:
        if x in cells.columns and y in cells.columns:
            return cells.withColumn("x", F.col(x).cast("double")).withColumn("y", F.col(y).cast("double"))
    raise KeyError("no pair of coordinate columns")


def read_paired(spark: SparkSession, expression: str, cells: str, *, key: Callable[[DataFrame], Column], drop: tuple[str, ...] = (), how: str = "inner", blank: str = "blank") -> tuple[DataFrame, DataFrame]:
    """Two CSVs joined by a key made of their columns; columns whose name holds ``blank`` are controls and go."""
    wide, meta = _csv(spark, expression), _csv(spark, cells)
    wide, meta = wide.withColumn("cell_id", key(wide)), meta.withColumn("cell_id", key(meta))
    genes = [c for c in wide.columns if c not in drop and c != "cell_id" and blank not in c.lower()]
    meta = with_coordinates(meta)
    if how == "inner":
        meta = meta.join(wide.select("cell_id"), "cell_id", "left_semi")
        wide = wide.join(meta.select("cell_id"), "cell_id", "left_semi")
    else:
        meta = wide.select("cell_id").join(meta, "cell_id", "left")
    return meta.drop(*(c for c in drop if c in meta.columns)), to_long(wide, genes)


def read_cosmx(spark: SparkSession, expression: str, cells: str) -> tuple[DataFrame, DataFrame]:
    """Keyed by field of view and cell number in both; cells that either table lacks go."""
    return read_paired(spark, expression, cells, key=lambda df: F.concat_ws("_", F.col("fov").cast("string"), F.col("cell_ID").cast("string")), drop=("fov", "cell_ID"))


def read_merfish(spark: SparkSession, expression: str, cells: str, slide: str) -> tuple[DataFrame, DataFrame]:
    """Ids get the slide's; the expression table decides which cells there are."""
    def key(df: DataFrame) -> Column:
        return F.concat_ws("_", F.col(resolve_column(df, ["cell", "EntityID", "_c0"])).cast("string"), F.lit(slide))

    return read_paired(spark, expression, cells, key=key, drop=("cell", "EntityID", "_c0"), how="left")


def read_starmap(spark: SparkSession, expression: str, cells: str) -> tuple[DataFrame, DataFrame]:
    """The original id is kept beside a dense one, in order of the original."""
    meta, expr = read_paired(spark, expression, cells, key=lambda df: F.col(resolve_column(df, ["NAME", "cell", "_c0"])).cast("string"), drop=("NAME", "cell", "_c0"))
    dense = numbered(meta.select(F.col("cell_id").alias("original_id")), "original_id", "cell_id")
    meta = meta.withColumnRenamed("cell_id", "original_id").join(dense, "original_id")
    expr = expr.withColumnRenamed("cell_id", "original_id").join(dense, "original_id").select("cell_id", "gene_id", "value")
    return meta, expr


def read_xenium(spark: SparkSession, expression: str, cells: str) -> tuple[DataFrame, DataFrame]:
    """Parquet tables: the long matrix ``(cell_id, gene_id, value)`` and the cells with their centroids."""
    return with_coordinates(spark.read.parquet(cells)), spark.read.parquet(expression).select("cell_id", "gene_id", "value").where("value <> 0")


READERS: dict[str, Callable] = {"cosmx": read_cosmx, "merfish": read_merfish, "starmap": read_starmap, "xenium": read_xenium}


def read_section(spark: SparkSession, assay: str, *args) -> tuple[DataFrame, DataFrame]:
    if assay not in READERS:
        raise ValueError(f"unknown assay {assay!r}; known: {sorted(READERS)}")
    return READERS[assay](spark, *args)


def write_new(df: DataFrame, path: str) -> None:
    """Writes a table where none is; an existing one is an error and stays."""
    df.write.mode("errorifexists").parquet(path)


def write_sections(df: DataFrame, path: str) -> None:
    """One partition per section, so that a scan of some reads no other."""
    df.repartition("section_id").write.mode("errorifexists").partitionBy("section_id").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A summary of few rows as one CSV with a header."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
