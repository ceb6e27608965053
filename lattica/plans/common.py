"""The driver's tables in the roles of the annotated-matrix model, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def cells(spark: SparkSession, d: str) -> DataFrame:
    """``(id, section_id, x, y, label, vector)`` from ``embeddings``."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).cast("int").alias("section_id"), v[0].alias("x"), v[1].alias("y"), "label", v.alias("vector"))


CELLS = "cells AS (SELECT vec_id AS id, (vec_id % 3)::INT AS section_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label, embedding FROM embeddings)"


def features(c: DataFrame, first: int = 8, n: int = 4) -> DataFrame:
    """``(id, feature, value)`` of some components of the vectors."""
    return c.select("id", F.posexplode(F.slice("vector", first + 1, n)).alias("feature", "value"))


FEATURES = "feats AS (SELECT id, unnest(range(0, 4))::INT AS feature, unnest(embedding[9:12])::DOUBLE AS value FROM cells)"


def knn_sql(k: int, name: str = "knn", source: str = "cells", target: str = "cells", where: str = "") -> str:
    d2 = "(q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y)"
    return (
        f"{name} AS (SELECT * FROM (SELECT q.section_id, q.id AS src, t.id AS dst, {d2} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {d2}, t.id) AS rank "
        f"FROM {source} q JOIN {target} t ON q.section_id = t.section_id AND q.id <> t.id {where}) WHERE rank <= {k})"
    )


def expr(spark: SparkSession, d: str) -> DataFrame:
    """Sparse counts ``(cell_id, gene_id, value)``: quantities by supplier and part group, from ``lineitem``."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell_id"), (F.col("l_partkey") % 50).alias("gene_id"), "l_quantity")
    return rows.groupBy("cell_id", "gene_id").agg(F.sum("l_quantity").alias("value"))


EXPR = "expr AS (SELECT l_suppkey AS cell_id, l_partkey % 50 AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Per-seed results ``(variant, seed, ari, nmi, rmse)`` from averages over ``lineitem``."""
    rows = table(spark, d, "lineitem")
    variant = F.concat_ws("-", "l_returnflag", "l_linestatus")
    return rows.groupBy(variant.alias("variant"), F.col("l_linenumber").cast("int").alias("seed")).agg(
        F.round(F.avg("l_discount"), 9).alias("ari"), F.round(F.avg("l_tax"), 9).alias("nmi"), F.round(F.avg("l_quantity"), 9).alias("rmse")
    )


SEEDS = "seeds AS (SELECT l_returnflag || '-' || l_linestatus AS variant, l_linenumber::INT AS seed, round(avg(l_discount), 9) AS ari, round(avg(l_tax), 9) AS nmi, round(avg(l_quantity), 9) AS rmse FROM lineitem GROUP BY ALL)"


def seeds_long(spark: SparkSession, d: str) -> DataFrame:
    return seeds(spark, d).unpivot(["variant", "seed"], ["ari", "nmi", "rmse"], "metric", "value")


SEEDS_LONG = SEEDS + ", long AS (SELECT variant, seed, 'ari' AS metric, ari AS value FROM seeds UNION ALL SELECT variant, seed, 'nmi', nmi FROM seeds UNION ALL SELECT variant, seed, 'rmse', rmse FROM seeds)"


def panel_rows(spark: SparkSession, d: str) -> DataFrame:
    """Dense ``(row, col, target, predicted, part)``: two stretches of the vectors as target and prediction."""
    c = cells(spark, d)
    pairs = F.arrays_zip(F.slice("vector", 1, 8).alias("t"), F.slice("vector", 9, 8).alias("p"))
    part = F.when(F.col("id") % 5 == 0, "test").otherwise("train")
    return c.select(F.col("id").alias("row"), part.alias("part"), F.posexplode(pairs).alias("col", "tp")).select("row", "col", F.col("tp.t").alias("target"), F.col("tp.p").alias("predicted"), "part")


PANEL = "panel AS (SELECT vec_id AS row, unnest(range(0, 8))::INT AS col, unnest(embedding[1:8])::DOUBLE AS target, unnest(embedding[9:16])::DOUBLE AS predicted, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM embeddings)"
