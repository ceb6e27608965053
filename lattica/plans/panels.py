"""Queries of the reconstruction panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from .common import EXPR, PANEL, expr, panel_rows
from .registry import query, table


def _pearson_sql(key: str) -> str:
    return f"WITH {PANEL} SELECT {key}, round(CASE WHEN stddev_pop(target) > 0 AND stddev_pop(predicted) > 0 THEN corr(target, predicted) END, 6) AS pearson FROM panel GROUP BY 1"


@query(_pearson_sql("row"))
def pearson_cell(spark, d):
    return P.pearson(panel_rows(spark, d), ["row"]).select("row", F.round("pearson", 6).alias("pearson"))


@query(_pearson_sql("col"))
def pearson_gene(spark, d):
    return P.pearson(panel_rows(spark, d), ["col"]).select("col", F.round("pearson", 6).alias("pearson"))


_RANKS = f"WITH {PANEL}, r AS (SELECT col, rank() OVER (PARTITION BY col ORDER BY target) + (count(*) OVER (PARTITION BY col, target) - 1) / 2.0 AS a, rank() OVER (PARTITION BY col ORDER BY predicted) + (count(*) OVER (PARTITION BY col, predicted) - 1) / 2.0 AS b FROM panel)"


@query(f"{_RANKS} SELECT col, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
def spearman(spark, d):
    return P.spearman(panel_rows(spark, d), ["col"]).select("col", F.round("spearman", 6).alias("spearman"))


@query("SELECT l_orderkey, l_linenumber, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0)::DOUBLE AS rank FROM lineitem")
def average_rank(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return P.average_ranks(rows, ["l_returnflag"], "l_quantity", "rank").select("l_orderkey", "l_linenumber", "rank")


@query(f"WITH {PANEL} SELECT part, round(sqrt(avg((target - predicted) * (target - predicted))), 6) AS rmse FROM panel GROUP BY 1")
def rmse(spark, d):
    return P.rmse(panel_rows(spark, d), by=["part"]).select("part", F.round("rmse", 6).alias("rmse"))


@query(f"WITH {PANEL}, e AS (SELECT target, (target - predicted) * (target - predicted) AS d FROM panel) SELECT round(avg(d), 6) AS pooled, round(avg(d) FILTER (target > 0), 6) AS expressed, round(avg(d) FILTER (target <= 0), 6) AS zeros, round((avg(d) FILTER (target > 0) + avg(d) FILTER (target <= 0)) / 2, 6) AS balanced FROM e")
def mse_variants(spark, d):
    return P.mse_variants(panel_rows(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("pooled", "expressed", "zeros", "balanced")))


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return table(spark, d, "labels").join(docs, "doc_id")


_SC = "s AS (SELECT quality AS y, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_SC}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))), 9) AS auroc FROM r")
def auroc(spark, d):
    return P.auroc(_scored(spark, d), F.col("quality"), "score").select(F.round("auroc", 9).alias("auroc"))


@query(f"WITH {_SC}, g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS k FROM g) SELECT round(sum(pos * tp / k) / sum(pos), 9) AS average_precision FROM c")
def avg_precision(spark, d):
    return P.average_precision(_scored(spark, d), F.col("quality"), "score").select(F.round("average_precision", 9).alias("average_precision"))


_HVG = f"WITH {EXPR}, n AS (SELECT count(DISTINCT cell_id) AS n FROM expr), m AS (SELECT gene_id, sum(ln(1 + value)) AS s, sum(ln(1 + value) * ln(1 + value)) AS ss FROM expr GROUP BY 1)"


@query(f"{_HVG} SELECT gene_id, round(ss / n - (s / n) * (s / n), 6) AS variance FROM m, n ORDER BY round(ss / n - (s / n) * (s / n), 9) DESC, gene_id LIMIT 20")
def hvg(spark, d):
    e = expr(spark, d)
    n = e.agg(F.count_distinct("cell_id")).first()[0]
    return P.top_variance(e, n, 20).select("gene_id", F.round("variance", 6).alias("variance"))


@query(f"""WITH {EXPR}, l AS (SELECT s_suppkey AS cell_id, (s_nationkey % 4)::VARCHAR AS label FROM supplier), nl AS (SELECT label, count(*) AS n FROM l GROUP BY 1),
j AS (SELECT label, gene_id, value FROM expr JOIN l USING (cell_id)), g AS (SELECT gene_id, sum(value) / (SELECT count(*) FROM l) AS grand FROM j GROUP BY 1), i AS (SELECT label, gene_id, sum(value) AS s FROM j GROUP BY ALL),
s AS (SELECT nl.label, g.gene_id, round(coalesce(s, 0) / n - grand, 6) AS score FROM g CROSS JOIN nl LEFT JOIN i ON i.label = nl.label AND i.gene_id = g.gene_id)
SELECT label, gene_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, gene_id) AS r FROM s) WHERE r <= 10""")
def markers(spark, d):
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 4).cast("string").alias("label"))
    return P.marker_genes(expr(spark, d), labels).select("label", "gene_id", F.round("score", 6).alias("score"))


@query(f"""WITH {PANEL}, s AS (SELECT *, unnest(['all', part]) AS split FROM panel),
c AS (SELECT split, row AS k, corr(target, predicted) AS r FROM s GROUP BY 1, 2), g AS (SELECT split, col AS k, corr(target, predicted) AS r FROM s GROUP BY 1, 2),
e AS (SELECT split, sqrt(avg((target - predicted) * (target - predicted))) AS rmse FROM s GROUP BY 1)
SELECT 'cell_wise' AS axis, split, round(avg(r), 6) AS pearson_mean, round(median(r), 6) AS pearson_median, round(any_value(rmse), 6) AS rmse, count(*) AS n_vectors FROM c JOIN e USING (split) GROUP BY split
UNION ALL SELECT 'gene_wise', split, round(avg(r), 6), round(median(r), 6), round(any_value(rmse), 6), count(*) FROM g JOIN e USING (split) GROUP BY split""")
def panel(spark, d):
    out = P.panel(panel_rows(spark, d), "part")
    return out.select("axis", "split", F.round("pearson_mean", 6).alias("pearson_mean"), F.round("pearson_median", 6).alias("pearson_median"), F.round("rmse", 6).alias("rmse"), "n_vectors")


@query(f"""WITH {PANEL}, v AS (SELECT row, col, row % 100 + 1 AS depth, exp(greatest(predicted, 0)) - 1 AS v FROM panel)
SELECT row, col, round(coalesce(v / nullif(sum(v) OVER (PARTITION BY row), 0), 0) * depth, 6) AS counts FROM v""")
def depth_rescale(spark, d):
    rows = panel_rows(spark, d).withColumn("depth", F.col("row") % 100 + 1)
    return P.depth_rescaled(rows, "depth").select("row", "col", F.round("counts", 6).alias("counts"))


@query(f"""WITH {EXPR}, o AS (SELECT cell_id, list(gene_id + 3 ORDER BY value DESC, gene_id)[1:16] AS t FROM expr WHERE value > 0 GROUP BY 1)
SELECT cell_id, array_to_string(list_concat(t, list_transform(range(16 - len(t)), lambda x: 0)), ',') AS tokens FROM o""")
def rank_tokens(spark, d):
    return P.rank_tokens(expr(spark, d), 16, 3).select("cell_id", F.concat_ws(",", F.transform("tokens", lambda t: t.cast("string"))).alias("tokens"))
