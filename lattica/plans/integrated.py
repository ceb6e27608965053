"""Graphs of neighbours and their communities, neighbourhood features, batch correction, genes of high variance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns, vectors
from ..operators import communities as C
from ..operators import embedding, sparse_pca
from ..operators import integration as I
from ..operators.spatial import knn_join
from .common import CELLS, EXPR, cells, expr, knn_sql
from .registry import query, table

_GRAPH = "pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM knn), graph AS (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs)"


def _graph(spark, d, k=8):
    c = cells(spark, d)
    return c, knn_join(c, c, k).select("src", "dst")


@query(f"""WITH {CELLS}, {knn_sql(8)}, {_GRAPH},
k AS (SELECT x.label, count(*) AS k, count(*) FILTER (x.label = y.label) AS inside FROM graph JOIN cells x ON x.id = src JOIN cells y ON y.id = dst GROUP BY 1)
SELECT round(sum(inside) / sum(k) - sum(k * k) / (sum(k) * sum(k))::DOUBLE, 9) AS modularity FROM k""")
def graph_modularity(spark, d):
    c, edges = _graph(spark, d)
    return C.modularity(edges, c.select(F.col("id").alias("node"), F.col("label").alias("community"))).select(F.round("modularity", 9).alias("modularity"))


@query()
def graph_communities(spark, d):
    c, edges = _graph(spark, d)
    return C.communities(edges, 1.0, nodes=c.select(F.col("id").alias("node"))).select("node", "community")


@query()
def communities_of_count(spark, d):
    c, edges = _graph(spark, d)
    return C.communities_of_count(edges, 24, nodes=c.select(F.col("id").alias("node"))).select("resolution", "node", "community")


_M = """SELECT id, {m} AS m, feature, {value} AS value FROM (
  SELECT src AS id, feature, sum(w * value) AS mean, sum(w * cos({m} * phi) * value) - sum(w * value) * any_value(c) AS re, sum(w * sin({m} * phi) * value) - sum(w * value) * any_value(s) AS im
  FROM w{m} JOIN around{m} USING (src) JOIN vals ON vals.id = dst GROUP BY 1, 2)"""
_W = """raw{m} AS (SELECT src, dst, phi, exp(-d2 / pow(median(sqrt(d2)) OVER (PARTITION BY src), 2)) AS g FROM ends WHERE rank <= {k}),
w{m} AS (SELECT src, dst, phi, g / sum(g) OVER (PARTITION BY src) AS w FROM raw{m}), around{m} AS (SELECT src, sum(w * cos({m} * phi)) AS c, sum(w * sin({m} * phi)) AS s FROM w{m} GROUP BY 1)"""


@query(f"""WITH {CELLS}, {knn_sql(12)}, vals AS (SELECT id, unnest(range(0, 64))::INT AS feature, unnest(embedding)::DOUBLE AS value FROM cells),
ends AS (SELECT knn.*, atan2(t.y - q.y, t.x - q.x) AS phi FROM knn JOIN cells q ON q.id = src JOIN cells t ON t.id = dst),
{_W.format(m=0, k=6)}, {_W.format(m=1, k=12)},
every AS (SELECT id, -1 AS m, feature, value FROM vals UNION ALL {_M.format(m=0, value="mean")} UNION ALL {_M.format(m=1, value="sqrt(re * re + im * im)")})
SELECT id, m, feature, round((value - avg(value) OVER w) / stddev_pop(value) OVER w * CASE m WHEN -1 THEN sqrt(0.8) WHEN 0 THEN sqrt(0.2 / 1.5) ELSE sqrt(0.1 / 1.5) END, 6) AS value
FROM every WINDOW w AS (PARTITION BY m, feature)""")
def banksy_features(spark, d):
    c = cells(spark, d)
    values = c.select("id", F.posexplode("vector").alias("feature", "value"))
    return I.banksy_features(c, values, k=6, max_m=1, mix=0.2).select("id", "m", "feature", F.round("value", 6).alias("value"))


@query()
def harmony_corrected(spark, d):
    """Sections as batches, each moved by its number so that there is something to correct."""
    moved = cells(spark, d).select("id", F.col("section_id").alias("batch"), F.transform("vector", lambda x: x + F.col("section_id") * F.lit(0.1)).alias("vector"))
    return I.harmonised(moved, 16).select("id", "batch", "corrected")


@query(f"""WITH {EXPR}, c AS (SELECT DISTINCT cell_id, cell_id % 2 AS batch FROM expr), z AS (SELECT batch, count(*)::DOUBLE AS n FROM c GROUP BY 1),
v AS (SELECT c.batch, c.cell_id, g.gene_id, coalesce(e.value, 0)::DOUBLE AS v FROM c CROSS JOIN (SELECT DISTINCT gene_id FROM expr) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene_id = g.gene_id),
s AS (SELECT batch, gene_id, avg(v) AS mean, var_samp(v) AS var, log10(avg(v)) AS x, log10(var_samp(v)) AS y FROM v GROUP BY 1, 2),
near AS (SELECT a.batch, a.gene_id, b.x - a.x AS d, b.y, row_number() OVER (PARTITION BY a.batch, a.gene_id ORDER BY abs(b.x - a.x)) AS r, count(*) OVER (PARTITION BY a.batch, a.gene_id) AS g FROM s a JOIN s b ON a.batch = b.batch),
used AS (SELECT batch, gene_id, d / max(abs(d)) OVER (PARTITION BY batch, gene_id) AS d, y, pow(1 - pow(abs(d) / max(abs(d)) OVER (PARTITION BY batch, gene_id), 3), 3) AS w FROM near WHERE r <= floor(0.3 * g)),
n AS (SELECT batch, gene_id, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * pow(d, 3)) AS s3, sum(w * pow(d, 4)) AS s4, sum(w * y) AS t0, sum(w * d * y) AS t1, sum(w * d * d * y) AS t2 FROM used GROUP BY 1, 2),
f AS (SELECT s.*, z.n, sqrt(pow(10, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)))) AS sd FROM s JOIN n USING (batch, gene_id) JOIN z USING (batch)),
k AS (SELECT f.batch, f.gene_id, round(sum(pow(least(v, mean + sd * sqrt(n)) - mean, 2)) / ((any_value(n) - 1) * pow(any_value(sd), 2)), 12) AS variance FROM f JOIN v USING (batch, gene_id) GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY variance DESC, gene_id) - 1 AS place FROM k),
a AS (SELECT gene_id, avg(variance) AS variance, median(place) FILTER (place < 12) AS rank, count(*) FILTER (place < 12) AS batches FROM p GROUP BY 1)
SELECT gene_id, round(variance, 6) AS variance, rank::DOUBLE AS rank, batches, row_number() OVER (ORDER BY rank NULLS LAST, batches DESC, gene_id) <= 12 AS chosen FROM a""")
def seurat_v3_genes(spark, d):
    e = expr(spark, d)
    out = I.seurat_v3(e, e.select("cell_id", (F.col("cell_id") % 2).alias("batch")).distinct(), 12)
    return out.select("gene_id", F.round("variance", 6).alias("variance"), "rank", "batches", "chosen")


@query("""WITH s AS (SELECT vec_id % 3 AS batch, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY md5('0:' || id), id) AS r FROM s),
k AS (SELECT x.batch AS a, y.batch AS b, avg(exp(-pow(list_sum(list_transform(list_zip(x.v, y.v), lambda z: abs(z[1] - z[2]))), 2) / 2)) AS m FROM r x JOIN r y ON x.batch <= y.batch WHERE x.r <= 120 AND y.r <= 120 GROUP BY 1, 2)
SELECT k.a::INT AS a, k.b::INT AS b, round(x.m + y.m - 2 * k.m, 9) AS mmd FROM k JOIN k x ON x.a = k.a AND x.b = k.a JOIN k y ON y.a = k.b AND y.b = k.b WHERE k.a < k.b""")
def mmd_between_batches(spark, d):
    c = cells(spark, d).select("id", F.col("section_id").alias("batch"), "vector")
    return vectors.mmd_between_batches(c, most=120).select("a", "b", F.round("mmd", 9).alias("mmd"))


@query("""WITH n AS (SELECT unnest(['batch_status', 'Sample_customer', 'label_priority', 'cluster_clerk', 'region_day', 'note']) AS name, unnest([count(DISTINCT o_orderstatus), count(DISTINCT o_custkey), count(DISTINCT o_orderpriority), count(DISTINCT o_orderkey % 500), count(DISTINCT o_orderkey % 501), count(DISTINCT o_orderpriority)]) AS n FROM orders)
SELECT name, CASE WHEN regexp_matches(lower(name), 'batch|sample') AND n BETWEEN 2 AND 50 THEN 'batch' ELSE 'label' END AS role FROM n
WHERE regexp_matches(lower(name), 'batch|sample') AND n BETWEEN 2 AND 50 OR regexp_matches(name, 'label|cluster|region') AND n BETWEEN 2 AND 500""")
def column_roles(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("batch_status"), F.col("o_custkey").alias("Sample_customer"), F.col("o_orderpriority").alias("label_priority"), (F.col("o_orderkey") % 500).alias("cluster_clerk"),
        (F.col("o_orderkey") % 501).alias("region_day"), F.col("o_orderpriority").alias("note"),
    )
    return spark.createDataFrame(sorted(columns.column_roles(o).items()), "name string, role string")


@query()
def sparse_components(spark, d):
    e = embedding.log_normalised(expr(spark, d).withColumn("value", F.col("value").cast("double")))
    return sparse_pca.sparse_components(e, e.select("cell_id"), 10)


@query(f"""WITH {EXPR}, n AS (SELECT count(DISTINCT cell_id)::DOUBLE AS n FROM expr), s AS (SELECT gene_id, sum(value) / any_value(n) AS mean, sqrt((sum(pow(value, 2)) - pow(sum(value), 2) / any_value(n)) / (any_value(n) - 1)) AS sd FROM expr, n GROUP BY 1)
SELECT cell_id, gene_id, round(greatest(-2, least(2, (value - mean) / sd)) - greatest(-2, least(2, -mean / sd)), 6) AS d FROM expr JOIN s USING (gene_id)""")
def standardised_entries(spark, d):
    e = expr(spark, d)
    return sparse_pca.standardised_entries(e, e.select("cell_id"), 2.0)[0].select("cell_id", "gene_id", F.round("d", 6).alias("d"))
