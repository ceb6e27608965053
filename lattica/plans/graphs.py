"""Neighbour graphs for several numbers of neighbours, their features, and medians."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs
from ..operators.quantiles import medians
from .common import CELLS, cells, knn_sql
from .registry import query, table


@query(f"""WITH {CELLS}, {knn_sql(20)}, e AS (SELECT DISTINCT section_id, k, a AS src, b AS dst FROM (SELECT section_id, rank, src AS a, dst AS b FROM knn UNION ALL SELECT section_id, rank, dst, src FROM knn), (SELECT unnest([4, 8, 12, 16, 20]) AS k) WHERE rank <= k)
SELECT section_id, k::INT AS k, src, dst FROM e""")
def neighbour_scales(spark, d):
    return graphs.neighbour_scales(cells(spark, d), [4, 8, 12, 16, 20])


@query(f"""WITH RECURSIVE {CELLS}, {knn_sql(8)}, e AS (SELECT DISTINCT section_id AS g, a AS src, b AS dst FROM (SELECT section_id, src AS a, dst AS b FROM knn UNION ALL SELECT section_id, dst, src FROM knn)),
near AS (SELECT g, src AS pos, list(dst ORDER BY dst) AS near FROM e GROUP BY 1, 2),
walks(g, node, walk, step, pos) AS (SELECT g, pos, unnest(range(1, 9)), 0, pos FROM near
UNION ALL SELECT w.g, w.node, w.walk, w.step + 1, n.near[1 + ('0x' || substr(md5('0:' || w.g || ':' || w.node || ':' || w.walk || ':' || (w.step + 1)), 1, 12))::BIGINT % len(n.near)] FROM walks w JOIN near n ON n.g = w.g AND n.pos = w.pos WHERE w.step < 6)
SELECT g::VARCHAR AS graph, node, step::INT AS step, avg(CASE WHEN pos = node THEN 1.0 ELSE 0.0 END)::DOUBLE AS share FROM walks WHERE step > 0 GROUP BY ALL""")
def walk_returns(spark, d):
    edges = graphs.neighbour_scales(cells(spark, d), [8]).select(F.col("section_id").cast("string").alias("graph"), "src", "dst")
    return graphs.return_shares(graphs.random_walks(edges, 6, 8))


@query()
def spectral_features(spark, d):
    c, ks = cells(spark, d), [8, 20]
    edges = graphs.neighbour_scales(c, ks).select(F.concat_ws(":", "section_id", "k").alias("graph"), "src", "dst")
    places = graphs.point_places(c).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).select(F.concat_ws(":", "section_id", "k").alias("graph"), F.col("id").alias("node"), "place")
    return graphs.spectral_coordinates(edges, 4, steps=6, cycles=2, places=places)[0]


@query("SELECT l_linestatus, l_returnflag, median(l_extendedprice)::DOUBLE AS median, count(*) AS n FROM lineitem GROUP BY ALL")
def price_medians(spark, d):
    return medians(table(spark, d, "lineitem"), ["l_linestatus", "l_returnflag"], "l_extendedprice")
