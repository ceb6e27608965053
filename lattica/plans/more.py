"""Further queries: normalisation, crops, chunks, matching and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding as E
from ..operators import harmonise as H
from ..operators import tables as T
from ..operators.vectors import nearest_centroid
from .common import CELLS, EXPR, SEEDS, cells, expr, seeds
from .registry import query, table


@query(f"WITH {EXPR} SELECT cell_id, gene_id, round(ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY cell_id)), 6) AS value FROM expr")
def log_cpm(spark, d):
    return E.log_normalised(expr(spark, d)).select("cell_id", "gene_id", F.round("value", 6).alias("value"))


@query(f"WITH {EXPR} SELECT cell_id, round(1e4 / sum(value), 6) AS factor FROM expr GROUP BY 1")
def size_factors(spark, d):
    return E.size_factors(expr(spark, d)).select("cell_id", F.round("factor", 6).alias("factor"))


@query()
def pca_embedding(spark, d):
    return E.principal_components(cells(spark, d).select("id", "vector"), 5).select("id", "pc")


@query()
def meta_cell_tokens(spark, d):
    c = E.principal_components(cells(spark, d).select("id", "vector"), 5).select("id", F.col("pc").alias("vector"))
    return nearest_centroid(c, E.vocabulary(c, "vector", 12), "token").select("id", "token")


@query("SELECT vec_id AS id, ('0x' || substr(md5('3:' || vec_id), 1, 8))::BIGINT % 4 AS chunk FROM embeddings")
def chunk_contexts(spark, d):
    return E.chunk_contexts(cells(spark, d), 4, 3)


@query(f"""WITH {CELLS} SELECT id, row_number() OVER (ORDER BY (x + 0.1) * (x + 0.1) + (y + 0.1) * (y + 0.1), id) AS place FROM cells WHERE section_id = 1 AND x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1""")
def square_crop(spark, d):
    return E.square_crop(cells(spark, d), 1, 0.0, 0.0, 0.2).select("id", F.col("place").cast("long").alias("place"))


@query("""SELECT o_orderpriority AS grp, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS mean_f, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS mean_p, round(stddev_samp(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS sd_f FROM orders GROUP BY 1""")
def conditional_means(spark, d):
    out = T.conditional_means(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "grp"), ["grp"], "o_orderstatus", ["F", "P"], "o_totalprice")
    return out.select("grp", F.round("mean_F", 4).alias("mean_f"), F.round("mean_P", 4).alias("mean_p"), F.round("sd_F", 4).alias("sd_f"))


@query("SELECT c_nationkey % 5 AS grp, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') - avg(c_acctbal) FILTER (c_mktsegment <> 'BUILDING'), 4) AS gap FROM customer GROUP BY 1")
def overlap_gaps(spark, d):
    c = table(spark, d, "customer").withColumn("grp", F.col("c_nationkey") % 5)
    return T.gaps(c, ["grp"], F.col("c_mktsegment") == "BUILDING", "c_acctbal").select("grp", F.round("gap", 4).alias("gap"))


@query("""SELECT CASE WHEN p_size > 25 THEN p_brand END AS grp, round(avg(p_retailprice) FILTER (p_partkey % 9 <> 0), 4) AS mean, count(*) FILTER (p_partkey % 9 <> 0) AS n, count(*) FILTER (p_partkey % 9 = 0) AS n_errors FROM part GROUP BY 1""")
def label_metric_summary(spark, d):
    p = table(spark, d, "part").withColumn("grp", F.when(F.col("p_size") > 25, F.col("p_brand"))).withColumn("error", F.when(F.col("p_partkey") % 9 == 0, "failed"))
    return T.metric_summary(p, ["grp"], "p_retailprice", "error").select("grp", F.round("mean", 4).alias("mean"), "n", "n_errors")


@query("""WITH a AS (SELECT c_custkey AS id, round(c_acctbal) AS v FROM customer), b AS (SELECT s_suppkey AS id, round(s_acctbal) AS v FROM supplier)
SELECT a.id AS a_id, min(b.id) AS b_id FROM a JOIN b ON abs(a.v - b.v) < 1e-3 GROUP BY 1 HAVING count(*) = 1""")
def seed_map(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round("s_acctbal").alias("v"))
    return T.match_by_value(a, b, "v", 1e-3)


@query("""WITH c AS (SELECT o_orderstatus AS grp, (o_custkey % 13)::INT AS code, count(*) AS n FROM orders WHERE o_custkey % 13 < 9 GROUP BY ALL)
SELECT g.grp, k.code::INT AS code, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT grp FROM c) g CROSS JOIN (SELECT unnest(range(0, 13)) AS code) k LEFT JOIN c ON c.grp = g.grp AND c.code = k.code""")
def code_universe(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), (F.col("o_custkey") % 13).cast("int").alias("code")).where("code < 9")
    return T.on_universe(o.groupBy("grp", "code").agg(F.count("*").alias("n")), "grp", 13)


@query(f"WITH {SEEDS} SELECT variant, count(DISTINCT seed) AS n_seeds, count(DISTINCT round(ari, 1)) AS n_values FROM seeds GROUP BY 1 HAVING count(DISTINCT seed) >= 2 AND count(DISTINCT round(ari, 1)) < count(DISTINCT seed)")
def duplicate_seeds(spark, d):
    return T.duplicate_seeds(seeds(spark, d).withColumn("ari", F.round("ari", 1)), ["variant"], "seed", "ari")


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, l_extendedprice - l_quantity * 10 - l_tax - l_quantity * 900), 4) AS model_only_seconds, round(greatest(0, l_extendedprice - l_quantity * 450), 4) AS one_pass_seconds FROM lineitem")
def runtime_flavours(spark, d):
    li = table(spark, d, "lineitem").withColumn("setup", F.col("l_quantity") * 10).withColumn("clustering", F.col("l_quantity") * 900)
    out = T.runtime_flavours(li, ["l_orderkey", "l_linenumber"], "l_extendedprice", "setup", "l_tax", "clustering")
    return out.select("l_orderkey", "l_linenumber", F.round("model_only_seconds", 4).alias("model_only_seconds"), F.round("one_pass_seconds", 4).alias("one_pass_seconds"))


@query(f"WITH {SEEDS} SELECT variant, seed, round(CASE WHEN seed = 1 THEN nmi ELSE ari END, 6) AS value FROM seeds")
def spliced_seed(spark, d):
    s = seeds(spark, d)
    old, new = s.select("variant", "seed", F.col("ari").alias("value")), s.select("variant", "seed", F.col("nmi").alias("value"))
    return T.splice(old, new, "seed", 1).select("variant", "seed", F.round("value", 6).alias("value"))


@query("SELECT user_id, event_id, event_type, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 3 <> 0")
def annotation_join(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    return H.annotated(table(spark, d, "events").select("user_id", "event_id", "event_type"), c, "user_id")
