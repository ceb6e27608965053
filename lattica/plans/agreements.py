"""Queries of partition agreement, code usage and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mixed_radix
from ..operators import agreement as A
from .registry import query, table

_T = "t AS (SELECT lang::VARCHAR AS x, source::VARCHAR AS y, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL)"
_PARTS = """rx AS (SELECT x, sum(n) AS n FROM t GROUP BY 1), ry AS (SELECT y, sum(n) AS n FROM t GROUP BY 1), nn AS (SELECT sum(n)::DOUBLE AS n FROM t),
h AS (SELECT ln(nn.n) - (SELECT sum(n * ln(n)) FROM rx) / nn.n AS hx, ln(nn.n) - (SELECT sum(n * ln(n)) FROM ry) / nn.n AS hy, ln(nn.n) - (SELECT sum(n * ln(n)) FROM t) / nn.n AS hxy FROM nn),
pc AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS pxy, (SELECT sum(n * (n - 1) / 2.0) FROM rx) AS px, (SELECT sum(n * (n - 1) / 2.0) FROM ry) AS py, nn.n * (nn.n - 1) / 2 AS p FROM nn)"""


def _table(spark, d):
    return A.contingency(table(spark, d, "documents"), F.col("lang"), F.col("source"))


@query(f"WITH {_T}, {_PARTS} SELECT round(2 * greatest(hx + hy - hxy, 0) / (hx + hy), 9) AS nmi FROM h")
def nmi(spark, d):
    return A.partition_scores(_table(spark, d)).select(F.round("nmi", 9).alias("nmi"))


@query(f"WITH {_T}, {_PARTS} SELECT round((pxy - px * py / p) / ((px + py) / 2 - px * py / p), 9) AS ari FROM pc")
def ari(spark, d):
    return A.partition_scores(_table(spark, d)).select(F.round("ari", 9).alias("ari"))


@query(f"""WITH {_T}, {_PARTS}, ij AS (SELECT rx.n AS a, ry.n AS b, nn.n AS n, unnest(range(greatest(1, rx.n + ry.n - nn.n)::BIGINT, least(rx.n, ry.n)::BIGINT + 1)) AS k FROM rx, ry, nn),
e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM ij)
SELECT round((hx + hy - hxy - emi) / ((hx + hy) / 2 - emi), 6) AS ami FROM h, e""")
def ami(spark, d):
    return A.adjusted_mutual_information(_table(spark, d)).select(F.round("ami", 6).alias("ami"))


_ORDERS = "o AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, (o_custkey % 5)::VARCHAR AS region, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM orders)"


def _orders(spark, d):
    o = table(spark, d, "orders")
    part = F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train")
    return o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 5).cast("string").alias("region"), part.alias("part"))


@query(f"""WITH {_ORDERS}, s AS (SELECT *, unnest(['all', part]) AS split FROM o),
p AS (SELECT split, 'status' AS x_key, 'priority' AS y_key, status AS x, priority AS y FROM s UNION ALL SELECT split, 'status', 'region', status, region FROM s UNION ALL SELECT split, 'priority', 'region', priority, region FROM s),
t AS (SELECT split, x_key, y_key, x, y, count(*) AS n FROM p GROUP BY ALL),
nn AS (SELECT split, x_key, y_key, sum(n)::DOUBLE AS n, sum(n * ln(n)) AS sxy FROM t GROUP BY ALL),
sx AS (SELECT split, x_key, y_key, sum(n * ln(n)) AS s, count(*) AS k FROM (SELECT split, x_key, y_key, x, sum(n) AS n FROM t GROUP BY ALL) GROUP BY ALL),
sy AS (SELECT split, x_key, y_key, sum(n * ln(n)) AS s, count(*) AS k FROM (SELECT split, x_key, y_key, y, sum(n) AS n FROM t GROUP BY ALL) GROUP BY ALL)
SELECT split, x_key, y_key, round(2 * greatest(0, ln(n) + (sxy - sx.s - sy.s) / n) / (2 * ln(n) - (sx.s + sy.s) / n), 7) AS nmi, n::BIGINT AS n_cells, sx.k AS n_x, sy.k AS n_y
FROM nn JOIN sx USING (split, x_key, y_key) JOIN sy USING (split, x_key, y_key)""")
def overlap_pairs(spark, d):
    out = A.overlap_report(_orders(spark, d), ["status", "priority", "region"], "part")
    return out.select("split", "x_key", "y_key", F.round("nmi", 7).alias("nmi"), "n_cells", "n_x", "n_y")


@query("""WITH s AS (SELECT l_returnflag AS variant, l_linestatus AS region, avg(l_discount) AS ari, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT variant, round(sum(ari * n) / sum(n), 9) AS ari, sum(n)::BIGINT AS n, string_agg(DISTINCT region, ';' ORDER BY region) AS sources FROM s GROUP BY 1""")
def weighted_label(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("region")).agg(F.avg("l_discount").alias("ari"), F.count("*").alias("n"))
    return A.weighted_label_scores(s, ["variant"], ["ari"], "n", "region").select("variant", F.round("ari", 9).alias("ari"), "n", "sources")


def _usage_sql(by: str, code: str, source: str, size: str) -> str:
    return f"""WITH c AS (SELECT {by} AS grp, {code} AS code, count(*) AS n FROM {source} GROUP BY ALL),
g AS (SELECT grp, sum(n)::DOUBLE AS n, count(*) AS used, sum(n * ln(n)) AS s, max(n) AS top FROM c GROUP BY 1)
SELECT grp, n::BIGINT AS n_cells, {size} AS codebook_size, used AS n_used, {size} - used AS n_dead, round(exp(greatest(0, ln(n) - s / n)), 6) AS perplexity, round(greatest(0, ln(n) - s / n) / ln(2), 6) AS entropy_bits, round(top / n, 6) AS max_code_share FROM g"""


def _usage(df):
    return df.select("grp", "n_cells", "codebook_size", "n_used", "n_dead", F.round("perplexity", 6).alias("perplexity"), F.round("entropy_bits", 6).alias("entropy_bits"), F.round("max_code_share", 6).alias("max_code_share"))


@query(_usage_sql("o_orderpriority", "o_custkey % 97", "orders", "128::BIGINT"))
def code_usage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_custkey") % 97).alias("code"))
    return _usage(A.code_usage(o, F.col("code"), 128, "grp"))


@query(_usage_sql("o_orderstatus", "(o_custkey % 10) * 9 + o_orderkey % 9", "orders", "90::BIGINT"))
def joint_usage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 9).alias("codes"))
    return _usage(A.code_usage(o, mixed_radix(F.col("codes"), [10, 9]), 90, "grp"))


@query("SELECT o_orderkey AS id, ((o_custkey % 10) * 9 + o_orderkey % 9) * 4 + o_custkey % 4 AS code FROM orders")
def joint_code(spark, d):
    codes = F.array(F.col("o_custkey") % 10, F.col("o_orderkey") % 9, F.col("o_custkey") % 4)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), mixed_radix(codes, [10, 9, 4]).alias("code"))


_SHARES = """c AS (SELECT (user_id % 8)::INT AS section, event_type AS code, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT s.section, k.code, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT section FROM c) s CROSS JOIN (SELECT DISTINCT code FROM c) k LEFT JOIN c USING (section, code)),
p AS (SELECT section, code, n / sum(n) OVER (PARTITION BY section) AS p FROM g)"""
_JSD = _SHARES + """, j AS (SELECT a.section AS source, b.section AS target, sum(CASE WHEN a.p > 0 THEN a.p * log2(2 * a.p / (a.p + b.p)) ELSE 0 END + CASE WHEN b.p > 0 THEN b.p * log2(2 * b.p / (a.p + b.p)) ELSE 0 END) / 2 AS js FROM p a JOIN p b USING (code) GROUP BY ALL),
sim AS (SELECT source, target, 1 - sqrt(greatest(0, least(1, js))) AS similarity FROM j)"""


def _shares(spark, d):
    return A.distributions(table(spark, d, "events").select((F.col("user_id") % 8).cast("int").alias("section"), F.col("event_type").alias("code")), "section", "code")


@query(f"WITH {_SHARES} SELECT section, code, round(p, 9) AS p FROM p")
def section_shares(spark, d):
    return _shares(spark, d).select("section", "code", F.round("p", 9).alias("p"))


@query(f"WITH {_JSD} SELECT source, target, round(similarity, 5) AS similarity FROM sim WHERE source <> target")
def section_jsd(spark, d):
    return A.jsd_similarity(_shares(spark, d), "section", "code").where("source <> target").select("source", "target", F.round("similarity", 5).alias("similarity"))


@query(f"WITH {_JSD} SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY round(similarity, 6) DESC, target) AS rank FROM sim WHERE source <> target")
def similarity_rank(spark, d):
    sim = A.jsd_similarity(_shares(spark, d), "section", "code").withColumn("similarity", F.round("similarity", 6))
    return A.similarity_ranks(sim).select("source", "target", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderstatus AS before, o_orderpriority AS after, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 9) AS share FROM orders GROUP BY 1, 2")
def transition_matrix(spark, d):
    return A.transition_matrix(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select("before", "after", "n", F.round("share", 9).alias("share"))


@query("""WITH per AS (SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS b FROM customer GROUP BY 1)
SELECT count(*) AS n_labels, count(*) FILTER (n >= 10 AND b >= 2) AS n_scorable, sum(n)::BIGINT AS n_cells, coalesce(sum(n) FILTER (n >= 10 AND b >= 2), 0)::BIGINT AS scorable_cells,
CASE WHEN coalesce(sum(n) FILTER (n >= 10 AND b >= 2), 0) / sum(n) >= 0.75 THEN 'OK' WHEN coalesce(sum(n) FILTER (n >= 10 AND b >= 2), 0) > 0 THEN 'PARTIAL' ELSE 'NOT FEASIBLE' END AS verdict FROM per""")
def feasibility(spark, d):
    return A.feasibility(table(spark, d, "customer"), "c_nationkey", "c_mktsegment").select("n_labels", "n_scorable", "n_cells", "scorable_cells", "verdict")


@query("""WITH p AS (SELECT o_custkey % 7 AS cell, o_orderpriority AS code, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), s AS (SELECT cell, code, n / sum(n) OVER (PARTITION BY cell) AS p FROM p)
SELECT cell, level, label, round(sum(p), 9) AS p FROM s JOIN (SELECT DISTINCT o_orderpriority AS code, 0 AS level, substr(o_orderpriority, 1, 1) AS label FROM orders UNION ALL SELECT DISTINCT o_orderpriority, 1, CASE WHEN o_orderpriority < '3' THEN 'high' ELSE 'low' END FROM orders) USING (code) GROUP BY ALL""")
def rollup_prob(spark, d):
    o = table(spark, d, "orders")
    p = A.transition_matrix(o.withColumn("cell", F.col("o_custkey") % 7), "cell", "o_orderpriority").select(F.col("before").alias("cell"), F.col("after").alias("code"), F.col("share").alias("p"))
    codes = o.select(F.col("o_orderpriority").alias("code")).distinct()
    levels = codes.select("code", F.lit(0).alias("level"), F.substring("code", 1, 1).alias("label")).unionByName(codes.select("code", F.lit(1).alias("level"), F.when(F.col("code") < "3", "high").otherwise("low").alias("label")))
    return A.roll_up(p, levels, "cell").select("cell", "level", "label", F.round("p", 9).alias("p"))


@query("SELECT doc_id, dense_rank() OVER (ORDER BY lang, source) - 1 AS token FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def dense_token(spark, d):
    from ..operators.harmonise import dense_token as dense

    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL").withColumn("pair", F.struct("lang", "source"))
    return dense(docs, "pair", "token").select("doc_id", F.col("token").cast("long").alias("token"))


@query("""WITH n AS (SELECT l_suppkey AS id, l_linenumber AS token, sum(l_quantity)::DOUBLE AS n FROM lineitem WHERE l_linenumber < 7 GROUP BY ALL), p AS (SELECT id, token, n / sum(n) OVER (PARTITION BY id) AS p FROM n),
c AS (SELECT l_linenumber AS token, l_returnflag AS feature, avg(l_extendedprice) AS value FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL), t AS (SELECT id, token AS top FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, token) AS r FROM p) WHERE r = 1)
SELECT id, feature, round(sum(p * value), 6) AS weighted, round(max(CASE WHEN token = top THEN value END), 6) AS picked FROM p JOIN c USING (token) JOIN t USING (id) GROUP BY 1, 2""")
def decoded_profiles(spark, d):
    li = table(spark, d, "lineitem")
    n = li.where("l_linenumber < 7").groupBy(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("token")).agg(F.sum("l_quantity").cast("double").alias("n"))
    shares = n.join(n.groupBy("id").agg(F.sum("n").alias("all")), "id").select("id", "token", (F.col("n") / F.col("all")).alias("p"))
    profiles = li.where("l_linenumber <> 3").groupBy(F.col("l_linenumber").alias("token"), F.col("l_returnflag").alias("feature")).agg(F.avg("l_extendedprice").alias("value"))
    return A.decoded_profiles(shares, profiles).select("id", "feature", F.round("weighted", 6).alias("weighted"), F.round("picked", 6).alias("picked"))
