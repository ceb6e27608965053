"""Queries of the named reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import reports as R
from ..operators import spatial
from .agreements import _JSD, _shares
from .common import CELLS, SEEDS, SEEDS_LONG, cells, knn_sql, seeds, seeds_long
from .registry import query, table


def _r(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("SELECT user_id, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(v) AS n FROM (SELECT user_id, CASE WHEN event_id % 7 < 5 THEN value END AS v FROM events) GROUP BY 1")
def finite_summary(spark, d):
    v = F.when(F.col("event_id") % 7 == 5, float("nan")).when(F.col("event_id") % 7 == 6, float("inf")).otherwise(F.col("value"))
    return _r(R.finite_summary(table(spark, d, "events").withColumn("v", v), ["user_id"], "v"), "mean", "median")


_PANEL = """panel AS (SELECT l_returnflag AS method, l_linenumber::INT AS seed, CASE WHEN l_linestatus = 'F' THEN 'gene_wise' ELSE 'cell_wise' END AS axis,
  CASE WHEN l_orderkey % 2 = 0 THEN 'log1p' ELSE 'raw' END AS transform, CASE l_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'hvg50' ELSE 'markers' END AS gene_subset,
  round(avg(l_tax), 9) AS pearson_mean, round(avg(l_discount), 9) AS rmse_mean FROM lineitem GROUP BY ALL)"""


def _panel(spark, d):
    rows = table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    return rows.groupBy(
        F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("int").alias("seed"), F.when(F.col("l_linestatus") == "F", "gene_wise").otherwise("cell_wise").alias("axis"),
        F.when(k % 2 == 0, "log1p").otherwise("raw").alias("transform"), F.when(k % 3 == 0, "all").when(k % 3 == 1, "hvg50").otherwise("markers").alias("gene_subset"),
    ).agg(F.round(F.avg("l_tax"), 9).alias("pearson_mean"), F.round(F.avg("l_discount"), 9).alias("rmse_mean"))


_SPEC = {"pe_gw_log": ("gene_wise", "log1p", "all", "pearson_mean"), "pe_cw_raw": ("cell_wise", "raw", "markers", "pearson_mean"), "rm_hv_log": ("gene_wise", "log1p", "hvg", "rmse_mean")}


@query(f"""WITH {_PANEL} SELECT 'pe_gw_log' AS code, method, seed, pearson_mean AS value FROM panel WHERE axis = 'gene_wise' AND transform = 'log1p' AND gene_subset = 'all'
UNION ALL SELECT 'pe_cw_raw', method, seed, pearson_mean FROM panel WHERE axis = 'cell_wise' AND transform = 'raw' AND gene_subset = 'markers'
UNION ALL SELECT 'rm_hv_log', method, seed, rmse_mean FROM panel WHERE axis = 'gene_wise' AND transform = 'log1p' AND gene_subset LIKE 'hvg%'""")
def panel_grid(spark, d):
    return R.panel_grid(_panel(spark, d), _SPEC)


_FLAVOURS = [f"{a}_{t}_{s}" for a in ("gene", "cell") for t in ("raw", "log1p") for s in ("all", "hvg")]


@query(f"WITH {_PANEL} SELECT method, " + ", ".join(f"round(avg(rmse_mean) FILTER (axis = '{n.split('_')[0]}_wise' AND transform = '{n.split('_')[1]}' AND starts_with(gene_subset, '{n.split('_')[2]}')), 6) AS {n}" for n in _FLAVOURS) + " FROM panel GROUP BY 1")
def rmse_flavours(spark, d):
    return _r(R.rmse_flavours(_panel(spark, d)), *_FLAVOURS)


@query()
def ablation_summary(spark, d):
    return R.ablation_summary(seeds_long(spark, d), "R-F")


@query(f"""WITH {SEEDS_LONG}, m AS (SELECT variant, metric, count(*) AS n, round(avg(value), 6) AS mean FROM long GROUP BY 1, 2), spec AS (SELECT * FROM (VALUES ('width', 0, 'R-F'), ('width', 1, 'A-F'), ('depth', 0, 'R-F'), ('depth', 1, 'N-O'), ('depth', 2, 'N-F')) AS t(axis, place, variant))
SELECT axis, place, variant, metric, n, mean, variant = 'R-F' AS is_default FROM spec JOIN m USING (variant)""")
def ablation_report(spark, d):
    s = seeds_long(spark, d).groupBy("variant", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return R.ablation_report(s, {"width": ["A-F"], "depth": ["N-O", "R-F", "N-F"]}, "R-F")


@query(f"""WITH {SEEDS}, w AS (SELECT seed % 3 AS axis_number, variant, arg_min(ari, seed) AS ari, arg_min(nmi, seed) AS nmi FROM seeds GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY axis_number ORDER BY variant <> 'R-F', variant) AS place FROM w""")
def axis_merge(spark, d):
    long = seeds_long(spark, d).where("metric <> 'rmse'").withColumn("axis", F.concat(F.lit("axis_"), (F.col("seed") % 3).cast("string"))).withColumnRenamed("seed", "position")
    out = R.axis_merge(long, "axis", "variant", "R-F", "metric", "value", ["ari", "nmi"])
    return out.withColumn("place", F.col("place").cast("long"))


_COND = "c AS (SELECT l_returnflag AS condition, CASE WHEN l_linestatus = 'F' THEN 'cell' ELSE 'niche' END AS branch, 'NMI' AS metric, l_linenumber AS seed, round(avg(l_tax), 9) AS value FROM lineitem GROUP BY ALL)"


def _conditions(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("condition"), F.when(F.col("l_linestatus") == "F", "cell").otherwise("niche").alias("branch"), F.lit("NMI").alias("metric"), F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_tax"), 9).alias("value"))


@query(f"""WITH {_COND}, m AS (SELECT condition, branch, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM c GROUP BY 1, 2, 3)
SELECT m.condition, m.branch, m.metric, m.n, round(m.mean, 6) AS mean, round(m.sd, 6) AS sd, round(m.mean - b.mean, 6) AS gap FROM m JOIN m b ON b.condition = 'R' AND b.branch = m.branch AND b.metric = m.metric""")
def discretisation_summary(spark, d):
    return _r(R.discretisation_summary(_conditions(spark, d), ["R", "A", "N"]), "mean", "sd", "gap")


@query(f"WITH {_COND} SELECT condition AS variant, upper(branch[1]) || branch[2:] || ' ' || metric AS metric, seed, value, condition = 'R' AS is_default FROM c")
def ablation_schema(spark, d):
    return R.to_ablation_schema(_conditions(spark, d), "R")


@query()
def significance_table(spark, d):
    return R.significance_table(seeds_long(spark, d), "variant", "R-F", ["metric"], "value")


@query("SELECT c_custkey, c_mktsegment, o.n AS n, NULL::DOUBLE AS score FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o USING (c_custkey)")
def manifest_join(spark, d):
    results = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return R.with_results(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), results, "c_custkey", {"n": "long", "score": "double"})


@query("""WITH m AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'left' END AS status, CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS reason, round(o_totalprice) AS printed, o_totalprice AS value FROM orders)
SELECT 'done' AS kind, '' AS reason, count(*) AS n FROM m WHERE status = 'done' UNION ALL SELECT 'not recomputed', coalesce(reason, 'unknown'), count(*) FROM m WHERE status <> 'done' GROUP BY 2 UNION ALL SELECT 'drift', '', count(*) FROM m WHERE status = 'done' AND abs(value - printed) > 0.25""")
def coverage_report(spark, d):
    o = table(spark, d, "orders")
    m = o.select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("left").alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("reason"), F.round("o_totalprice").alias("printed"), F.col("o_totalprice").alias("value"))
    return R.coverage(m, "status", "reason", "printed", "value", 0.25)


@query("""WITH p AS (SELECT o_custkey % 40 AS file, o_orderkey % 400 // 10 AS section, count(*) AS n FROM orders WHERE o_orderkey % 40 = o_custkey % 40 OR o_custkey % 40 = 1 GROUP BY 1, 2), s AS (SELECT section, count(*) AS files FROM p GROUP BY 1)
SELECT file, count(*) AS n_sections, sum(n)::BIGINT AS n_cells, bool_or(files > 1) AS collapses FROM p JOIN s USING (section) GROUP BY 1""")
def section_check(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 40 = o_custkey % 40 OR o_custkey % 40 = 1")
    return R.section_check(o.select((F.col("o_custkey") % 40).alias("file"), F.floor(F.col("o_orderkey") % 400 / 10).alias("section")), "file", "section")


@query(f"WITH {SEEDS_LONG} SELECT variant, seed, 'NMI' AS metric, value FROM long WHERE metric = 'nmi' AND seed % 3 <> 0")
def metric_values(spark, d):
    text = F.when(F.col("seed") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return R.metric_values(seeds_long(spark, d).withColumn("value", text), "NMI", {"metric": "nmi"}, "value")


@query("WITH v AS (SELECT DISTINCT p_type AS variant FROM part), p AS (SELECT unnest(['SM', 'E', 'X', 'STA']) AS prefix), h AS (SELECT prefix, count(variant) AS n, min(variant) AS variant FROM p LEFT JOIN v ON starts_with(variant, prefix) GROUP BY 1) SELECT prefix, CASE WHEN n = 1 THEN variant END AS variant, n FROM h")
def unique_variants(spark, d):
    return R.unique_variant(table(spark, d, "part").select(F.col("p_type").alias("variant")), ["SM", "E", "X", "STA"])


@query(f"WITH {SEEDS} SELECT variant, seed, ari FROM seeds UNION ALL SELECT 'default', seed, ari FROM seeds WHERE variant = 'A-F'")
def reference_aliases(spark, d):
    return R.with_aliases(seeds(spark, d).select("variant", "seed", "ari"), {"default": ["missing", "A-F", "R-F"], "N-O": ["R-F"]})


@query(f"WITH {SEEDS} SELECT variant, seed, ari FROM seeds WHERE variant <> 'N-F' UNION ALL SELECT variant, 0, round(avg(ari), 6) FROM seeds WHERE variant = 'N-F' GROUP BY 1")
def seed_slices(spark, d):
    s = seeds(spark, d).select("variant", "seed", "ari")
    return R.seed_slice(s.where("variant <> 'N-F'"), s.groupBy("variant").agg(F.round(F.avg("ari"), 6).alias("ari")), ["variant"])


@query("""SELECT o_custkey, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) * 1e12 - epoch(o_orderdate) + o_orderkey / 1e9)::VARCHAR AS path FROM orders GROUP BY 1""")
def located_files(spark, d):
    o = table(spark, d, "orders")
    source = F.when(F.col("o_orderstatus") == "F", "file").when(F.col("o_orderstatus") == "O", "run").otherwise("variant")
    files = o.select("o_custkey", source.alias("source"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("timestamp"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"))
    return R.located(files, ["o_custkey"]).select("o_custkey", F.col("path").cast("long").cast("string").alias("path"))


@query(f"WITH {SEEDS_LONG}, spec AS (SELECT DISTINCT variant, metric FROM long), printed AS (SELECT variant, metric, printf('%.3f', avg(value)) AS printed FROM long WHERE metric <> 'rmse' GROUP BY 1, 2) SELECT variant, metric, printed, printed IS NOT NULL AS has_printed FROM spec LEFT JOIN printed USING (variant, metric)")
def manifest_rows(spark, d):
    long = seeds_long(spark, d)
    printed = long.where("metric <> 'rmse'").groupBy("variant", "metric").agg(F.format_string("%.3f", F.avg("value")).alias("printed"))
    return R.manifest_rows(long.select("variant", "metric").distinct(), printed, ["variant", "metric"])


@query(f"WITH {SEEDS_LONG}, m AS (SELECT variant, metric, count(DISTINCT seed) AS n_seeds, printf('%.3f', avg(value)) AS mean_text, printf('%.3f', min(value)) AS printed FROM long GROUP BY 1, 2) SELECT *, mean_text = printed AS kept FROM m")
def kept_provenance(spark, d):
    long = seeds_long(spark, d)
    printed = long.groupBy("variant", "metric").agg(F.format_string("%.3f", F.min("value")).alias("printed"))
    return R.kept_provenance(long, printed, ["variant", "metric"])


@query(f"WITH {SEEDS_LONG} SELECT metric, variant AS method, seed, value, row_number() OVER (PARTITION BY metric ORDER BY CASE variant WHEN 'N-O' THEN 0 WHEN 'A-F' THEN 1 ELSE 2 END, variant, seed) AS place FROM long")
def ordered_report(spark, d):
    out = R.ordered_report(seeds_long(spark, d).withColumnRenamed("variant", "method"), ["N-O", "A-F"], ["value"])
    return out.withColumn("place", F.col("place").cast("long"))


@query("""WITH r AS (SELECT l_returnflag AS x, CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag ELSE 'N' END AS y, round(avg(l_tax), 9) AS value FROM lineitem GROUP BY l_linenumber, 1, 2),
s AS (SELECT x, y, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM r GROUP BY 1, 2)
SELECT x AS x_key, y AS y_key, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - (SELECT max(mean) FROM s WHERE x = y), 6) AS to_ceiling, x = y AS matching FROM s""")
def overlap_summary(spark, d):
    x = F.col("l_returnflag")
    rows = table(spark, d, "lineitem").groupBy("l_linenumber", x.alias("x_key"), F.when(F.col("l_orderkey") % 2 == 0, x).otherwise("N").alias("y_key")).agg(F.round(F.avg("l_tax"), 9).alias("value"))
    return _r(R.overlap_summary(rows), "mean", "sd", "to_ceiling")


@query("""WITH a AS (SELECT o_custkey % 40 AS batch, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT 'p' || (o_custkey % 40 * 7) AS prediction, count(*) AS n FROM orders WHERE o_custkey % 40 < 30 GROUP BY 1),
x AS (SELECT n, min(batch) AS batch, count(*) AS c FROM a GROUP BY 1), y AS (SELECT n, min(prediction) AS prediction, count(*) AS c FROM b GROUP BY 1) SELECT batch, prediction, n FROM x JOIN y USING (n) WHERE x.c = 1 AND y.c = 1""")
def matched_batches(spark, d):
    o = table(spark, d, "orders").withColumn("batch", F.col("o_custkey") % 40)
    made = o.where("batch < 30").groupBy(F.concat(F.lit("p"), (F.col("batch") * 7).cast("string")).alias("prediction")).agg(F.count("*").alias("n"))
    return R.matched_batches(o.groupBy("batch").agg(F.count("*").alias("n")), made)


@query("SELECT c_custkey, lower(c_mktsegment) AS section, c_mktsegment || '+' || (c_custkey % 2) AS canonical, c_nationkey AS label FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, lower(c_mktsegment), NULL, NULL FROM customer WHERE c_custkey % 3 <> 0")
def external_labels(spark, d):
    c = table(spark, d, "customer")
    labels = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_mktsegment", F.lit("+"), (F.col("c_custkey") % 2).cast("string")).alias("section"), F.col("c_nationkey").alias("label"))
    return R.external_labels(c.select("c_custkey", F.lower("c_mktsegment").alias("section")), labels, "section", "c_custkey", "label").select("c_custkey", "section", "canonical", "label")


@query("SELECT c_custkey, coalesce(sum(o_totalprice), 0)::DECIMAL(18, 2)::DOUBLE AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def reindexed_rows(spark, d):
    sums = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    return R.reindexed(sums, table(spark, d, "customer").select("c_custkey"), "c_custkey", ["total"]).select("c_custkey", F.round("total", 2).alias("total"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ilisi') THEN 'ilisi' WHEN contains(lower(p_name), 'nmi') THEN 'nmi' WHEN contains(lower(p_name), 'ari') THEN 'ari' WHEN contains(lower(p_name), 'ring') THEN 'mmd' END AS kind FROM part")
def metric_kinds(spark, d):
    return table(spark, d, "part").select("p_partkey", R.metric_kind(F.regexp_replace("p_name", "(?i)ring", "MMD")).alias("kind"))


@query("""WITH t AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS target, embedding[2]::DOUBLE AS predicted FROM embeddings), s AS (SELECT unnest([1, 2]) AS seed)
SELECT seed, 0 AS feature, round(sqrt(avg(pow(CASE seed WHEN 1 THEN predicted ELSE 2 * predicted END - target, 2))), 6) AS rmse, count(*) AS n FROM t, s GROUP BY 1""")
def rescored(spark, d):
    c = cells(spark, d).select("id", F.lit(0).alias("feature"), F.col("vector")[0].alias("target"), F.col("vector")[1].alias("predicted"))
    stored = c.select(F.lit(1).alias("seed"), "id", "feature", "predicted")
    legacy = stored.withColumn("predicted", F.lit(0.0)).unionByName(c.select(F.lit(2).alias("seed"), "id", "feature", (2 * F.col("predicted")).alias("predicted")))
    return _r(R.rescored(stored, legacy, c.select("id", "feature", "target"), ["feature"]), "rmse")


@query("""WITH r AS (SELECT l_suppkey AS id, l_partkey % 10 AS feature, ln(1 + sum(l_quantity)) AS target, ln(1 + sum(l_discount)) AS predicted FROM lineitem GROUP BY 1, 2),
s AS (SELECT id, sum(exp(predicted) - 1) AS p, sum(exp(target) - 1) AS t, sum(predicted) AS lp, sum(target) AS lt FROM r GROUP BY 1)
SELECT id, feature, round(predicted, 6) AS as_is, round(ln(1 + (exp(predicted) - 1) / p * 1e4), 6) AS renormed, round(ln(1 + (exp(predicted) - 1) / p * t), 6) AS oracle, round(predicted * lt / lp, 6) AS logsum FROM r JOIN s USING (id)""")
def log_space(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 10).alias("feature")).agg(F.log1p(F.sum("l_quantity")).alias("target"), F.log1p(F.sum("l_discount")).alias("predicted"))
    return _r(R.log_space(rows), "as_is", "renormed", "oracle", "logsum")


@query(f"""WITH {CELLS}, {knn_sql(1)}, f AS (SELECT section_id, CASE WHEN section_id = 2 THEN 3.0::DOUBLE ELSE 0.5 / median(sqrt(d2)) END AS factor FROM knn GROUP BY 1),
s AS (SELECT section_id, id, x * factor AS x, y * factor AS y FROM cells JOIN f USING (section_id)),
e AS (SELECT a.section_id, count(*) AS e FROM s a JOIN s b ON a.section_id = b.section_id AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1 GROUP BY 1)
SELECT section_id, round(factor, 6) AS factor, round(coalesce(e, 0) / n, 6) AS mean_degree FROM f JOIN (SELECT section_id, count(*) AS n FROM cells GROUP BY 1) USING (section_id) LEFT JOIN e USING (section_id)""")
def section_scale(spark, d):
    c = cells(spark, d)
    return _r(spatial.section_scale(c, spatial.knn_join(c, c, 1), 0.5, 1.0, {2: 3.0}), "factor", "mean_degree")


@query(f"WITH {SEEDS_LONG} SELECT variant, seed, metric, value FROM long WHERE NOT (metric = 'nmi' AND seed = 3) UNION ALL SELECT variant, seed, 'mmd', ari FROM seeds")
def tidy_metrics(spark, d):
    s = seeds(spark, d)
    broken = s.withColumn("nmi", F.when(F.col("seed") == 3, float("nan")).otherwise(F.col("nmi")))
    return R.tidy(broken, ["variant", "seed"], ["ari", "nmi", "rmse"], s.select("variant", "seed", F.lit("mmd").alias("metric"), F.col("ari").alias("value")))


@query("""WITH r AS (SELECT l_returnflag AS method, l_linenumber AS seed, round(avg(l_tax), 9) AS nmi, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT method, count(DISTINCT seed) AS n_seeds, round(avg(nmi), 6) AS nmi, trunc(median(n))::INT AS n FROM r GROUP BY 1""")
def seed_aggregate(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_tax"), 9).alias("nmi"), F.count("*").alias("n"))
    return _r(R.seed_aggregate(rows, ["method"], ["nmi"], ["n"]), "nmi")


@query("SELECT part, count(*) AS n, round(corr(target, predicted), 6) AS pearson FROM (SELECT unnest(embedding[1:32])::DOUBLE AS target, unnest(embedding[33:64])::DOUBLE AS predicted, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM embeddings) GROUP BY 1")
def pooled_pearson(spark, d):
    c = cells(spark, d)
    pairs = F.explode(F.arrays_zip(F.slice("vector", 1, 32).alias("target"), F.slice("vector", 33, 32).alias("predicted")))
    rows = c.select(F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("part"), pairs.alias("z")).select("part", "z.target", "z.predicted")
    return _r(R.pooled_pearson(rows, ["part"]), "pearson")


@query("SELECT count(*) FILTER (o_custkey % 17 = 3) AS missing, count(*) AS n FROM orders")
def missing_neighbours(spark, d):
    return R.missing_neighbours(table(spark, d, "orders").select(F.when(F.col("o_custkey") % 17 == 3, -1).otherwise(F.col("o_custkey")).alias("dst")))


@query("SELECT l_returnflag AS run, l_linestatus AS level, count(DISTINCT l_suppkey) AS n_used, CASE l_returnflag WHEN 'A' THEN 0.9 ELSE 0.8 END::DOUBLE AS beta FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def decay_sweep(spark, d):
    from ..operators.codes import decay_of

    usage = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("level")).agg(F.count_distinct("l_suppkey").alias("n_used"))
    variant = F.when(F.col("run") == "A", "emadecay-0p9").when(F.col("run") == "R", "reference").otherwise("other")
    runs = usage.select("run", decay_of(variant, "emadecay", "reference", 0.8).alias("beta"))
    return R.tagged_usage(runs, usage).select("run", "level", "n_used", "beta")


@query(f"""WITH {_JSD} SELECT 'codes' AS kind, source AS a, target AS b, 'd' || (source % 3) AS donor_a, 'd' || (target % 3) AS donor_b, source % 3 = target % 3 AS same_donor, round(similarity, 5) AS similarity FROM sim""")
def similarity_records(spark, d):
    shares = _shares(spark, d)
    pairs = A.jsd_similarity(shares, "section", "code").where("source <= target").select(F.lit("codes").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "similarity")
    sections = shares.select("section").distinct().select("section", F.concat(F.lit("d"), (F.col("section") % 3).cast("string")).alias("donor"))
    return _r(R.similarity_records(pairs, sections), "similarity", places=5)


@query("""WITH r AS (SELECT (p_size % 4)::VARCHAR AS x, 'p_brand' AS label_key, p_brand AS y FROM part UNION ALL SELECT (p_size % 4)::VARCHAR, 'p_type', p_type FROM part),
t AS (SELECT label_key, x, y, count(*) AS n FROM r GROUP BY ALL), nn AS (SELECT label_key, sum(n)::BIGINT AS n, sum(n * ln(n)) AS s FROM t GROUP BY 1),
rx AS (SELECT label_key, sum(n * ln(n)) AS s FROM (SELECT label_key, x, sum(n) AS n FROM t GROUP BY 1, 2) GROUP BY 1), ry AS (SELECT label_key, sum(n * ln(n)) AS s FROM (SELECT label_key, y, sum(n) AS n FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT 7 AS seed, 'leiden' AS code_key, label_key, nn.n AS n_cells, round(2 * (ln(nn.n) - rx.s / nn.n + ln(nn.n) - ry.s / nn.n - (ln(nn.n) - nn.s / nn.n)) / (ln(nn.n) - rx.s / nn.n + ln(nn.n) - ry.s / nn.n), 6) AS nmi FROM nn JOIN rx USING (label_key) JOIN ry USING (label_key)""")
def recomputed_run(spark, d):
    p = table(spark, d, "part").withColumn("leiden", F.col("p_size") % 4).withColumn("empty", F.lit("nan"))
    return _r(R.recomputed_run(p, ["empty", "p_brand", "p_type"], 7), "nmi").select("seed", "code_key", "label_key", "n_cells", "nmi")
