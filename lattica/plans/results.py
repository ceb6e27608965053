"""Queries of result-table analytics and significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import printed_value, runtime_text, stars
from ..operators import stats as S
from ..operators import tables as T
from .common import SEEDS, SEEDS_LONG, seeds, seeds_long
from .registry import query, table


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'view') WHERE r = 1")
def latest_run(spark, d):
    e = table(spark, d, "events")
    return T.latest_run(e, "user_id", "ts", F.col("event_type") != "view", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, value > 50 AS matched FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (value > 50) DESC, ts DESC) AS r FROM events) WHERE r = 1")
def newest_matching_run(spark, d):
    return T.newest_matching_run(table(spark, d, "events"), "user_id", "ts", F.col("value") > 50).select("user_id", "event_id", "matched")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def keep_latest_dedupe(spark, d):
    return T.keep_latest(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def keep_first_dedupe(spark, d):
    return T.keep_first(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("SELECT user_id, event_type, round(avg(value), 6) AS value, count(*) AS n, max(value) - min(value) > 1e-9 AS spread FROM events WHERE isfinite(value) GROUP BY 1, 2")
def avg_duplicates(spark, d):
    return T.average_duplicates(table(spark, d, "events"), ["user_id", "event_type"], "value").select("user_id", "event_type", F.round("value", 6).alias("value"), "n", "spread")


@query("""WITH r AS (SELECT o_custkey, o_orderpriority AS p, CASE WHEN o_orderpriority LIKE '3%' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS r FROM orders)
SELECT o_custkey, p AS o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r, p) AS k FROM r) WHERE k = 1""")
def pref_pick(spark, d):
    return T.preferred(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["3*", "1-URGENT"])


@query("SELECT page_id, CASE WHEN m IS NULL OR m = '' THEN NULL ELSE m::INT END AS seed FROM (SELECT page_id, list_last(regexp_extract_all(url, '/([0-9]+)', 1)) AS m FROM pages)")
def seed_from_path(spark, d):
    from ..sources.runs import last_number

    return table(spark, d, "pages").select("page_id", last_number(F.col("url"), "/([0-9]+)").alias("seed"))


def _summary_sql(extra: str = "") -> str:
    t = ", ".join(str(x) for x in S.T_975)
    return f"""WITH {SEEDS_LONG}, m AS (SELECT variant, metric, count(*) AS n, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd FROM long WHERE isfinite(value) GROUP BY 1, 2),
s AS (SELECT variant, metric, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN n < 2 THEN 0 ELSE sd / sqrt(n) END, 6) AS sem, round(CASE WHEN n < 2 THEN 0 ELSE ([{t}])[greatest(1, least(n - 1, {len(S.T_975)}))] * sd / sqrt(n) END, 6) AS ci95 FROM m) {extra or 'SELECT * FROM s'}"""


def _summary(spark, d):
    long = T.summary_long(seeds_long(spark, d), ["variant", "metric"], "value")
    return long.select("variant", "metric", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "sem", "ci95")))


@query(_summary_sql())
def summary_long(spark, d):
    return _summary(spark, d)


@query(_summary_sql("SELECT variant, max(mean) FILTER (metric = 'ari') AS ari, max(mean) FILTER (metric = 'nmi') AS nmi, max(mean) FILTER (metric = 'rmse') AS rmse FROM s GROUP BY 1"))
def summary_wide(spark, d):
    return T.summary_wide(_summary(spark, d), "variant", "metric", ["ari", "nmi", "rmse"])


@query(_summary_sql("SELECT variant, metric, n, ci95 FROM s"))
def ci95(spark, d):
    return _summary(spark, d).select("variant", "metric", "n", "ci95")


@query(f"WITH {SEEDS}, m AS (SELECT variant, round(avg(rmse), 6) AS rmse, round(avg(nmi), 6) AS nmi FROM seeds GROUP BY 1) SELECT variant, rmse, nmi, row_number() OVER (ORDER BY rmse, variant) AS rank FROM m")
def primary_rank(spark, d):
    out = T.primary_rank(seeds(spark, d), "variant", "rmse", ["nmi"])
    return out.select("variant", F.round("rmse", 6).alias("rmse"), F.round("nmi", 6).alias("nmi"), F.col("rank").cast("long").alias("rank"))


_MEANS = f"WITH {SEEDS}, m AS (SELECT variant, round(avg(ari), 9) AS ari, round(avg(nmi), 9) AS nmi, round(avg(rmse), 9) AS rmse FROM seeds GROUP BY 1)"


def _means(spark, d):
    return seeds(spark, d).groupBy("variant").agg(*(F.round(F.avg(c), 9).alias(c) for c in ("ari", "nmi", "rmse")))


@query(f"{_MEANS}, r AS (SELECT variant, rank() OVER (ORDER BY ari) AS r FROM m UNION ALL SELECT variant, rank() OVER (ORDER BY nmi) FROM m UNION ALL SELECT variant, rank() OVER (ORDER BY rmse) FROM m) SELECT variant, round(avg(r), 6) AS mean_rank, count(*) AS n_metrics FROM r GROUP BY 1")
def consensus_rank(spark, d):
    return T.consensus_rank(_means(spark, d), "variant", ["ari", "nmi", "rmse"]).select("variant", F.round("mean_rank", 6).alias("mean_rank"), "n_metrics")


@query(f"{_MEANS} SELECT m.variant, round(m.rmse, 6) AS rmse, round(m.rmse - r.rmse, 6) AS delta_rmse, m.variant = 'R-F' AS is_reference, row_number() OVER (ORDER BY (m.variant = 'R-F') DESC, m.ari DESC, m.variant) AS place FROM m, m r WHERE r.variant = 'R-F'")
def delta_board(spark, d):
    out = T.delta_board(_means(spark, d), "variant", "R-F", ["ari", "rmse"])
    return out.select("variant", F.round("rmse", 6).alias("rmse"), F.round("delta_rmse", 6).alias("delta_rmse"), "is_reference", F.col("place").cast("long").alias("place"))


@query(f"WITH {SEEDS} SELECT variant, round(avg(rmse) FILTER (seed = 1), 6) AS s1, round(avg(rmse) FILTER (seed = 2), 6) AS s2, round(avg(rmse) FILTER (seed = 3), 6) AS s3 FROM seeds GROUP BY 1")
def pivot_heatmap(spark, d):
    out = T.pivot_means(seeds(spark, d), "variant", "seed", [1, 2, 3], "rmse")
    return out.select("variant", *(F.round(F.col(f"`{k}`"), 6).alias(f"s{k}") for k in (1, 2, 3)))


@query(f"""WITH {SEEDS}, l AS (SELECT variant, 'train' AS split, 'ARI' AS metric, ari AS value FROM seeds UNION ALL SELECT variant, 'test', 'ARI', nmi FROM seeds UNION ALL SELECT variant, 'all', NULL, rmse FROM seeds)
SELECT variant, split, metric, round(avg(value), 4) AS value FROM l GROUP BY ALL""")
def melt_rename(spark, d):
    wide = seeds(spark, d).select("variant", F.col("ari").alias("train_ari"), F.col("nmi").alias("test_ari"), F.col("rmse").alias("loss"))
    return T.melt(wide, ["variant"], ["train_ari", "test_ari", "loss"], {"ari": "ARI"})


@query(f"WITH {SEEDS_LONG} SELECT metric, variant, row_number() OVER (PARTITION BY metric ORDER BY a DESC, variant) AS place FROM (SELECT metric, variant, round(avg(value), 9) AS a FROM long WHERE metric = 'nmi' GROUP BY 1, 2)")
def method_order(spark, d):
    means = seeds_long(spark, d).groupBy("variant", "metric").agg(F.round(F.avg("value"), 9).alias("value"))
    return T.method_order(means, "variant", "metric", "nmi").select(F.lit("nmi").alias("metric"), "variant", F.col("place").cast("long").alias("place"))


_MANIFEST = "m AS (SELECT o_custkey AS task, o_orderkey AS seed, (o_orderkey % 3 = 0)::INT AS fallback, CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0 END AS tied_share, o_orderstatus = 'F' AS is_control FROM orders)"


def _manifest(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("seed"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("fallback"), F.when(F.col("o_orderkey") % 5 == 0, 0.5).otherwise(0.0).alias("tied_share"), (F.col("o_orderstatus") == "F").alias("is_control"))


@query(f"""WITH {_MANIFEST}, r AS (SELECT task, seed, CASE WHEN fallback >= 1 THEN 'fallback' WHEN tied_share > 0 THEN 'ties' WHEN is_control THEN 'control' ELSE 'unchanged' END AS reason, CASE WHEN seed = min(seed) OVER (PARTITION BY task) THEN 'sanity' ELSE 'full' END AS tier FROM m)
SELECT task, seed, reason, reason <> 'unchanged' AS recompute, tier FROM r""")
def manifest_flags(spark, d):
    return T.manifest_flags(_manifest(spark, d), ["task"], "seed").select("task", "seed", "reason", "recompute", "tier")


@query(f"WITH {_MANIFEST} SELECT task % 10 AS job, count(*) AS n_tasks, count(*) FILTER (fallback < 1) AS n_todo, max(seed) AS max_n FROM m GROUP BY 1")
def job_plan(spark, d):
    tasks = _manifest(spark, d).withColumn("job", F.col("task") % 10)
    return T.job_plan(tasks, "job", "seed", F.col("fallback") >= 1)


_VALUES = "v AS (SELECT l_partkey % 20 AS k, l_orderkey AS id, l_linenumber AS ln, l_discount AS printed, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS recomputed, l_linestatus = 'O' AS affected FROM lineitem)"


def _values(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_partkey") % 20).alias("k"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.col("l_discount").alias("printed"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")).alias("recomputed"), (F.col("l_linestatus") == "O").alias("affected"))


@query(f"""WITH {_VALUES}, w AS (SELECT *, greatest(0.02, coalesce(stddev_samp(recomputed) OVER (PARTITION BY k), 0)) AS tolerance FROM v)
SELECT id, ln, CASE WHEN recomputed IS NULL THEN 'missing' WHEN printed IS NULL THEN 'unprinted' WHEN abs(printed - recomputed) <= tolerance THEN 'reproduced' ELSE 'differs' END AS verdict FROM w""")
def provenance(spark, d):
    return T.provenance(_values(spark, d), ["k"], "printed", "recomputed").select("id", "ln", "verdict")


@query(f"WITH {_VALUES}, w AS (SELECT *, affected AND bool_and(recomputed IS NOT NULL) OVER (PARTITION BY id) AS replaced FROM v) SELECT id, ln, round(CASE WHEN replaced THEN recomputed ELSE printed END, 6) AS final, replaced FROM w")
def final_policy(spark, d):
    return T.final_values(_values(spark, d), ["id"], "printed", "recomputed", "affected").select("id", "ln", F.round("final", 6).alias("final"), "replaced")


@query("""WITH a AS (SELECT o_custkey % 50 AS k, avg(o_totalprice) AS printed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey % 50 AS k, avg(o_totalprice) AS recomputed, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS sources FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT k, round(printed, 4) AS printed, round(recomputed, 4) AS recomputed, coalesce(abs(printed - recomputed) > 1e-9, true) AS changed, sources FROM a FULL JOIN b USING (k)""")
def diff_report(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey") % 50)
    out = T.diff_report(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["k"], "o_totalprice", "o_orderpriority")
    return out.select("k", F.round("printed", 4).alias("printed"), F.round("recomputed", 4).alias("recomputed"), "changed", "sources")


@query("""WITH p AS (SELECT p_partkey, p_brand AS g, p_size::DOUBLE AS s, p_retailprice AS r FROM part), w AS (SELECT *, coalesce((s - min(s) OVER b) / nullif(max(s) OVER b - min(s) OVER b, 0), 0) AS a, coalesce((r - min(r) OVER b) / nullif(max(r) OVER b - min(r) OVER b, 0), 0) AS c FROM p WINDOW b AS (PARTITION BY g))
SELECT p_partkey, round((a * 0.6 + c * 0.4) / 1.0, 6) AS score FROM w""")
def minmax_score(spark, d):
    return T.composite_score(table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_brand", {"p_size": 0.6, "p_retailprice": 0.4}).select("p_partkey", F.round("score", 6).alias("score"))


_WELCH = f"""WITH {SEEDS_LONG}, m AS (SELECT metric, variant, count(*) AS n, avg(value) AS a, var_samp(value) AS v FROM long GROUP BY 1, 2),
t AS (SELECT x.metric, x.variant, (x.a - r.a) / nullif(sqrt(x.v / x.n + r.v / r.n), 0) AS t, pow(x.v / x.n + r.v / r.n, 2) / nullif(pow(x.v / x.n, 2) / (x.n - 1) + pow(r.v / r.n, 2) / (r.n - 1), 0) AS dof FROM m x JOIN m r ON x.metric = r.metric AND r.variant = 'R-F' WHERE x.variant <> 'R-F')"""


@query(f"{_WELCH} SELECT metric, variant, round(t, 4) AS t, round(dof, 4) AS dof FROM t")
def welch_t(spark, d):
    return S.welch(seeds_long(spark, d), "variant", "R-F", ["metric"], "value").select("metric", "variant", F.round("t", 4).alias("t"), F.round("dof", 4).alias("dof"))


@query()
def welch_p(spark, d):
    tests = S.welch_p(S.welch(seeds_long(spark, d), "variant", "R-F", ["metric"], "value"))
    return S.holm(tests, "p", "metric", order="variant").withColumn("mark", stars(F.col("p_holm")))


@query("""WITH p AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 1000) / 20000.0 END AS p FROM customer),
s AS (SELECT *, least(1.0, p * (count(p) OVER (PARTITION BY c_mktsegment) - row_number() OVER (PARTITION BY c_mktsegment ORDER BY p NULLS LAST, c_custkey) + 1)) AS s FROM p)
SELECT c_custkey, round(CASE WHEN p IS NOT NULL THEN max(s) OVER (PARTITION BY c_mktsegment ORDER BY p NULLS LAST, c_custkey ROWS UNBOUNDED PRECEDING) END, 6)::DOUBLE AS p_holm FROM s""")
def holm(spark, d):
    p = F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") % 1000).cast("double") / 20000.0)
    return S.holm(table(spark, d, "customer").withColumn("p", p), "p", "c_mktsegment", order="c_custkey").select("c_custkey", F.round("p_holm", 6).alias("p_holm"))


@query("""WITH r AS (SELECT o_orderpriority AS g, o_orderstatus = 'F' AS a, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS r FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT g, round(sum(r) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0, 3)::DOUBLE AS u FROM r GROUP BY 1""")
def mann_whitney(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "g")
    return S.mann_whitney(o, ["g"], "o_orderstatus", "F", "O", "o_totalprice").select("g", F.round("u", 3).alias("u"))


@query(f"WITH {SEEDS}, w AS (SELECT a.seed, a.rmse - b.rmse AS d FROM seeds a JOIN seeds b USING (seed) WHERE a.variant = 'R-F' AND b.variant = 'A-F') SELECT count(*) AS n, round(avg(d), 6) AS mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM w")
def paired_t(spark, d):
    out = S.paired(seeds(spark, d).withColumn("all", F.lit(1)), ["all"], "seed", "variant", "R-F", "A-F", "rmse")
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"))


@query("SELECT event_id, CASE WHEN s < 60 THEN printf('%.1f s', s) WHEN s < 3600 THEN printf('%.1f min', s / 60) ELSE printf('%.1f h', s / 3600) END AS text FROM (SELECT event_id, (event_id % 200 * 360)::DOUBLE AS s FROM events)")
def runtime_format(spark, d):
    return table(spark, d, "events").select("event_id", runtime_text((F.col("event_id") % 200 * 360).cast("double")).alias("text"))


@query("SELECT c_custkey, (c_custkey % 1000) / 1000.0::DOUBLE AS value, repeat('*', (c_custkey % 4)::INT) AS mark FROM customer")
def printed_values(spark, d):
    text = F.concat(F.format_string("%.3f", (F.col("c_custkey") % 1000) / F.lit(1000.0).cast("double")), F.repeat(F.lit("*"), (F.col("c_custkey") % 4).cast("int")))
    value, mark = printed_value(text)
    return table(spark, d, "customer").select("c_custkey", value.alias("value"), mark.alias("mark"))


@query("SELECT n_nationkey || ' & ' || n_name || ' & ' || coalesce(CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR END, '--') || ' ' || chr(92) || chr(92) AS line FROM nation")
def latex_rows(spark, d):
    n = table(spark, d, "nation").withColumn("region", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")))
    return T.latex_rows(n, ["n_nationkey", "n_name", "region"])


@query()
def mann_whitney_p(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "g")
    return S.mann_whitney_p(S.mann_whitney(o, ["g"], "o_orderstatus", "F", "O", "o_totalprice")).select("g", "u", "p")


@query(f"""WITH {SEEDS}, d AS (SELECT a.variant, a.rmse - b.rmse AS d FROM seeds a JOIN seeds b USING (seed) WHERE b.variant = 'R-F' AND a.variant = 'A-F' AND a.rmse <> b.rmse),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rank FROM d) SELECT count(*) AS n, sum(rank) FILTER (d > 0)::DOUBLE AS w FROM r""")
def wilcoxon(spark, d):
    return S.wilcoxon(seeds(spark, d), [], "seed", "variant", "A-F", "R-F", "rmse").select("n", "w")
