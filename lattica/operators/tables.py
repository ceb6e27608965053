"""Analytics over long tables of results: choosing runs, deduplication, seed summaries, ranks, pivots, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .stats import half_width, moments


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def latest_run(runs: DataFrame, variant: str, timestamp: str, usable: Column | None = None, tie: str | None = None) -> DataFrame:
    """The newest run of each variant among those that are usable (that hold the file wanted)."""
    runs = runs if usable is None else runs.where(usable)
    return _first(runs, [variant], F.desc(timestamp), *([F.desc(tie)] if tie else []))


def newest_matching_run(runs: DataFrame, variant: str, timestamp: str, matches: Column) -> DataFrame:
    """The newest run that reproduces the printed values, else the newest, with ``matched``."""
    return _first(runs.withColumn("matched", F.coalesce(matches, F.lit(False))), [variant], F.desc("matched"), F.desc(timestamp))


def keep_latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the given order."""
    return _first(df, keys, *(F.desc(c) for c in order))


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by the given order."""
    return _first(df, keys, *(F.asc(c) for c in order))


def average_duplicates(df: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Mean of the finite values of each key, their number, and whether they differ by more than ``tolerance``."""
    v = F.col(value).cast("double")
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return finite.groupBy(*keys).agg(F.avg(v).alias("value"), F.count("*").alias("n"), (F.max(v) - F.min(v) > tolerance).alias("spread"))


def preferred(df: DataFrame, by: list[str], key: str, preference: list[str]) -> DataFrame:
    """Of each group the key that comes first in ``preference`` (as name or, ending in ``*``, as prefix), else the least."""
    rank = F.lit(len(preference))
    for place in range(len(preference) - 1, -1, -1):
        name = preference[place]
        fits = F.col(key).startswith(name[:-1]) if name.endswith("*") else F.col(key) == name
        rank = F.when(fits, place).otherwise(rank)
    return df.groupBy(*by).agg(F.min(F.struct(rank.alias("rank"), F.col(key).alias("key"))).alias("best")).select(*by, F.col("best.key").alias(key))


def summary_long(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd (0 for one value), sem and 95 % half-width of each group's finite values."""
    m = moments(df, by, value)
    sd = F.coalesce(F.sqrt("var"), F.lit(0.0))
    return m.select(*by, "n", "mean", sd.alias("sd"), half_width(sd, F.col("n"), "sem").alias("sem"), half_width(sd, F.col("n")).alias("ci95"))


def summary_wide(long: DataFrame, row: str, column: str, columns: list[str], value: str = "mean") -> DataFrame:
    """One row per ``row`` with a column per declared metric."""
    return long.groupBy(row).pivot(column, columns).agg(F.first(value))


def method_order(long: DataFrame, method: str, metric: str, first: str) -> DataFrame:
    """Methods by falling mean of one metric; those without it last, ties by name."""
    means = long.groupBy(method).agg(F.avg(F.when(F.col(metric) == first, F.col("value"))).alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.col("mean").desc_nulls_last(), method)))


def primary_rank(df: DataFrame, variant: str, value: str, beside: list[str]) -> DataFrame:
    """Variants by rising mean of ``value``, ties by name, with the means of other columns beside."""
    means = df.groupBy(variant).agg(F.avg(value).alias(value), *(F.avg(c).alias(c) for c in beside), F.count("*").alias("n"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).asc_nulls_last(), variant)))


def consensus_rank(df: DataFrame, variant: str, metrics: list[str]) -> DataFrame:
    """Mean of the ranks (equal values share the least) over the metrics that a variant has."""
    long = df.unpivot([variant], metrics, "metric", "value").where("value IS NOT NULL AND NOT isnan(value)")
    ranked = long.withColumn("rank", F.rank().over(Window.partitionBy("metric").orderBy("value")))
    return ranked.groupBy(variant).agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n_metrics"))


def delta_board(df: DataFrame, variant: str, reference: str, metrics: list[str]) -> DataFrame:
    """Each variant's metrics and their differences from the reference's; the reference is on top. Of several rows of the reference the mean counts."""
    ref = df.where(F.col(variant) == reference).agg(F.count("*").alias("_n"), *(F.avg(m).alias(f"_{m}") for m in metrics)).where("_n > 0")
    both = df.join(F.broadcast(ref), F.lit(True))
    out = both.select(variant, *metrics, *((F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in metrics), (F.col(variant) == reference).alias("is_reference"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("is_reference"), F.col(metrics[0]).desc_nulls_last(), variant)))


def pivot_means(df: DataFrame, row: str, column: str, columns: list, value: str, all_rows: DataFrame | None = None) -> DataFrame:
    """Means by row and declared column; with ``all_rows`` also the rows that have none."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.avg(value))
    return wide if all_rows is None else all_rows.select(row).distinct().join(wide, row, "left")


def melt(df: DataFrame, ids: list[str], values: list[str], names: dict[str, str], digits: int = 4) -> DataFrame:
    """Long form with split prefixes taken off (``train_x`` to x of split train) and names mapped; unknown names are null."""
    long = df.unpivot(ids, values, "raw", "value").where("value IS NOT NULL")
    split = F.nullif(F.regexp_extract("raw", "^(train|val|test)_", 1), F.lit(""))
    bare = F.regexp_replace("raw", "^(train|val|test)_", "")
    named = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    long = long.select(*ids, F.coalesce(split, F.lit("all")).alias("split"), F.try_element_at(named, bare).alias("metric"), "value")
    return long.groupBy(*ids, "split", "metric").agg(F.round(F.avg("value"), digits).alias("value"))


def duplicate_seeds(df: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    """Groups of two seeds or more in which values repeat to six digits: a sign of copied seeds."""
    agg = df.groupBy(*by).agg(F.count_distinct(seed).alias("n_seeds"), F.count_distinct(F.round(value, 6)).alias("n_values"))
    return agg.where("n_seeds >= 2 AND n_values < n_seeds")


def runtime_flavours(df: DataFrame, keys: list[str], total: str, setup: str, neighbours: str, clustering: str) -> DataFrame:
    """Whole run, model alone, and run with one clustering pass; differences are never below 0."""
    t, s, n, c = (F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in (total, setup, neighbours, clustering))
    return df.select(*keys, t.alias("runtime_seconds"), F.greatest(F.lit(0.0), t - s - n - c).alias("model_only_seconds"), F.greatest(F.lit(0.0), t - c / 2.0).alias("one_pass_seconds"))


def manifest_flags(df: DataFrame, key: list[str], seed: str) -> DataFrame:
    """Why a result is to be computed anew: ``fallback`` >= 1, then ties, then controls; else unchanged.

    The lowest seed of each key is the sanity tier.
    """
    reason = F.when(F.col("fallback") >= 1, "fallback").when(F.col("tied_share") > 0, "ties").when(F.col("is_control"), "control").otherwise("unchanged")
    tier = F.when(F.col(seed) == F.min(seed).over(Window.partitionBy(*key)), "sanity").otherwise("full")
    return df.withColumn("reason", reason).withColumn("recompute", reason != "unchanged").withColumn("tier", tier)


def provenance(df: DataFrame, key: list[str], printed: str, recomputed: str, floor: float = 0.02) -> DataFrame:
    """Whether new values reproduce printed ones, within the larger of ``floor`` and the seeds' deviation."""
    sd = F.coalesce(F.stddev_samp(recomputed).over(Window.partitionBy(*key)), F.lit(0.0))
    tol = F.greatest(F.lit(floor), sd)
    gap = F.abs(F.col(printed) - F.col(recomputed))
    verdict = F.when(F.col(recomputed).isNull(), "missing").when(F.col(printed).isNull(), "unprinted").when(gap <= tol, "reproduced").otherwise("differs")
    return df.withColumn("tolerance", tol).withColumn("verdict", verdict)


def final_values(df: DataFrame, key: list[str], old: str, new: str, affected: str) -> DataFrame:
    """The new value where the row is affected and all rows of its key have new ones; else the old."""
    complete = F.bool_and(F.col(new).isNotNull()).over(Window.partitionBy(*key))
    use = F.col(affected) & complete
    return df.withColumn("final", F.when(use, F.col(new)).otherwise(F.col(old))).withColumn("replaced", use)


def diff_report(old: DataFrame, new: DataFrame, key: list[str], value: str, source: str, tolerance: float = 1e-9) -> DataFrame:
    """Old and new mean of each key, whether they differ, and the new rows' sources joined."""
    a = old.groupBy(*key).agg(F.avg(value).alias("printed"))
    b = new.groupBy(*key).agg(F.avg(value).alias("recomputed"), F.array_join(F.array_sort(F.collect_set(source)), ";").alias("sources"))
    both = a.join(b, key, "full")
    changed = F.coalesce(F.abs(F.col("printed") - F.col("recomputed")) > tolerance, F.lit(True))
    return both.select(*key, "printed", "recomputed", changed.alias("changed"), "sources")


def splice(old: DataFrame, new: DataFrame, seed: str, replaced: int = 0) -> DataFrame:
    """``old`` with the rows of one seed replaced by those of ``new``."""
    return old.where(F.col(seed) != replaced).unionByName(new.where(F.col(seed) == replaced))


def job_plan(tasks: DataFrame, job: str, size: str, done: Column) -> DataFrame:
    """Tasks of each job, those to do, and the largest."""
    return tasks.dropDuplicates().groupBy(job).agg(F.count("*").alias("n_tasks"), F.count_if(~done).alias("n_todo"), F.max(size).alias("max_n"))


def composite_score(df: DataFrame, group: str, metrics: dict[str, float]) -> DataFrame:
    """Weighted mean of metrics that are scaled to 0-1 within each group (0 where all are equal)."""
    w = Window.partitionBy(group)
    scaled = {m: F.coalesce(ratio(F.col(m) - F.min(m).over(w), F.max(m).over(w) - F.min(m).over(w)), F.lit(0.0)) for m in metrics}
    total = sum(metrics.values())
    out = df.withColumns({f"scaled_{m}": c for m, c in scaled.items()})
    score = sum((F.col(f"scaled_{m}") * weight for m, weight in metrics.items()), F.lit(0.0)) / total
    return out.withColumn("score", score)


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One ``line`` per row: cells joined by ``&``, missing ones as ``--``, closed by ``\\\\``."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("--")) for c in columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\")).alias("line"))


def conditional_means(df: DataFrame, by: list[str], kind: str, kinds: list[str], value: str) -> DataFrame:
    """Means of ``value`` for each kind as columns, and the deviation of each with two values or more."""
    aggs = []
    for k in kinds:
        v = F.when(F.col(kind) == k, F.col(value))
        aggs += [F.avg(v).alias(f"mean_{k}"), F.when(F.count(v) > 1, F.stddev_samp(v)).alias(f"sd_{k}")]
    return df.groupBy(*by).agg(*aggs)


def gaps(df: DataFrame, by: list[str], matching: Column, value: str) -> DataFrame:
    """Mean of the matching rows less that of the others."""
    a, b = F.avg(F.when(matching, F.col(value))), F.avg(F.when(~matching, F.col(value)))
    return df.groupBy(*by).agg(a.alias("matching"), b.alias("cross"), (a - b).alias("gap"))


def metric_summary(df: DataFrame, by: list[str], value: str, error: str) -> DataFrame:
    """Mean, deviation and number of the rows without error, with null keys kept, and the number of errors."""
    ok = F.col(error).isNull()
    v = F.when(ok, F.col(value))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"), F.count_if(~ok).alias("n_errors"))


def match_by_value(a: DataFrame, b: DataFrame, value: str, tolerance: float = 1e-9) -> DataFrame:
    """``(a_id, b_id)``: rows of ``a`` with exactly one row of ``b`` of nearly the same value; by buckets twice as wide as the tolerance."""
    cell = F.floor(F.col(value) / (2 * tolerance))
    left = a.select(F.col("id").alias("a_id"), F.col(value).alias("va"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = b.select(F.col("id").alias("b_id"), F.col(value).alias("vb"), cell.alias("cell"))
    hits = left.join(right, "cell").where(F.abs(F.col("va") - F.col("vb")) < tolerance)
    return hits.groupBy("a_id").agg(F.count("*").alias("n"), F.min("b_id").alias("b_id")).where("n = 1").drop("n")


def on_universe(counts: DataFrame, group: str, size: int) -> DataFrame:
    """``(group, code, n)`` for codes 0 to ``size - 1``, 0 where there are none."""
    grid = counts.select(group).distinct().withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return grid.join(counts, [group, "code"], "left").select(group, "code", F.coalesce("n", F.lit(0)).alias("n"))
