"""Named reports over result tables: panel grids, ablation tables, manifests, coverage, provenance.

Specifications (panel cells, axes, aliases, key lists) are small mappings that the caller declares; they become literals or
broadcast tables of as many rows as are declared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stars
from .agreement import contingency, partition_scores
from .codes import cell_text, first_valid, labels_present
from .panel import pearson
from .quantiles import medians
from .stats import moments, welch, welch_p
from .tables import summary_long


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def finite_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and median of the finite values of each group, and how many there are; none: null."""
    v = F.when(_finite(value), F.col(value).cast("double"))
    means = df.groupBy(*by).agg(F.avg(v).alias("mean"))
    middle = medians(df.withColumn(value, v), by, value).withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True))
    return means.join(middle, same).select(*by, "mean", "median", "n")


def panel_grid(panel: DataFrame, spec: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """``(code, method, seed, value)``: cells of a panel by short codes.

    ``spec`` names each code's (axis, transform, subset, value column); the subset ``hvg`` fits any that starts so. ``panel`` has
    method, seed, axis, transform, gene_subset and the value columns. Values that are not finite go.
    """
    rows = [F.when((F.col("axis") == axis) & (F.col("transform") == transform) & (F.col("gene_subset").startswith(subset) if subset == "hvg" else F.col("gene_subset") == subset), F.struct(F.lit(code).alias("code"), F.col(value).cast("double").alias("value"))) for code, (axis, transform, subset, value) in spec.items()]
    long = panel.select("method", "seed", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("c")).select(F.col("c.code").alias("code"), "method", "seed", F.col("c.value").alias("value"))
    return long.where(_finite("value"))


def rmse_flavours(panel: DataFrame, value: str = "rmse_mean") -> DataFrame:
    """One row a method and eight columns: means over seeds by axis, transform and subset (all, or any that starts with hvg)."""
    subset = F.when(F.col("gene_subset").startswith("hvg"), "hvg").otherwise(F.col("gene_subset"))
    return panel.where(_finite(value)).groupBy("method").agg(*(
        F.avg(F.when((F.col("axis") == axis) & (F.col("transform") == transform) & (subset == sub), F.col(value))).alias(f"{axis.split('_')[0]}_{transform}_{sub}")
        for axis in ("gene_wise", "cell_wise") for transform in ("raw", "log1p") for sub in ("all", "hvg")
    ))


def ablation_summary(long: DataFrame, reference: str) -> DataFrame:
    """Per variant and metric of ``long(variant, metric, value)``: n, mean, sd, sem, ci95, p of Welch's test against the reference, marks and the printed text."""
    s = summary_long(long, ["variant", "metric"], "value")
    tests = welch_p(welch(long, "variant", reference, ["metric"], "value")).select("variant", "metric", "p")
    out = s.join(tests, ["variant", "metric"], "left").withColumn("mark", stars(F.col("p")))
    return out.withColumn("text", cell_text(F.col("mean"), F.col("ci95"), F.col("mark")))


def ablation_report(summary: DataFrame, axes: dict[str, list[str]], default: str) -> DataFrame:
    """``summary`` rows by axis: ``(axis, place, is_default, ...)``; the default variant opens every axis."""
    spec = [(axis, place, v) for axis, own in axes.items() for place, v in enumerate([default, *(x for x in own if x != default)])]
    spec = F.broadcast(summary.sparkSession.createDataFrame(spec, "axis string, place int, variant string"))
    return spec.join(summary, "variant").withColumn("is_default", F.col("variant") == default)


def axis_merge(rows: DataFrame, axis: str, variant: str, default: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """Rows of many axis tables as one wide table: axes by their number, the default variant first, the first value of each metric."""
    number = F.regexp_extract(axis, r"(\d+)", 1).try_cast("int").alias("axis_number")
    least = rows.groupBy(number, F.col(variant).alias("variant"), metric).agg(F.min_by(value, F.col("position")).alias("v"))
    wide = least.groupBy("axis_number", "variant").pivot(metric, metrics).agg(F.first("v"))
    order = Window.partitionBy("axis_number").orderBy(F.col("variant") != default, "variant")
    return wide.withColumn("place", F.row_number().over(order))


def discretisation_summary(rows: DataFrame, conditions: list[str]) -> DataFrame:
    """Mean, sample deviation and n by condition, branch and metric; with each the gap of its mean to the first condition's."""
    s = moments(rows.where(F.col("condition").isin(*conditions)), ["condition", "branch", "metric"], "value")
    base = s.where(F.col("condition") == conditions[0]).select("branch", "metric", F.col("mean").alias("_base"))
    return s.join(base, ["branch", "metric"], "left").select("condition", "branch", "metric", "n", "mean", F.sqrt("var").alias("sd"), (F.col("mean") - F.col("_base")).alias("gap"))


def to_ablation_schema(rows: DataFrame, default: str) -> DataFrame:
    """Rows ``(condition, branch, metric, seed, value)`` as ``(variant, metric, seed, value, is_default)``; the metric's name takes the branch's."""
    return rows.select(F.col("condition").alias("variant"), F.concat_ws(" ", F.initcap("branch"), F.col("metric")).alias("metric"), "seed", "value", (F.col("condition") == default).alias("is_default"))


def significance_table(long: DataFrame, method: str, reference: str, by: list[str], value: str) -> DataFrame:
    """Welch's test of every method but the reference against it, for each of ``by``, with marks."""
    tests = welch_p(welch(long.withColumnRenamed(method, "variant"), "variant", reference, by, value))
    return tests.where(F.col("variant") != reference).withColumn("mark", stars(F.col("p"))).withColumnRenamed("variant", method)


def with_results(manifest: DataFrame, results: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Every row of the manifest with its results; result columns that the table lacks are there, null."""
    have = results.select(key, *(F.col(c).cast(t).alias(c) if c in results.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))
    return manifest.join(have, key, "left")


def coverage(manifest: DataFrame, status: str, reason: str, printed: str, value: str, drift: float = 1e-9) -> DataFrame:
    """``(kind, reason, n)``: rows done, rows not recomputed by reason, and rows that moved from the printed value by more than ``drift``."""
    done = F.col(status) == "done"
    moved = done & (F.abs(F.col(value) - F.col(printed)) > drift)
    kinds = F.array(F.when(done, F.struct(F.lit("done").alias("kind"), F.lit("").alias("reason"))), F.when(~done, F.struct(F.lit("not recomputed").alias("kind"), F.coalesce(reason, F.lit("unknown")).alias("reason"))), F.when(moved, F.struct(F.lit("drift").alias("kind"), F.lit("").alias("reason"))))
    return manifest.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).groupBy(F.col("k.kind").alias("kind"), F.col("k.reason").alias("reason")).agg(F.count("*").alias("n"))


def section_check(cells: DataFrame, file: str, section: str) -> DataFrame:
    """Per file its distinct sections, and whether several files share one section id, which would merge them."""
    per = cells.groupBy(file, section).agg(F.count("*").alias("n"))
    shared = per.groupBy(section).agg(F.count("*").alias("files"))
    return per.join(shared, section).groupBy(file).agg(F.count("*").alias("n_sections"), F.sum("n").alias("n_cells"), F.bool_or(F.col("files") > 1).alias("collapses"))


def metric_values(long: DataFrame, name: str, filters: dict[str, str], value: str) -> DataFrame:
    """``(variant, seed, metric, value)`` of the rows that the filters name; text that is no number, NaN and null go."""
    rows = long
    for column, wanted in filters.items():
        rows = rows.where(F.col(column) == wanted)
    v = F.col(value).cast("string").try_cast("double")
    return rows.select("variant", "seed", F.lit(name).alias("metric"), v.alias("value")).where("value IS NOT NULL AND NOT isnan(value)")


def unique_variant(names: DataFrame, prefixes: list[str]) -> DataFrame:
    """``(prefix, variant, n)``: the only variant that starts with each prefix; null where none or several do."""
    spec = F.broadcast(names.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string"))
    hits = names.select("variant").distinct().join(spec, F.col("variant").startswith(F.col("prefix"))).groupBy("prefix").agg(F.count("*").alias("n"), F.min("variant").alias("variant"))
    return spec.join(hits, "prefix", "left").select("prefix", F.when(F.col("n") == 1, F.col("variant")).alias("variant"), F.coalesce("n", F.lit(0)).alias("n"))


def with_aliases(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """``rows`` and, for each wanted variant that has none, those of its first alias that has, under its name."""
    spec = [(wanted, place, own) for wanted, others in aliases.items() for place, own in enumerate([wanted, *others])]
    spec = F.broadcast(rows.sparkSession.createDataFrame(spec, "wanted string, place int, variant string"))
    there = rows.select("variant").distinct().join(spec, "variant")
    best = there.groupBy("wanted").agg(F.min_by("variant", "place").alias("variant")).where("variant <> wanted")
    given = rows.join(F.broadcast(best), "variant").drop("variant").withColumnRenamed("wanted", "variant")
    return rows.unionByName(given)


def seed_slice(per_seed: DataFrame, means: DataFrame, by: list[str]) -> DataFrame:
    """Per-seed rows, and for groups without any the mean row as seed 0."""
    missing = means.join(per_seed.select(*by).distinct(), by, "left_anti").withColumn("seed", F.lit(0).cast(dict(per_seed.dtypes)["seed"]))
    return per_seed.unionByName(missing.select(per_seed.columns))


def located(files: DataFrame, by: list[str]) -> DataFrame:
    """Of ``files(source, timestamp, path)`` one for each of ``by``: a named file before a run folder's before a variant's, then the newest."""
    rank = F.when(F.col("source") == "file", 0).when(F.col("source") == "run", 1).otherwise(2)
    return files.groupBy(*by).agg(F.min_by("path", F.struct(rank.alias("rank"), (-F.unix_timestamp("timestamp", "yyyyMMdd_HHmmss")).alias("age"), F.col("path"))).alias("path"))


def manifest_rows(spec: DataFrame, printed: DataFrame, key: list[str]) -> DataFrame:
    """Every row of the specification with the value and text that was printed for it, and whether there is one."""
    joined = spec.join(printed, key, "left")
    return joined.withColumn("has_printed", F.col("printed").isNotNull())


def kept_provenance(long: DataFrame, printed: DataFrame, by: list[str], places: int = 3) -> DataFrame:
    """Whether the mean over seeds, printed to ``places``, reads as the printed text: ``(..., n_seeds, mean_text, printed, kept)``."""
    m = long.where(_finite("value")).groupBy(*by).agg(F.count_distinct("seed").alias("n_seeds"), F.format_string(f"%.{places}f", F.avg("value")).alias("mean_text"))
    return m.join(printed, by).withColumn("kept", F.col("mean_text") == F.col("printed"))


def ordered_report(rows: DataFrame, methods: list[str], columns: list[str]) -> DataFrame:
    """The columns of a drop-in table with ``place``: methods in the declared order, unknown ones after them by name, then by seed."""
    order = F.create_map(*(F.lit(x) for kv in zip(methods, range(len(methods)), strict=True) for x in kv))
    rank = F.coalesce(order[F.col("method")], F.lit(len(methods)))
    w = Window.partitionBy("metric").orderBy(rank, "method", "seed")  # a metric's report
    return rows.select("metric", "method", "seed", *columns, F.row_number().over(w).alias("place"))


def overlap_summary(rows: DataFrame) -> DataFrame:
    """Per pair of views the mean, deviation and number over seeds, and the gap to the best pair that matches itself (the ceiling)."""
    s = rows.groupBy("x_key", "y_key").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    ceiling = s.where("x_key = y_key").agg(F.max("mean").alias("_top"))
    return s.join(F.broadcast(ceiling), F.lit(True)).select("x_key", "y_key", "n", "mean", "sd", (F.col("mean") - F.col("_top")).alias("to_ceiling"), (F.col("x_key") == F.col("y_key")).alias("matching"))


def matched_batches(sizes: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(batch, prediction, n)``: predictions whose number of rows is a batch's, where both are the only ones of that number."""
    own = sizes.groupBy("n").agg(F.min("batch").alias("batch"), F.count("*").alias("_a"))
    theirs = predictions.groupBy("n").agg(F.min("prediction").alias("prediction"), F.count("*").alias("_b"))
    return own.join(theirs, "n").where("_a = 1 AND _b = 1").select("batch", "prediction", "n")


def external_labels(rows: DataFrame, labels: DataFrame, section: str, id_: str, label: str) -> DataFrame:
    """``rows`` with the label of another table, whose sections fit by their name before a ``+``, whatever their case; its spelling is kept."""
    plain = lambda c: F.lower(F.split_part(c, F.lit("+"), F.lit(1)))
    other = labels.select(plain(F.col(section)).alias("_s"), F.col(id_).alias("_i"), F.col(section).alias("canonical"), F.col(label).alias(label))
    keyed = rows.withColumn("_s", plain(F.col(section)))
    return keyed.join(other, (F.col(id_) == F.col("_i")) & (keyed["_s"] == other["_s"]), "left").drop("_s", "_i")


def reindexed(rows: DataFrame, names: DataFrame, key: str, values: list[str]) -> DataFrame:
    """A row for each of ``names``, with zeros where ``rows`` has none."""
    return names.join(rows, key, "left").select(*names.columns, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))


def metric_kind(name: Column) -> Column:
    """What a metric's name is about: ilisi, nmi, ari or mmd, the first that it holds; else null."""
    text = F.lower(name)
    return F.coalesce(*(F.when(text.contains(k), k) for k in ("ilisi", "nmi", "ari", "mmd")))


def cluster_column(columns: list[str], explicit: str | None = None) -> str | None:
    """The column of clusters: the one named, else ``leiden``, else the ``novae_domains_<N>`` of the largest N."""
    if explicit:
        if explicit not in columns:
            raise KeyError(explicit)
        return explicit
    if "leiden" in columns:
        return "leiden"
    numbered = [(int(c.rpartition("_")[2]), c) for c in columns if c.startswith("novae_domains_") and c.rpartition("_")[2].isdigit()]
    return max(numbered)[1] if numbered else None


def rescored(stored: DataFrame, legacy: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """RMSE by seed and feature of stored predictions ``(seed, id, feature, predicted)`` against ``truth``; seeds that only the legacy table has come from it."""
    seeds = stored.select("seed").distinct()
    rows = stored.unionByName(legacy.join(seeds, "seed", "left_anti"))
    e = F.col("predicted") - F.col("target")
    return rows.join(truth, ["id", "feature"]).groupBy("seed", *by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n"))


def log_space(rows: DataFrame, total: float = 1e4) -> DataFrame:
    """Predictions after four treatments: ``(id, feature, as_is, renormed, oracle, logsum)``.

    ``rows(id, feature, target, predicted)`` hold log1p values. Renormed: linear values to ``total`` a row; oracle: to the target's total;
    logsum: log values scaled to the target's sum. Rows without a positive sum are divided by 1, or become 0 in the last.
    """
    lin = lambda c: F.expm1(F.greatest(F.col(c), F.lit(0.0)))
    sums = rows.groupBy("id").agg(F.sum(lin("predicted")).alias("_p"), F.sum(lin("target")).alias("_t"), F.sum("predicted").alias("_lp"), F.sum("target").alias("_lt"))
    joined = rows.join(sums, "id")
    by = F.when(F.col("_p") > 0, F.col("_p")).otherwise(1.0)
    return joined.select(
        "id", "feature", F.col("predicted").alias("as_is"), F.log1p(lin("predicted") / by * total).alias("renormed"), F.log1p(lin("predicted") / by * F.col("_t")).alias("oracle"),
        (F.col("predicted") * F.when(F.col("_lp") > 0, F.col("_lt") / F.col("_lp")).otherwise(0.0)).alias("logsum"),
    )


def tidy(wide: DataFrame, keys: list[str], metrics: list[str], extra: DataFrame | None = None) -> DataFrame:
    """``(*keys, metric, value)`` of the finite values of declared metric columns, and the rows of ``extra`` of that form."""
    long = wide.unpivot(keys, metrics, "metric", "value")
    if extra is not None:
        long = long.unionByName(extra.select(*keys, "metric", "value"))
    return long.where(_finite("value"))


def seed_aggregate(rows: DataFrame, by: list[str], means: list[str], counts: list[str]) -> DataFrame:
    """Over seeds the mean of some columns, and the whole median of counts; null-safe keys, seeds counted."""
    return rows.groupBy(*by).agg(F.count_distinct("seed").alias("n_seeds"), *(F.avg(F.when(_finite(c), F.col(c))).alias(c) for c in means), *(F.median(c).cast("int").alias(c) for c in counts))


def pooled_pearson(rows: DataFrame, by: list[str]) -> DataFrame:
    """Pearson over all entries of ``(target, predicted)``; null below two entries or without variation."""
    out = pearson(rows, by)
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    joined = out.join(n, by) if by else out.join(n, F.lit(True))
    return joined.select(*by, "n", F.when(F.col("n") >= 2, F.col("pearson")).alias("pearson"))


def missing_neighbours(edges: DataFrame) -> DataFrame:
    """How many entries of a neighbour table name no row (below 0), and of how many."""
    return edges.agg(F.count_if(F.col("dst") < 0).alias("missing"), F.count("*").alias("n"))


def tagged_usage(runs: DataFrame, usage: DataFrame) -> DataFrame:
    """Usage rows of each run with its variant's decay, in one table; ``runs(run, beta)``, ``usage(run, ...)``."""
    return usage.join(runs.select("run", "beta").distinct(), "run").where("beta IS NOT NULL")


def similarity_records(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """Ordered pairs of sections of one kind with both donors, and whether these are the same; ``pairs(kind, a, b, similarity)``, ``sections(section, donor)``."""
    both = pairs.unionByName(pairs.where("a <> b").select("kind", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    spec = sections.select("section", "donor")
    named = both.join(spec.withColumnsRenamed({"section": "a", "donor": "donor_a"}), "a").join(spec.withColumnsRenamed({"section": "b", "donor": "donor_b"}), "b")
    return named.select("kind", "a", "b", "donor_a", "donor_b", (F.col("donor_a") == F.col("donor_b")).alias("same_donor"), "similarity")


def recomputed_run(cells: DataFrame, labels: list[str], seed: int, clusters: str | None = None) -> DataFrame:
    """Scores of one run: ``(seed, code_key, label_key, n_cells, nmi, ari, ...)`` of its cluster column against every label column that holds one."""
    column = cluster_column(cells.columns, clusters)
    if column is None:
        raise KeyError("no column of clusters")
    found = labels_present(cells, labels, every=True)
    if not found:
        raise KeyError(f"none of {labels} holds labels")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("label_key"), first_valid(F.col(c)).alias("y")) for c in found)))
    rows = cells.select(F.col(column).alias("x"), pairs.alias("p")).select("x", "p.label_key", "p.y")
    scores = partition_scores(contingency(rows, F.col("x"), F.col("y"), "label_key"), "label_key")
    return scores.select(F.lit(seed).alias("seed"), F.lit(column).alias("code_key"), *scores.columns)
