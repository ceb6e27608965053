"""Reconstruction panel: how well predicted values follow the targets, by row, by column and pooled.

Values are sparse: ``(row, col, target, predicted)`` holds the entries where either is not zero, and
the numbers of rows and columns give the zeros their weight. Dense input is the same table without gaps.
Sums are of doubles; a vector without variance has no correlation (null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .ranges import running_totals


def _about_mean(c: Column, mean_x: Column, mean_y: Column, n: Column) -> Column:
    """What the zeros left out add to a sum of products about the means of ``c`` of ``n`` entries."""
    return c * mean_x * mean_y * (1 - c / n)


def pearson(df: DataFrame, by: list[str], n: Column | None = None, a: str = "target", b: str = "predicted") -> DataFrame:
    """Pearson of ``a`` and ``b`` for each group; ``n`` entries each if zeros are left out, else its rows. Entries with a null are left out.

    Moments about the mean, which merge without loss where means are large and deviations small; a deviation below ``1e-13`` of the mean is none.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = df.where(x.isNotNull() & y.isNotNull()).groupBy(*by)
    m = both.agg(F.count("*").cast("double").alias("_c"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    c = F.col("_c")
    n = (c if n is None else n).cast("double")
    sums = {name: c * F.col(v) + _about_mean(c, F.col(p), F.col(q), n) for name, v, p, q in (("xy", "cxy", "mx", "my"), ("xx", "vx", "mx", "mx"), ("yy", "vy", "my", "my"))}
    flat = (sums["xx"] <= c * F.col("mx") * F.col("mx") * 1e-26) | (sums["yy"] <= c * F.col("my") * F.col("my") * 1e-26)
    return m.select(*by, F.when(~flat, sums["xy"] / F.sqrt(sums["xx"] * sums["yy"])).alias("pearson"))


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``out``: the rank of each value within its group, equal values sharing their mean rank. Distinct values are ranked, not rows."""
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    if by:
        ranked = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ranked = running_totals(counts, [F.col("_v")], {"_upto": F.col("_c")})
    ranked = ranked.select(*(F.col(c).alias(f"_{c}") for c in by), "_v", (F.col("_upto") - (F.col("_c") - 1) / F.lit(2.0)).cast("double").alias(out))
    same = F.col(value).eqNullSafe(F.col("_v"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(ranked, same).select(*df.columns, out)


def spearman(df: DataFrame, by: list[str], a: str = "target", b: str = "predicted") -> DataFrame:
    """Pearson of average ranks of dense groups."""
    ranked = average_ranks(average_ranks(df, by, a, "_ra"), by, b, "_rb")
    return pearson(ranked, by, a="_ra", b="_rb").withColumnRenamed("pearson", "spearman")


def rmse(df: DataFrame, n_entries: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Root of the mean squared error; the same over rows and over columns of one table."""
    d = F.col("target").cast("double") - F.col("predicted").cast("double")
    n = F.count("*") if n_entries is None else n_entries
    return df.groupBy(*(by or [])).agg(F.sqrt(F.sum(d * d) / n).alias("rmse"))


def mse_variants(df: DataFrame) -> DataFrame:
    """Pooled error, that of expressed entries, of zeros, and the mean of both (balanced)."""
    d = F.col("target").cast("double") - F.col("predicted").cast("double")
    on, off = F.when(F.col("target") > 0, d * d), F.when(F.col("target") <= 0, d * d)
    return df.agg(F.avg(d * d).alias("pooled"), F.avg(on).alias("expressed"), F.avg(off).alias("zeros"), ((F.avg(on) + F.avg(off)) / 2.0).alias("balanced"))


def _thresholds(df: DataFrame, label: Column, score: str, by: list[str]) -> DataFrame:
    """Positives and negatives at each distinct finite score, and those at higher ones: one row per score."""
    s = F.col(score).cast("double")
    rows = df.where(s.isNotNull() & ~F.isnan(s) & label.isNotNull()).select(*by, s.alias("s"), label.cast("int").alias("y"))
    at = rows.groupBy(*by, "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    if not by:  # distinct scores can be as many as rows
        totals = at.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        return running_totals(at, [F.desc("s")], {"tp": F.col("pos"), "fp": F.col("neg")}).join(F.broadcast(totals), F.lit(True))
    above = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    return at.select(*by, "s", "pos", "neg", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(all_).alias("p"), F.sum("neg").over(all_).alias("n"))


def auroc(df: DataFrame, label: Column, score: str, *by: str) -> DataFrame:
    """Area under the ROC curve, ties counting half; null with one class."""
    t = _thresholds(df, label, score, list(by))
    area = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / F.lit(2.0)))
    return t.groupBy(*by).agg(ratio(area, F.max("p").cast("double") * F.max("n")).alias("auroc"))


def average_precision(df: DataFrame, label: Column, score: str, *by: str) -> DataFrame:
    """Sum over falling thresholds of precision times the gain in recall; null without positives."""
    t = _thresholds(df, label, score, list(by))
    return t.groupBy(*by).agg(ratio(F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))), F.max("p")).alias("average_precision"))


def top_variance(expr: DataFrame, n_cells: int, n: int) -> DataFrame:
    """The ``n`` genes of largest population variance of log1p values, zeros included; ties by gene."""
    v = F.log1p(F.col("value").cast("double"))
    m = expr.groupBy("gene_id").agg(F.count(v).cast("double").alias("c"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    var = (F.col("c") * F.col("v") + _about_mean(F.col("c"), F.col("m"), F.col("m"), F.lit(float(n_cells)))) / n_cells
    top = m.select("gene_id", var.alias("variance")).orderBy(F.desc("variance"), "gene_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "gene_id")))


def marker_genes(expr: DataFrame, labels: DataFrame, per_label: int = 10) -> DataFrame:
    """Of each label the genes whose mean in it exceeds the grand mean the most: ``(label, gene_id, score, rank)``."""
    n_of = labels.groupBy("label").agg(F.count("*").alias("n"))
    n_all = labels.count()
    joined = expr.join(labels, "cell_id")
    inside = joined.groupBy("label", "gene_id").agg(F.sum("value").alias("s"))
    overall = joined.groupBy("gene_id").agg((F.sum("value") / n_all).alias("grand"))
    genes = overall.join(n_of, F.lit(True))  # genes by labels: each has a score
    score = F.coalesce(F.col("s"), F.lit(0.0)) / F.col("n") - F.col("grand")
    scored = genes.join(inside, ["label", "gene_id"], "left").select("label", "gene_id", score.alias("score"))
    order = Window.partitionBy("label").orderBy(F.desc("score"), "gene_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label)


def depth_rescaled(df: DataFrame, depth: str, key: str = "row") -> DataFrame:
    """Counts of log predictions: ``expm1``, scaled to the row's share, times its depth; rows of no sum stay 0."""
    v = F.expm1(F.greatest(F.col("predicted").cast("double"), F.lit(0.0)))
    total = F.sum(v).over(Window.partitionBy(key))
    return df.withColumn("counts", F.coalesce(ratio(v, total), F.lit(0.0)) * F.col(depth))


def rank_tokens(expr: DataFrame, length: int, offset: int = 0) -> DataFrame:
    """Per cell its expressed genes by falling value (ties by gene), at most ``length``, shifted and zero-padded."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), F.col("gene_id"))))
    top = F.transform(F.slice(ordered, 1, length), lambda s: s["gene_id"] + offset)
    cells = expr.where("value > 0").groupBy("cell_id").agg(top.alias("tokens"))
    return cells.select("cell_id", F.concat("tokens", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("tokens"))).alias("tokens"))


def panel(df: DataFrame, splits: str, subset: DataFrame | None = None) -> DataFrame:
    """Mean and median of row-wise and column-wise Pearson, and RMSE, of each split and of all rows.

    ``df(row, col, target, predicted)`` is dense; ``splits`` names its column of splits. With ``subset(col)``
    column-wise figures of those columns are added as gene subset ``subset``.
    """
    rows = df.withColumn("split", F.explode(F.array(F.lit("all"), F.col(splits)))).drop(splits) if splits != "split" else df.withColumn("split", F.explode(F.array(F.lit("all"), F.col("split"))))
    parts = [("cell_wise", "all", "row", rows), ("gene_wise", "all", "col", rows)]
    if subset is not None:
        parts.append(("gene_wise", "subset", "col", rows.join(subset.select("col").distinct(), "col", "left_semi")))
    out = None
    for axis, name, key, part in parts:
        p = pearson(part, ["split", key]).groupBy("split").agg(F.avg("pearson").alias("pearson_mean"), F.median("pearson").alias("pearson_median"), F.count("*").alias("n_vectors"))
        both = p.join(rmse(part, by=["split"]), "split").select(F.lit(axis).alias("axis"), F.lit(name).alias("gene_subset"), "split", "pearson_mean", "pearson_median", "rmse", "n_vectors")
        out = both if out is None else out.unionByName(both)
    return out
