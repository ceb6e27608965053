"""Agreement of two partitions of the same rows, code usage, and overlap reports.

Everything goes through the contingency table, which one combined aggregate
makes: its size is that of the distinct pairs of labels, whatever the number of rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pairs_of, ratio, x_log_x


def contingency(df: DataFrame, x: Column, y: Column, *by: str) -> DataFrame:
    """``(by..., x, y, n)`` over the rows where both labels are known."""
    rows = df.select(*by, x.cast("string").alias("x"), y.cast("string").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy(*by, "x", "y").agg(F.count("*").alias("n"))


def partition_scores(table: DataFrame, *by: str) -> DataFrame:
    """NMI (arithmetic mean of entropies), ARI and sizes for each group of a contingency table.

    Two partitions into one part each agree perfectly: both scores are 1.
    """
    rows = table.groupBy(*by, "x").agg(F.sum("n").alias("n"))
    cols = table.groupBy(*by, "y").agg(F.sum("n").alias("n"))
    joint = table.groupBy(*by).agg(F.sum("n").alias("n_cells"), F.sum(x_log_x(F.col("n").cast("double"))).alias("s_xy"), F.sum(pairs_of(F.col("n"))).alias("p_xy"))
    side_x = rows.groupBy(*by).agg(F.count("*").alias("n_x"), F.sum(x_log_x(F.col("n").cast("double"))).alias("s_x"), F.sum(pairs_of(F.col("n"))).alias("p_x"))
    side_y = cols.groupBy(*by).agg(F.count("*").alias("n_y"), F.sum(x_log_x(F.col("n").cast("double"))).alias("s_y"), F.sum(pairs_of(F.col("n"))).alias("p_y"))
    all_ = joint.join(side_x, list(by)).join(side_y, list(by)) if by else joint.join(side_x, F.lit(True)).join(side_y, F.lit(True))  # one row each
    n = F.col("n_cells").cast("double")
    h_x, h_y, h_xy = (F.ln(n) - F.col(c) / n for c in ("s_x", "s_y", "s_xy"))
    mi = F.greatest(h_x + h_y - h_xy, F.lit(0.0))
    one = (F.col("n_x") == 1) & (F.col("n_y") == 1)
    expected = ratio(F.col("p_x") * F.col("p_y"), pairs_of(F.col("n_cells")))
    top = F.col("p_xy") - expected
    bottom = (F.col("p_x") + F.col("p_y")) / 2.0 - expected
    return all_.select(
        *by,
        F.when(one, 1.0).otherwise(F.coalesce(ratio(2.0 * mi, h_x + h_y), F.lit(0.0))).alias("nmi"),
        F.when(one, 1.0).otherwise(F.coalesce(ratio(top, bottom), F.lit(1.0))).alias("ari"),
        "n_cells", "n_x", "n_y",
    )


def adjusted_mutual_information(table: DataFrame, *by: str) -> DataFrame:
    """AMI (arithmetic mean) for each group of a contingency table.

    The expected mutual information sums, for every pair of a row total a and a column total b, over
    the possible joint counts. Pairs of equal totals are grouped first, so the work follows the number of distinct
    totals; log-factorials come from a running sum over the numbers that occur.
    """
    key = [F.col(c) for c in by]
    rows = table.groupBy(*by, "x").agg(F.sum("n").alias("t")).groupBy(*by, "t").agg(F.count("*").alias("m"))
    cols = table.groupBy(*by, "y").agg(F.sum("n").alias("t")).groupBy(*by, "t").agg(F.count("*").alias("m"))
    total = table.groupBy(*by).agg(F.sum("n").alias("n"))
    # log-factorials by Stirling's series: exact to double precision from 16 on, by product below
    def log_factorial(k: Column) -> Column:
        z = k.cast("double") + 1.0
        series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
        small = F.ln(F.factorial(F.least(k.cast("int"), F.lit(16))).cast("double"))
        return F.when(k <= 16, small).otherwise(series)

    pairs = rows.select(*key, F.col("t").alias("a"), F.col("m").alias("ma"))
    other = cols.select(*key, F.col("t").alias("b"), F.col("m").alias("mb"))
    pairs = (pairs.join(other, list(by)).join(total, list(by)) if by else pairs.join(other, F.lit(True)).join(total, F.lit(True))).where("n > 0")
    # joint counts beyond 12 deviations and 64 from the mean have chances below 1e-30; the others are made in chunks of bounded length
    a, b, n = (F.col(c).cast("double") for c in ("a", "b", "n"))
    reach = F.sqrt(a * b / n * (n - a) / n * (n - b) / F.greatest(n - 1, F.lit(1.0))) * 12 + 64
    low = F.greatest(F.lit(1).cast("long"), F.col("a") + F.col("b") - F.col("n"), F.floor(a * b / n - reach))
    high = F.least(F.col("a"), F.col("b"), F.ceil(a * b / n + reach))
    chunks = pairs.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("from", F.explode(F.sequence("low", "high", F.lit(4096).cast("long"))))
    terms = chunks.withColumn("k", F.explode(F.sequence("from", F.least(F.col("high"), F.col("from") + 4095))))
    n, a, b, k = (F.col(c) for c in ("n", "a", "b", "k"))
    chance = F.exp(log_factorial(a) + log_factorial(b) + log_factorial(n - a) + log_factorial(n - b) - log_factorial(n) - log_factorial(k) - log_factorial(a - k) - log_factorial(b - k) - log_factorial(n - a - b + k))
    term = k / n.cast("double") * (F.ln(n.cast("double")) + F.ln(k.cast("double")) - F.ln(a.cast("double")) - F.ln(b.cast("double"))) * chance
    expected = terms.groupBy(*by).agg(F.sum(term * F.col("ma") * F.col("mb")).alias("emi"))
    scores = _entropies(table, *by)
    both = scores.join(expected, list(by)) if by else scores.join(expected, F.lit(True))
    one = (F.col("n_x") == 1) & (F.col("n_y") == 1)
    return both.select(*by, F.when(one, 1.0).otherwise(ratio(F.col("mi") - F.col("emi"), (F.col("h_x") + F.col("h_y")) / 2.0 - F.col("emi"))).alias("ami"))


def _entropies(table: DataFrame, *by: str) -> DataFrame:
    rows = table.groupBy(*by, "x").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.count("*").alias("n_x"), F.sum(x_log_x(F.col("n").cast("double"))).alias("s_x"))
    cols = table.groupBy(*by, "y").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.count("*").alias("n_y"), F.sum(x_log_x(F.col("n").cast("double"))).alias("s_y"))
    joint = table.groupBy(*by).agg(F.sum("n").cast("double").alias("n"), F.sum(x_log_x(F.col("n").cast("double"))).alias("s_xy"))
    both = joint.join(rows, list(by)).join(cols, list(by)) if by else joint.join(rows, F.lit(True)).join(cols, F.lit(True))
    h_x, h_y, h = (F.ln("n") - F.col(c) / F.col("n") for c in ("s_x", "s_y", "s_xy"))
    return both.select(*by, "n_x", "n_y", h_x.alias("h_x"), h_y.alias("h_y"), (h_x + h_y - h).alias("mi"))


def overlap_report(df: DataFrame, keys: list[str], split: str | None = None) -> DataFrame:
    """Scores of all pairs of label columns, on the rows where both are known; with ``split`` also of each split."""
    labels = [F.struct(F.lit(a).alias("x_key"), F.lit(b).alias("y_key"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(keys, 2)]
    splits = F.array(F.lit("all"), F.col(split).cast("string")) if split else F.array(F.lit("all"))
    rows = df.select(F.explode(splits).alias("split"), F.array(*labels).alias("pairs")).where("split IS NOT NULL").select("split", F.explode("pairs").alias("p")).select("split", "p.*")
    by = ["split", "x_key", "y_key"]
    return partition_scores(contingency(rows, F.col("x"), F.col("y"), *by), *by)


def weighted_label_scores(scores: DataFrame, keys: list[str], metrics: list[str], weight: str, source: str) -> DataFrame:
    """Means of ``metrics`` weighted by ``weight`` for each key, the weights' sum, and the sources joined by ``;``."""
    w = F.col(weight).cast("double")
    return scores.groupBy(*keys).agg(
        *(ratio(F.sum(F.col(m) * w), F.sum(F.when(F.col(m).isNotNull(), w))).alias(m) for m in metrics),
        F.sum(weight).alias(weight), F.array_join(F.array_sort(F.collect_set(source)), ";").alias("sources"),
    )


def code_usage(df: DataFrame, code: Column, size: int | None, *by: str) -> DataFrame:
    """Use of a codebook: size, codes used and dead, perplexity, entropy in bits, largest share.

    ``size`` is the nominal size; None takes the largest code plus one.
    """
    counts = df.select(*by, code.alias("code")).where("code IS NOT NULL").groupBy(*by, "code").agg(F.count("*").alias("n"))
    agg = counts.groupBy(*by).agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_used"), F.sum(x_log_x(F.col("n").cast("double"))).alias("s"), F.max("n").alias("top"), (F.max("code") + 1).alias("seen"))
    n = F.col("n_cells").cast("double")
    k = F.lit(size) if size is not None else F.col("seen")
    h = F.greatest(F.ln(n) - F.col("s") / n, F.lit(0.0))
    return agg.select(
        *by, "n_cells", k.cast("long").alias("codebook_size"), "n_used", (k - F.col("n_used")).cast("long").alias("n_dead"), ratio(F.col("n_used"), k).alias("active_fraction"),
        F.exp(h).alias("perplexity"), ratio(F.exp(h), k).alias("normalized_perplexity"), (h / F.lit(0.6931471805599453)).alias("entropy_bits"), ratio(F.col("top"), n).alias("max_code_share"),
    )


def usage_summary(usage: DataFrame, *by: str) -> DataFrame:
    """Mean and sample deviation over seeds of a usage table's fractions."""
    metrics = ["active_fraction", "normalized_perplexity", "max_code_share"]
    aggs = [f(m).alias(f"{m}_{kind}") for m in metrics for kind, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return usage.groupBy(*by).agg(F.count("*").alias("n_seeds"), F.first("codebook_size").alias("codebook_size"), *aggs)


def distributions(df: DataFrame, group: str, code: str) -> DataFrame:
    """``(group, code, p)``: each group's shares over the codes seen anywhere, zeros included."""
    counts = df.groupBy(group, code).agg(F.count("*").alias("n")).where(f"{group} IS NOT NULL AND {code} IS NOT NULL")
    grid = counts.select(group).distinct().join(counts.select(code).distinct(), F.lit(True))  # groups by codes, as the result
    filled = grid.join(counts, [group, code], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select(group, code, (F.col("n") / F.sum("n").over(Window.partitionBy(group))).alias("p"))


def jsd_similarity(shares: DataFrame, group: str, code: str) -> DataFrame:
    """``(source, target, similarity)`` of all ordered pairs of groups: 1 - Jensen-Shannon distance, base 2.

    Computed from the codes that two groups share: with S = sum over shared codes of
    (p + q) log2(p + q) - p log2 p - q log2 q, the divergence is 1 - S / 2.
    """
    p = shares.where("p > 0").select(F.col(group).alias("source"), F.col(code).alias("code"), F.col("p"))
    q = shares.where("p > 0").select(F.col(group).alias("target"), F.col(code).alias("code"), F.col("p").alias("q"))
    lg = lambda v: v * F.log2(v)
    both = p.join(q, "code").groupBy("source", "target").agg(F.sum(lg(F.col("p") + F.col("q")) - lg(F.col("p")) - lg(F.col("q"))).alias("s"))
    groups = shares.select(group).distinct()
    grid = groups.select(F.col(group).alias("source")).join(groups.select(F.col(group).alias("target")), F.lit(True))  # all pairs are the result
    js = 1.0 - F.coalesce("s", F.lit(0.0)) / 2.0
    return grid.join(both, ["source", "target"], "left").select("source", "target", (1.0 - F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), js)))).alias("similarity"))


def similarity_ranks(similarity: DataFrame) -> DataFrame:
    """Other groups of each source by falling similarity, missing ones last, ties by name."""
    order = Window.partitionBy("source").orderBy(F.col("similarity").isNull() | F.isnan("similarity"), F.desc("similarity"), "target")
    return similarity.where("source <> target").withColumn("rank", F.row_number().over(order))


def transition_matrix(df: DataFrame, before: str, after: str) -> DataFrame:
    """``(before, after, n, share)``: counts and their shares of each row."""
    counts = df.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def roll_up(probabilities: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Probability mass of each label of each level: ``labels(code, level, label)``, ``probabilities(key, code, p)``."""
    return probabilities.join(labels, "code").groupBy(key, "level", "label").agg(F.sum("p").alias("p"))


def feasibility(df: DataFrame, label: str, batch: str, min_cells: int = 10) -> DataFrame:
    """Whether labels can be scored across batches: those with enough cells in two batches or more, and a verdict."""
    cells = df.where(F.col(label).isNotNull() & F.col(batch).isNotNull()).groupBy(label, batch).agg(F.count("*").alias("n"))
    per = cells.groupBy(label).agg(F.sum("n").alias("n"), F.count("*").alias("batches"))
    ok = (F.col("n") >= min_cells) & (F.col("batches") >= 2)
    out = per.agg(F.count("*").alias("n_labels"), F.count_if(ok).alias("n_scorable"), F.sum("n").alias("n_cells"), F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("scorable_cells"))
    share = ratio(F.col("scorable_cells"), F.col("n_cells"))
    return out.withColumn("share", share).withColumn("verdict", F.when(share >= 0.75, "OK").when(share > 0, "PARTIAL").otherwise("NOT FEASIBLE"))


def decoded_profiles(shares: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(id, feature, weighted, picked)``: profiles of tokens mixed by their shares, and that of the token of the largest share (ties: the least token).

    ``shares(id, token, p)``, ``profiles(token, feature, value)``; tokens without a profile add nothing, and an id none of whose tokens has one is absent. Where only the picked token lacks the feature, picked is null.
    """
    top = shares.groupBy("id").agg(F.min_by("token", F.struct((-F.col("p")).alias("p"), F.col("token"))).alias("_top"))
    both = shares.join(profiles, "token").join(top, "id")
    return both.groupBy("id", "feature").agg(F.sum(F.col("p") * F.col("value")).alias("weighted"), F.max(F.when(F.col("token") == F.col("_top"), F.col("value"))).alias("picked"))
