"""Significance tests, intervals and multiple-testing correction over tables of repeated measurements."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from .ranges import running_totals


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t; NaN for missing input."""
    if not (math.isfinite(df) and df > 0) or math.isnan(t):
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def student_p(t: Column, dof: Column) -> Column:
    """The two-sided p of Student's t, for tables of results: an Arrow function over batches of rows."""

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([student_two_sided(float(x), float(y)) for x, y in zip(a.astype(float), b.astype(float), strict=True)])

    return F.pandas_udf(batch, "double")(t, dof)


def student_quantile(df: int, p: float = 0.975) -> float:
    """The quantile of Student's t by bisection of its tail."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_two_sided(mid, df) / 2 > 1 - p else (low, mid)
    return low


#: Quantiles of 0.975 for 1 to 30 degrees of freedom; a rule fills the table. Larger ones are computed as they occur.
T_975 = [round(student_quantile(k), 9) for k in range(1, 31)]


def half_width(sd: Column, n: Column, kind: str = "ci95") -> Column:
    """Half-width of an error bar: 95 % interval of the mean, standard error or deviation; 0 below two values."""
    if kind == "std":
        return F.when(n < 2, 0.0).otherwise(sd)
    sem = sd / F.sqrt(n.cast("double"))
    if kind == "sem":
        return F.when(n < 2, 0.0).otherwise(sem)

    def quantiles(dof: pd.Series) -> pd.Series:
        own = {k: T_975[int(k) - 1] if 1 <= k <= len(T_975) else student_quantile(int(k)) if k > 0 else math.nan for k in dof.dropna().unique()}
        return dof.map(own).astype(float)

    t = F.pandas_udf(quantiles, "double")((n - 1).cast("long"))
    return F.when(n < 2, 0.0).otherwise(t * sem)


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and sample variance of the finite values of each group."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(finite).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def welch(df: DataFrame, group: str, reference: str, by: list[str], value: str) -> DataFrame:
    """Welch's t and degrees of freedom of each group against the reference group, for each of ``by``.

    Fewer than two values on a side: null. No variance on either side: t is null and
    ``degenerate`` is true (its p is 1 by the convention of the table driver).
    """
    m = moments(df, [*by, group], value)
    ref = m.where(F.col(group) == reference).select(*by, *(F.col(c).alias(f"r_{c}") for c in ("n", "mean", "var")))
    both = m.where(F.col(group) != reference).join(ref, by) if by else m.where(F.col(group) != reference).join(F.broadcast(ref), F.lit(True))
    enough = (F.col("n") >= 2) & (F.col("r_n") >= 2)
    a, b = F.col("var") / F.col("n"), F.col("r_var") / F.col("r_n")
    t = ratio(F.col("mean") - F.col("r_mean"), F.sqrt(a + b))
    dof = ratio((a + b) * (a + b), a * a / (F.col("n") - 1) + b * b / (F.col("r_n") - 1))
    return both.select(*by, group, F.when(enough, t).alias("t"), F.when(enough, dof).alias("dof"), F.when(enough, (a + b) == 0).alias("degenerate"))


def welch_p(tests: DataFrame) -> DataFrame:
    """The two-sided p of a table of :func:`welch`; 1 where degenerate, null where there was no test."""
    p = F.when(F.col("degenerate"), 1.0).when(F.col("t").isNotNull(), student_p(F.col("t"), F.col("dof")))
    return tests.withColumn("p", p)


def paired(df: DataFrame, by: list[str], pair: str, group: str, a: str, b: str, value: str) -> DataFrame:
    """Paired t of the groups ``a`` and ``b``, matched by ``pair``, over pairs that both have."""
    v = F.col(value).cast("double")
    wide = df.where(F.col(group).isin(a, b)).groupBy(*by, pair).agg(F.max(F.when(F.col(group) == a, v)).alias("a"), F.max(F.when(F.col(group) == b, v)).alias("b"))
    d = wide.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    m = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return m.select(*by, "n", "mean", ratio(F.col("mean"), F.col("sd") / F.sqrt(F.col("n").cast("double"))).alias("t"), (F.col("n") - 1).cast("double").alias("dof"))


def _tied_ranks(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """``counts`` of distinct values with ``rank``, the mean rank of each value's ``c`` rows. Without groups the values are ranked by ranges, as they can be as many as rows."""
    if by:
        upto = counts.withColumn("_upto", F.sum("c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        upto = running_totals(counts, [F.col(value)], {"_upto": F.col("c")})
    return upto.withColumn("rank", F.col("_upto") - (F.col("c") - 1) / F.lit(2.0)).drop("_upto")


def mann_whitney(df: DataFrame, by: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """U of group ``a`` against ``b`` by average ranks, and its normal z with tie correction."""
    v = F.col(value).cast("double")
    rows = df.where(F.col(group).isin(a, b) & v.isNotNull()).select(*by, group, v.alias("v"))
    ties = rows.groupBy(*by, "v").agg(F.count("*").alias("c"), F.count_if(F.col(group) == a).alias("ca"))
    ranked = _tied_ranks(ties, by, "v")
    c = F.col("c").cast("double")
    agg = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("ca")).alias("r"), F.sum("ca").cast("double").alias("na"), F.sum(F.col("c") - F.col("ca")).cast("double").alias("nb"), F.sum(c * c * c - c).alias("ties"))
    n = F.col("na") + F.col("nb")
    u = F.col("r") - F.col("na") * (F.col("na") + 1) / 2.0
    var = F.col("na") * F.col("nb") / 12.0 * ((n + 1) - ratio(F.col("ties"), n * (n - 1)))
    return agg.select(*by, u.alias("u"), ratio(u - F.col("na") * F.col("nb") / 2.0, F.sqrt(var)).alias("z"), F.col("na").cast("long").alias("na"), F.col("nb").cast("long").alias("nb"), "ties")


def _u_counts(na: int, nb: int) -> list[int]:
    """In how many orders of two samples each U occurs: products of (1 - q^(nb + i)) / (1 - q^i)."""
    ways = [1] + [0] * (na * nb)
    for i in range(1, na + 1):
        for u in range(na * nb, nb + i - 1, -1):
            ways[u] -= ways[u - nb - i]
        for u in range(i, na * nb + 1):
            ways[u] += ways[u - i]
    return ways


def _signed_rank_counts(n: int) -> list[int]:
    """How many of the sign choices of the ranks 1 to n give each sum of positive ranks."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for w in range(len(ways) - 1, rank - 1, -1):
            ways[w] += ways[w - rank]
    return ways


def _two_sided(ways: list[int], value: float) -> float:
    """Twice the smaller tail of a count distribution, at most 1."""
    at = int(value)
    return min(1.0, 2 * min(sum(ways[: at + 1]), sum(ways[at:])) / sum(ways))


def mann_whitney_p(tests: DataFrame) -> DataFrame:
    """The two-sided p of a table of :func:`mann_whitney`, null below two values a side.

    Exact without ties where a side has at most 8 values, else the normal approximation with corrections for ties and continuity.
    """
    def p_of(u: pd.Series, na: pd.Series, nb: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for x, a, b, t in zip(u, na, nb, ties, strict=True):
            if a < 2 or b < 2:
                out.append(None)
            elif t == 0 and min(a, b) <= 8:
                out.append(_two_sided(_u_counts(int(a), int(b)), x))
            else:
                n = a + b
                sd = math.sqrt(a * b / 12.0 * (n + 1 - t / (n * (n - 1))))
                out.append(min(1.0, math.erfc((max(x, a * b - x) - a * b / 2 - 0.5) / sd / math.sqrt(2))) if sd else 1.0)
        return pd.Series(out, dtype=float)

    return tests.withColumn("p", F.pandas_udf(p_of, "double")("u", "na", "nb", "ties"))


def wilcoxon(df: DataFrame, by: list[str], pair: str, group: str, a: str, b: str, value: str) -> DataFrame:
    """Signed-rank test of the groups ``a`` and ``b`` matched by ``pair``: ``(n, w, ties, p)``, ``w`` the sum of positive ranks.

    Pairs without a difference go. Exact up to 50 pairs without ties or equal pairs, else normal. No pair left: no row.
    """
    v = F.col(value).cast("double")
    wide = df.where(F.col(group).isin(a, b)).groupBy(*by, pair).agg(F.max(F.when(F.col(group) == a, v)).alias("a"), F.max(F.when(F.col(group) == b, v)).alias("b"))
    d = wide.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    at = d.where("d <> 0").groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = _tied_ranks(at, by, "size")
    c = F.col("c").cast("double")
    sums = ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(c * c * c - c).alias("ties"))
    equal = d.groupBy(*by).agg(F.count_if(F.col("d") == 0).alias("equal"))
    sums = sums.join(equal, by) if by else sums.join(equal, F.lit(True))

    def p_of(n: pd.Series, w: pd.Series, ties: pd.Series, equal: pd.Series) -> pd.Series:
        out = []
        for m, x, t, e in zip(n, w, ties, equal, strict=True):
            if m <= 50 and t == 0 and e == 0:
                out.append(_two_sided(_signed_rank_counts(int(m)), x))
            else:
                sd = math.sqrt((m * (m + 1) * (2 * m + 1) - t / 2) / 24)
                out.append(math.erfc(abs(x - m * (m + 1) / 4) / sd / math.sqrt(2)))
        return pd.Series(out, dtype=float)

    return sums.withColumn("p", F.pandas_udf(p_of, "double")("n", "w", "ties", "equal")).select(*by, "n", "w", "ties", "p")


def holm(df: DataFrame, p: str, *by: str, order: str) -> DataFrame:
    """Holm-Bonferroni: ``p_holm`` by rising p within each of ``by``; a null p has none and doesn't count."""
    group = Window.partitionBy(*by)
    known = F.col(p).isNotNull()
    step = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), order)
    n = F.count_if(known).over(group)
    scaled = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(step) + 1))
    return df.withColumn("_scaled", scaled).withColumn("p_holm", F.when(known, F.max("_scaled").over(step.rowsBetween(Window.unboundedPreceding, 0)))).drop("_scaled")
