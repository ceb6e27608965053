"""Exact medians of groups of any size, without a buffer that grows with the group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Rank error of the sketch, as a share of the group: the bracket holds about four such shares of its rows.
ACCURACY = 10_000
#: Brackets are broadcast up to so many groups, and joined by a shuffle beyond.
MAX_BROADCAST_GROUPS = 100_000


def medians(df: DataFrame, by: list[str], value: str, accuracy: int = ACCURACY) -> DataFrame:
    """``(*by, median, n)``: the exact median of the values of each group that are neither null nor NaN, as double, and their number; none: null and 0.

    A first pass merges quantile sketches, of a stated rank error, into a bracket around the middle ranks. A second pass counts, map side first, the
    rows below the bracket and the distinct values in it, of which there are about ``4 n / accuracy``; only these are ordered. If a sketch
    were worse than stated, so that a middle rank lay outside its bracket, the job would fail and not answer wrongly. Null keys are a group. An even
    number of rows gives the mean of the two in the middle. With no ``by`` the whole table is one group. Empty table: no rows, or without ``by`` one of null and 0.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    rows = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)), F.when(~F.isnan(v), v).alias("_v"))
    near = min(2.0 / accuracy, 0.25)
    bounds = rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.percentile_approx("_v", [0.5 - near, 0.5 + near], accuracy).alias("_b"))
    bounds = checkpointed(bounds.select(*(F.col(k).alias(f"b{k}") for k in keys), "n", F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high")))
    few = bounds.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"b{k}")) for k in keys), F.lit(True))
    # rows below the bracket are one entry, with a null value, which comes first; those above aren't needed
    held = rows.join(F.broadcast(bounds) if few else bounds, same).where("_v <= _high")
    counted = held.groupBy(*keys, "n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    # the rank of the first of an entry's rows lies behind those of the entries before it
    placed = counted.withColumn("_to", upto)
    at = lambda rank: F.min_by("_v", F.when(F.col("_to") >= rank, F.col("_to")))
    middle = placed.groupBy(*keys, "n").agg(at(F.floor((F.col("n") + 1) / 2)).alias("_a"), at(F.floor(F.col("n") / 2) + 1).alias("_z"))
    outside = F.raise_error(F.lit("the sketch's bracket misses the median: raise the accuracy"))
    exact = middle.select(*keys, F.when(F.col("_a").isNull() | F.col("_z").isNull(), outside.cast("double")).otherwise(0.5 * F.col("_a") + 0.5 * F.col("_z")).alias("median"))
    # groups without a value have no entry
    all_groups = bounds.select(*(F.col(f"b{k}") for k in keys), "n")
    out = all_groups.join(F.broadcast(exact) if few else exact, same, "left")
    return out.select(*(F.col(f"b{k}").alias(c) for k, c in zip(keys, by, strict=True)), "median", "n")
