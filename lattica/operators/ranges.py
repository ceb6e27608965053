"""Running numbers and totals over whole tables: ranges are worked on apart, and each adds the totals of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with a running total, its own row included, of each of ``totals`` by ``order``, which must tell rows apart.

    Rows are dealt into ranges of the order, once and stored; each range is summed by one window, and one row for each range carries the sums
    of those before it. No task sees more than its range.
    """
    ranges = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranges.groupBy("_p").agg(*(F.sum(c).alias(f"_{n}") for n, c in totals.items()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sums.select("_p", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals))
    placed = ranges.withColumns({f"_in_{n}": F.sum(c).over(inside) for n, c in totals.items()})
    return placed.join(F.broadcast(offsets), "_p").select(*df.columns, *((F.col(f"_in_{n}") + F.col(f"_{n}")).alias(n) for n in totals))


def numbered(df: DataFrame, order: str, out: str = "_n") -> DataFrame:
    """``df`` with ``out`` = 0, 1, ... by a column that tells rows apart."""
    return running_totals(df, [F.col(order)], {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1)
