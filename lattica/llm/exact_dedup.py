"""Exact duplicates with a heavy-hitter split, in DataFrame operations only.

1. A frequent-items sketch of the Misra-Gries family (bounded counters that are lowered when they are full) runs over
   the text digests: each task fills one, groups of tasks merge theirs, and the groups' are merged. Only sketches
   are shuffled. A digest with more than a ``2 / (capacity + 1)`` share of all rows is always found.
2. The candidates are counted exactly; those with two rows or more are verified heavy,
   and the row that stays of each is found by a combined aggregate. At most
   ``capacity`` rows of fixed width: a proven bound for the broadcast.
3. The winners are broadcast and settle all rows of heavy digests where they are read.
   The remaining digests, none of them frequent, are shuffled in the ordinary way, and a combined aggregate finds their winners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .text import SPACES

#: Frequent digests at most; rows that are broadcast, of about 100 bytes each.
CAPACITY = 512
#: Counters of a sketch for each of these. Its error is 3.5 / counters of all rows at most, so a share of 7 / counters is always found.
COUNTERS = 4
#: Groups of tasks whose sketches are merged first, so that no task merges those of all.
MERGERS = 256


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def misra_gries(df: DataFrame, key: str, capacity: int = CAPACITY, *figures: Column) -> DataFrame:
    """``(key, counter)`` of the frequent keys, and aggregates of their rows: at most ``capacity`` rows.

    Keys whose share of the rows exceeds ``2 / (capacity + 1)`` are always among them;
    counters are exact, as the sketch only names candidates. Null keys are left out. No rows: none.
    """
    held = max(16, COUNTERS * capacity)
    by_task = df.where(F.col(key).isNotNull()).groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_g")).agg(F.expr(f"approx_top_k_accumulate(`{key}`, {held})").alias("s"))
    found = by_task.groupBy(F.lit("all").alias("_all")).agg(F.expr(f"approx_top_k_combine(s, {held})").alias("s"))  # a sketch for each group of tasks
    candidates = checkpointed(found.select(F.explode(F.expr(f"approx_top_k_estimate(s, {capacity})")).alias("c")).select(F.col("c.item").alias(key)))
    return df.join(F.broadcast(candidates), key).groupBy(key).agg(F.count("*").alias("counter"), *figures)


def _better(n_chars: str, doc_id: str) -> Column:
    """Larger is better: most code points, then the smallest doc_id (a null one last)."""
    return F.struct(F.col(n_chars), F.col(doc_id).isNotNull(), -F.col(doc_id))


def _digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("digest"), F.char_length(text).cast("long").alias("n_chars"))


def _winners(rows: DataFrame, capacity: int, best: Column) -> DataFrame:
    """Of each verified heavy digest: ``(digest, best, group_size)``; at most ``capacity`` rows."""
    exact = misra_gries(rows, "digest", capacity, F.max(best).alias("best"))
    return checkpointed(exact.where("counter > 1").select("digest", "best", F.col("counter").alias("group_size")))


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Groups of equal texts in ``docs(doc_id, text)``; other columns are not read.

    Texts are equal when identical without white space ``[\\x20\\x09-\\x0D]``; null counts
    as empty, so all empty texts are one group. Returns one row per row of ``docs``:
    doc_id, keep_id, group_size, kept, text_sha256. Of a group the row with the most code
    points in its original text stays, then that with the smallest doc_id, a null one
    last; of wholly equal rows exactly one. Texts of any length are digested whole. Empty table: no rows.
    """
    rows = checkpointed(_digests(docs).withColumn("row", F.monotonically_increasing_id()))
    best = F.struct("n_chars", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row"))
    heavy = _winners(rows, capacity, best)
    split = rows.join(F.broadcast(heavy), "digest", "left")
    settled = split.where("best IS NOT NULL")
    rest = split.where("best IS NULL").drop("best", "group_size")
    rest = rest.join(rest.groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("group_size")), "digest")
    both = settled.select("doc_id", "row", "digest", "best", "group_size").union(rest.select("doc_id", "row", "digest", "best", "group_size"))
    return both.select(
        "doc_id",
        (-F.col("best.minus_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.minus_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of each group of equal texts, whole, with exactly the columns of ``docs``.

    The same rule as :func:`exact_duplicates`. Rows of heavy digests other than the
    winner are removed where they are read; only the others are shuffled by digest.
    """
    known = _digests(docs)
    heavy = F.broadcast(_winners(checkpointed(known), capacity, _better("n_chars", "doc_id")).select("digest", F.col("best").alias("__best")))
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row.alias("__row"), F.sha2(normalised(F.col("text")), 256).alias("digest"), F.struct(F.char_length(text).cast("long"), F.col("doc_id").isNotNull(), -F.col("doc_id").cast("long")).alias("__own"))
    left = rows.join(heavy, "digest", "left").where(F.col("__best").isNull() | (F.col("__own") == F.col("__best").cast(rows.schema["__own"].dataType)))
    one = left.groupBy("digest").agg(F.max_by("__row", "__own").alias("__row"))
    return one.select(*(F.col(f"__row.c{k}").alias(c) for k, c in enumerate(names)))
