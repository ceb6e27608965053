"""Mixing sources to target weights by Poisson replication.

A source with target weight ``w`` (normalised over the sources present) is to give ``w`` of the
output's characters. Its repetition rate is ``w * total / own``; each document is repeated as often as a
Poisson variable of that mean, drawn by inverting its distribution at a number
between 0 and 1 that a seed and the doc_id fix; a large rate is the sum of independent draws of bounded rates. The copies are dealt out by hash and sorted
by it, which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .cluster import packed, small_or_plain, unpacked

SEED = 20240607
#: Up to so many sources, their table (of rates alone) is broadcast; beyond, the join is shuffled.
MAX_BROADCAST_SOURCES = 10_000
#: A larger rate is drawn as one Poisson variable of this rate for each whole multiple, and one of the rest.
MAX_DRAWN_RATE = 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts' text, of 48 bits."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def poisson_steps(rate: Column, terms: int = 160) -> Column:
    """P(X <= k) of a Poisson variable for k = 0, 1, ...; the draw is how many of them are at most u."""
    # p(k) = p(k - 1) * rate / k, summed up; at a rate of 32, 160 terms leave less than 1e-40
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    ks = F.sequence(F.lit(1), F.lit(terms - 1))
    last = F.aggregate(
        ks, start,
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["p"] * rate / k)).alias("sums")),
    )
    return last["sums"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: float = 1.0) -> DataFrame:
    """``(source, documents, chars, rate)`` of each source; a null source counts as one named ''.

    ``weights`` names target weights; other sources get ``default_weight``. ``size`` is the output's expected
    share of the input. Sources without characters are never repeated more often than once.
    """
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    chars = F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    per = docs.groupBy(name.alias("source")).agg(F.count("*").alias("documents"), F.sum(chars).alias("chars"))
    weight = F.lit(float(default_weight))
    for source, own in (weights or {}).items():
        weight = F.when(F.col("source") == source, float(own)).otherwise(weight)
    per = checkpointed(per.withColumn("weight", weight))
    total, all_weights = per.agg(F.sum("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight")))).first()
    if not total or not all_weights:
        return per.select("source", "documents", "chars", F.lit(float(size)).alias("rate"))
    rate = F.when(F.col("chars") > 0, F.col("weight") / all_weights * total * size / F.col("chars")).otherwise(F.least(F.lit(1.0), F.lit(float(size))))
    return per.select("source", "documents", "chars", rate.alias("rate"))


def mix_sources(docs: DataFrame, *, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text, source)`` repeated to the target weights and shuffled globally.

    All columns of ``docs`` are kept; added are copy (0, 1, ...), copies (of this document), rate (of its
    source) and shuffle_key. By default all sources weigh the same and the output is expected to be as large
    as the input. A null source is a source; null text counts as empty. Repeated rows with one doc_id
    are drawn alike. Empty table: no rows. Columns of the same names are replaced.
    """
    rates = source_rates(docs, weights, default_weight, size)
    drawn = F.col("_rate") - F.col("_whole") * MAX_DRAWN_RATE
    rates = rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate")).withColumn("_whole", F.floor(F.col("_rate") / MAX_DRAWN_RATE).cast("int"))
    rates = small_or_plain(checkpointed(rates.withColumn("_steps", poisson_steps(drawn)).withColumn("_more", F.when(F.col("_whole") > 0, poisson_steps(F.lit(float(MAX_DRAWN_RATE)))))), MAX_BROADCAST_SOURCES)
    added = ("copy", "copies", "rate", "shuffle_key")
    rows = packed(docs, "doc_id", "source", without=added).withColumn("u", uniform(F.lit(seed), F.col("doc_id")))
    rows = rows.join(rates, F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("_source"))
    us = F.transform(F.sequence(F.lit(1), F.col("_whole")), lambda k: uniform(F.lit(seed), F.col("doc_id"), F.lit("draw"), k))
    more = F.aggregate(us, F.lit(0), lambda n, u: n + F.size(F.filter("_more", lambda c: c <= u)))
    copies = F.when(F.col("_whole") > 0, more).otherwise(0) + F.size(F.filter("_steps", lambda c: c <= F.col("u")))
    rows = rows.select("row", "doc_id", "_rate", copies.alias("copies")).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy"))
    rows = rows.withColumn("shuffle_key", F.md5(key.cast("binary")))
    mixed = rows.select(*unpacked([c for c in docs.columns if c not in added]), "copy", "copies", F.col("_rate").alias("rate"), "shuffle_key")
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
