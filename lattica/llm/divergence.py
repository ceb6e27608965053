"""Where sources differ from their language, and from each other, in the terms they use.

A term is a run of letters (ASCII letters and everything beyond ASCII), with A-Z lower-cased. Each language keeps the ``V`` terms that at least
``min_docs`` of its documents hold. A group (a source in a language) or a whole language gives a kept term, counted ``c`` times of its
``N``, the smoothed share ``p = 1 + floor(10**9 * (c + 2) / (N + 2 * V))``, and two shares ``p`` and ``q`` differ by
``f = floor((p - q)**2 / (p + q))``. All of it is exact in whole numbers.

*Terms* (:func:`top_terms`): upper-bound search. A group's terms fall into buckets by their count (eight to each power of two). As ``f`` grows with ``p`` and, below ``p``, falls
with ``q``, the largest ``p`` and the least ``q`` of the language in a bucket bound every ``f`` in it. Buckets are evaluated best bound first, in turns of
1, 2, 4, ... for each group, until every bound left lies strictly below the group's kth value. Only opened buckets' terms are ranked.

*Pairs* (:func:`source_pairs`): the terms that two sources both hold come from the term's posting list; the sums of those that one or neither holds follow
from how many terms each source has of each count, so no term is visited for a source that lacks it:

    sum f = V * f(za, zb) + sum over a's terms of (f(pa, zb) - f(za, zb)) + the same for b's
            + sum over common terms of (f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb)),   z: the share of a count of zero

Terms are counted in each task before they are shuffled by term, so neither a hot source nor a common word meets in one task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import Scratch
from . import text as T

MIN_DOCS, TOP = 10, 10
#: Entries of a task's table of counts before it is sent on.
MOST_COUNTED = 400_000
#: Buckets to each power of two of a count.
BUCKETS_PER_DOUBLING = 8
#: Pairs of postings worked on at once.
PAIRS_AT_ONCE = 1 << 20
#: A table up to so many rows and bytes may be broadcast.
SMALL_ROWS, SMALL_BYTES = 20_000, 4_000_000

#: Of each byte the byte that counts: a letter in lower case, or white space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: A count of occurrences and, above it, one of documents.
_ONE_DOC = 1 << 44
SCALE = 1_000_000_000


def share(count: Column, total: Column, v: Column) -> Column:
    """``1 + floor(10**9 * (count + 2) / (total + 2 * v))``, in three steps of a thousand so that no product passes 64 bits (totals to 9e15)."""
    below, rest, out = total + 2 * v, count + 2, F.lit(1).cast("long")
    out, rest = out + _div(rest, below) * SCALE, rest % below
    for scale in (1_000_000, 1000, 1):
        out, rest = out + _div(rest * 1000, below) * scale, rest * 1000 % below
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _small(df: DataFrame, *names: str) -> DataFrame:
    """``df``, marked for broadcast only if it has few rows and little text in ``names`` (one count); else the join is shuffled."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.octet_length(c) for c in names), F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL_ROWS and size <= SMALL_BYTES else df


def group_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term in each group, over whole texts; null text, lang and source are ''."""

    def count(batches):
        seen: dict[tuple, dict[bytes, int]] = {}
        size = 0

        def flush():
            for (lang, source), held in seen.items():
                both = np.fromiter(held.values(), np.int64, len(held))
                columns = [pa.array([lang] * len(held), pa.string()), pa.array([source] * len(held), pa.string()), pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(both % _ONE_DOC), pa.array(both // _ONE_DOC)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                own = Counter(data[offsets[k] : offsets[k + 1]].tobytes().translate(_LETTERS).split())
                held = seen.setdefault(group, {})
                before, known = len(held), held.get
                for term, n in own.items():
                    held[term] = known(term, 0) + n + _ONE_DOC
                size += len(held) - before
                if size > MOST_COUNTED:
                    yield from flush()
                    seen, size = {}, 0
        yield from flush()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Shares:
    """The tables of shares of one corpus, in the shared folder.

    ``groups(lang, source, v, total, zero)`` has every group that occurs, also those without kept terms, with ``zero`` the share of a count of 0 (null where ``v`` is 0);
    ``rated(lang, source, term, bucket, p, q, zero)`` has the kept terms that each group holds, with its share and the language's.
    """

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS):
        self.scratch, keys = Scratch(docs.sparkSession), ["lang", "source"]
        by_term = group_terms(docs).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
        postings = self.scratch.keep(by_term.where(F.col("docs") >= min_docs).drop("docs"))
        langs = self.scratch.keep(postings.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all")))
        entries = postings.select("lang", "term", "n", F.explode("held").alias("h")).select("lang", "term", "n", F.col("h.source").alias("source"), F.col("h.n").alias("c"))
        occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in keys)).distinct()
        groups = occurring.join(entries.groupBy(*keys).agg(F.sum("c").alias("total")), keys, "left").join(_small(langs, "lang"), "lang", "left")
        groups = groups.select(*keys, F.coalesce("v", F.lit(0)).cast("long").alias("v"), "all", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
        self.groups = self.scratch.keep(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v")))))
        rated = entries.join(_small(self.groups, *keys), keys)
        self.rated = self.scratch.keep(rated.select(*keys, "term", _bucket().alias("bucket"), share(F.col("c"), F.col("total"), F.col("v")).alias("p"), share(F.col("n"), F.col("all"), F.col("v")).alias("q"), "zero"))
        self.scratch.drop(postings, langs)


def _bucket() -> Column:
    """Of a count ``c`` from 1: the power of two below it, and which eighth of the way to the next."""
    power = "(length(bin(c)) - 1)"
    return F.expr(f"CAST({power} * {BUCKETS_PER_DOUBLING} + shiftright((c - shiftleft(1L, {power})) * {BUCKETS_PER_DOUBLING}, {power}) AS INT)")


def top_terms(shares: Shares, k: int = TOP) -> DataFrame:
    """``(lang, source, item, value, rank)``: of each group the ``k`` terms it holds with the largest ``f`` among those with ``p`` above the language's ``q``; ties by term."""
    keys = ["lang", "source"]
    rated = shares.rated
    bounds = rated.groupBy(*keys, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).where("p > q")
    order = Window.partitionBy(*keys).orderBy(F.desc("bound"), "bucket")  # a group has no more buckets than 8 for each bit of a count
    bounds = shares.scratch.keep(bounds.select(*keys, "bucket", divergence(F.col("p"), F.col("q")).alias("bound")).withColumn("turn", F.floor(F.log2(F.row_number().over(order))).cast("int")))
    best, turn = None, 0
    while True:
        wanted = bounds.where(F.col("turn") == turn)
        if best is not None:
            kth = best.where(F.col("rank") == k).select(*keys, F.col("value").alias("kth"))
            wanted = wanted.join(_small(kth, *keys), keys, "left").where("kth IS NULL OR bound >= kth").drop("kth")
        n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source")), F.lit(0))).first()
        if not n:
            break  # the bounds of later turns are no larger
        opened = wanted.select(*keys, "bucket")
        seen = rated.join(F.broadcast(opened) if n <= SMALL_ROWS and size <= SMALL_BYTES else opened, [*keys, "bucket"]).where("p > q").select(*keys, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        if best is not None:
            seen = seen.unionByName(best.drop("rank"))
        ranked = shares.scratch.keep(seen.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= k))
        shares.scratch.drop(best)
        best, turn = ranked, turn + 1
    shares.scratch.drop(bounds)
    return best if best is not None else bounds.sparkSession.createDataFrame([], "lang string, source string, item string, value long, rank int")


_CORRECTION = "lang string, a string, b string, part long"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _common_terms(postings: DataFrame) -> DataFrame:
    """``(lang, a, b, part)`` with ``a < b``, summed: what the terms that both hold add to the sums of those that one or neither holds."""

    def add(batches):
        sums: dict[tuple, int] = {}
        for batch in batches:
            lists, langs = batch.column("held"), batch.column("lang").to_pylist()
            offsets = np.asarray(lists.offsets)
            values = lists.values
            names = values.field("source").dictionary_encode()
            code, p, z = np.asarray(names.indices), np.asarray(values.field("p")), np.asarray(values.field("zero"))
            names = names.dictionary.to_pylist()
            for i, lang in enumerate(langs):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                step = max(1, PAIRS_AT_ONCE // max(1, hi - lo))
                for at in range(lo, hi, step):
                    a, b = np.meshgrid(np.arange(at, min(hi, at + step)), np.arange(at + 1, hi), indexing="ij")
                    a, b = a[a < b], b[a < b]
                    part = _f(p[a], p[b]) - _f(p[a], z[b]) - _f(z[a], p[b]) + _f(z[a], z[b])
                    yield from _into(sums, lang, code[a], code[b], part, names)
        if sums:
            yield _pair_batch(sums)

    return postings.mapInArrow(add, _CORRECTION).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))


def _into(sums, lang, a, b, part, names):
    """Adds to the sums of a task; yields them when there are many."""
    for x, y, value in zip(a.tolist(), b.tolist(), part.tolist(), strict=True):
        key = (lang, names[x], names[y])
        sums[key] = sums.get(key, 0) + value
    if len(sums) > MOST_COUNTED:
        yield _pair_batch(sums)
        sums.clear()


def _pair_batch(sums) -> pa.RecordBatch:
    lang, a, b = zip(*sums, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "a", "b", "part"])


def source_pairs(shares: Shares) -> DataFrame:
    """``(lang, source, item, value, rank)``: ``f`` summed over all kept terms for each ordered pair of sources of a language, ranked for each source."""
    groups = shares.groups
    own, rated = groups.select("lang", "source", "zero", "v"), shares.rated
    # b stands after a in order, so that each pair is summed once
    postings = rated.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "zero"))).alias("held")).where(F.size("held") > 1)
    common = _common_terms(postings.select("lang", "held"))
    levels = rated.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
    other = _small(groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("z")), "lang", "item")
    alone = levels.join(other, "lang").where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (divergence(F.col("p"), F.col("z")) - divergence(F.col("zero"), F.col("z")))).alias("part"))
    pairs = own.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * divergence(F.col("zero"), F.col("z")), F.lit(0)).alias("part"))
    swapped = ["lang", F.col("item").alias("source"), F.col("source").alias("item"), "part"]
    both = common.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "part")
    summed = pairs.unionByName(alone).unionByName(alone.select(*swapped)).unionByName(both).unionByName(both.select(*swapped)).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """Both parts for ``docs(text, lang, source)``: ``(lang, source, part, item, value, rank)`` with part ``pair`` (every other source of the language) or ``term`` (to rank ``k``).

    Null text, lang and source are ''. A group without kept terms has its pairs, by shares of zero counts, and no terms; a language without kept terms has pairs of value 0.
    Repeated rows count as often as they come; other columns are ignored; ties go by item, bytes ascending. A text of any length is counted whole, in one task.
    The pairs' rows grow with the square of the sources of a language, as that is the result. Empty table: no rows. Intermediate tables stay in the shared folder until the result is read.
    """
    shares = Shares(docs, min_docs)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    terms, pairs = top_terms(shares, k).withColumn("part", F.lit("term")), source_pairs(shares).withColumn("part", F.lit("pair"))
    return pairs.select(columns).unionByName(terms.select(columns))
