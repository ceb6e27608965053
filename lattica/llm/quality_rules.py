"""Quality rules: length and repetition, then divergence from language references.

In DataFrame operations only. Each text gets two histograms, of character classes
and of common words. The references are the pooled histograms of the sufficiently
long texts of each language that pass the base rules, so that what these reject doesn't move the yardstick. A text's distance from
a reference is the mean of the two
Jensen-Shannon distances (base 2, so from 0 to 1); it is held against the reference
of its own language, or, where that is unknown, against the nearest. Texts below a
minimum length have histograms too coarse to judge and are not rejected by distance.

Texts are scanned once: the figures and histograms of each are stored in a table, from which both
the references and the verdicts are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import packed, stored, unpacked
from .text import SPACE
from .url_filter import fold

#: Frequent function words of each language; together they are the word histogram's bins.
COMMON_WORDS = {
    "en": "the of and to in that is for it on was be with as this by are at an from".split(),
    "fr": "le la les de des du un une et en que qui est dans pour par sur au".split(),
    "de": "der die das und in den von zu mit sich des auf ist im ein eine nicht auch".split(),
    "es": "el la los las de y que en un una por con no se del para es al".split(),
}
BINS = sorted({w for words in COMMON_WORDS.values() for w in words})

#: Character classes in the order in which they are counted; the last is all else.
CLASSES = [("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("space", SPACE), ("beyond_ascii", "[^\\x00-\\x7F]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("punctuation", "[.,;:!?'\"()/-]+")]

MIN_WORDS = 50
MAX_DISTANCE = 0.26
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of ``window`` words found twice or more; each word counts once.

    Runs are told apart by 64-bit hashes. Sorting finds the repeated ones, so that long
    texts cost n log n; texts without a repeat, most by far, are not sorted.
    """
    runs = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(w[i + k] for k in range(window)))))

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            def beside(x: Column, j: Column) -> Column:
                return x["k"].eqNullSafe(F.get(p, j - 1)["k"]) | x["k"].eqNullSafe(F.get(p, j + 1)["k"])

            return F.sort_array(F.transform(F.filter(p, beside), lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(let(placed, repeated), start, lambda s, at: F.struct((s["n"] + F.least(F.lit(window), at - s["last"])).alias("n"), at.alias("last")), lambda s: s["n"])

    zero = F.lit(0).cast("long")
    found = let(runs, lambda keys: F.when(F.size(keys) == F.size(F.array_distinct(keys)), zero).otherwise(covered(keys)))
    return F.when(F.size(words) <= window, zero).otherwise(found)


def _with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with its text as ``_text``, its words, and both histograms ``_classes`` and ``_common``."""
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("_words", words_of(F.col("_text")))
    left = "_text"
    sizes = [F.char_length("_text").cast("long")]
    for k, (_, pattern) in enumerate(CLASSES):  # each class is counted in what the ones before it left
        out = out.withColumn(f"_left{k}", F.regexp_replace(left, pattern, ""))
        left = f"_left{k}"
        sizes.append(F.char_length(left).cast("long"))
    counts = [a - b for a, b in zip(sizes, sizes[1:], strict=False)] + [sizes[-1]]
    out = out.withColumn("_classes", F.array(*counts)).drop(*(f"_left{k}" for k in range(len(CLASSES))))
    common = F.filter(F.transform("_words", fold), lambda w: w.isin(*BINS))

    def histogram(found: Column) -> Column:
        own = [(F.size(found) - F.size(F.array_remove(found, w))).cast("long") for w in BINS]
        return F.array(*own, (F.size("_words") - F.size(found)).cast("long"))

    return out.withColumn("_common", let(common, histogram))


def _measured(docs: DataFrame, *kept: str) -> DataFrame:
    """What the rules need of each text, and the columns ``kept``, as a stored table."""
    n_words = F.size("_words")
    out = _with_counts(docs)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    out = out.withColumn("_repeats", repeated_words(F.col("_words")))
    out = out.withColumn("_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    at = {name: k for k, (name, _) in enumerate(CLASSES)}
    return stored(out.select(
        *kept, F.col("lang").cast("string").alias("_lang"), n_words.cast("long").alias("_n_words"), (F.char_length("_text") - F.col("_classes")[at["space"]]).cast("long").alias("_word_chars"),
        F.col("_classes")[at["symbol"]].alias("_n_symbols"), "_dup_lines", "_repeats", ((n_words < 10) | (100 * F.col("_repeats") > 20 * n_words)).alias("_failed"), "_classes", "_common",
    ))


def _references(measured: DataFrame, min_words: int) -> list[dict]:
    rows = measured.where(F.col("_lang").isin(*COMMON_WORDS) & (F.col("_n_words") >= min_words) & ~F.col("_failed"))
    pooled = rows.groupBy("_lang").agg(
        *(F.sum(F.col("_classes")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)),
        *(F.sum(F.col("_common")[k]).alias(f"w{k}") for k in range(len(BINS) + 1)),
    )
    found = []
    for row in pooled.collect():  # as many rows as COMMON_WORDS has languages at most
        classes, common = [row[f"c{k}"] for k in range(len(CLASSES) + 1)], [row[f"w{k}"] for k in range(len(BINS) + 1)]
        found.append({"lang": row["_lang"], "classes": [x / sum(classes) for x in classes], "common": [x / sum(common) for x in common]})
    return sorted(found, key=lambda r: r["lang"])


def language_references(docs: DataFrame, min_words: int = MIN_WORDS) -> list[dict]:
    """Pooled histograms of the long enough texts of each known language that pass the base rules: at most one row each."""
    return _references(_measured(docs.select("lang", "text")), min_words)


def js_distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram from a distribution; an empty one has distance 1."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def distance(n: Column) -> Column:
        parts = F.zip_with(counts, F.array(*map(F.lit, reference)), lambda x, q: let(F.struct((x / n).alias("p"), q.alias("q"), ((x / n + q) / 2).alias("m")), lambda s: term(s["p"], s["m"]) + term(s["q"], s["m"])))
        sum_ = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
        return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum_ / 2)))

    return F.when(total > 0, let(total, distance)).otherwise(1.0)


def _judged(measured: DataFrame, references: list[dict] | None, min_words: int, max_distance: float) -> DataFrame:
    references = _references(measured, min_words) if references is None else references
    if references:
        each = {r["lang"]: (js_distance(F.col("_classes"), r["classes"]) + js_distance(F.col("_common"), r["common"])) / 2 for r in references}
        distance = F.array_min(F.array(*each.values()))
        for name, own in each.items():
            distance = F.when(F.col("_lang") == name, own).otherwise(distance)
        distance = F.when(F.col("_n_words") >= min_words, F.round(distance, 9))
    else:
        distance = F.lit(None).cast("double")
    out = measured.withColumn("_distance", distance)
    return out.withColumn("_kept", ~F.col("_failed") & F.coalesce(F.col("_distance") <= max_distance, F.lit(True)))


def quality_verdicts(docs: DataFrame, *, references: list[dict] | None = None, min_words: int = MIN_WORDS, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Figures and verdict for each row of ``docs(doc_id, text, lang)``; other columns are not read.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance (null where too short to judge) and kept. A null or empty text has
    no words and fails the base. A null or unknown lang is held against the nearest reference; if
    no text is long enough for a reference, there is no distance and the base decides.
    Repeated rows have equal verdicts. Empty table: no rows. Texts are scanned once and not shuffled.
    """
    out = _judged(_measured(docs.select("doc_id", "text", "lang"), "doc_id"), references, min_words, max_distance)
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_n_symbols").alias("n_symbols"), F.col("_dup_lines").alias("n_dup_lines"),
        F.col("_repeats").alias("n_repeat_words"), F.col("_failed").alias("base_failed"), F.col("_distance").alias("distance"), F.col("_kept").alias("kept"),
    )


def keep_by_rules(docs: DataFrame, *, references: list[dict] | None = None, min_words: int = MIN_WORDS, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with exactly its columns; whole rows go through the stored table."""
    rows = packed(docs, "text", "lang")
    judged = _judged(_measured(rows, "row"), references, min_words, max_distance)
    return judged.where("_kept").select(*unpacked(docs.columns))
