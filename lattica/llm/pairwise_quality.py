"""Quality scores by Bradley-Terry pairwise ranking.

The probability that text ``a`` is preferred to text ``b`` is ``sigmoid(s(a) - s(b))`` with a linear score
``s(x) = w . f(x)`` of text features. Preference pairs join texts of label 1 and label 0; the weights minimise
the logistic loss of the feature differences, with a ridge penalty. The scores' threshold is a
quantile: that share of scores lies below which the labels call low. A monotone map gives
scores from 0 to 1 and puts the threshold at ``CUT``.

Features are computed once for all texts, where they are read, and stored. All labelled rows are learned from: they are dealt into
buckets of bounded size, which hold the preference pairs, and each round of Newton's method adds up one gradient and one matrix over the buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .cluster import stored

#: Preference pairs for each labelled row; labelled rows of a bucket, about; and rows of either label that each bucket gets at least, about.
PAIRS_EACH, BUCKET, EACH_LABEL = 8, 2048, 64
#: Rank error of the sketch around the threshold's quantile.
ACCURACY = 10_000
#: Held to be of label 1 from this score on.
CUT = 0.3
RIDGE = 1e-3

FEATURES = [
    "log_words", "mean_word", "upper", "digit", "space", "beyond_ascii", "stop_mark", "comma", "symbol", "pipe", "exclamation", "other_mark",
    "distinct_words", "top_word", "repeated_pair", "repeated_run", "lines", "repeated_lines", "short_words", "long_words", "capital_words", "shouted_words", "symbol_words", "same_as_before",
]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_UPPER, _LOWER, _DIGIT, _SPACE = _table(T.UPPER), _table(T.LOWER), _table("0123456789"), _table(T.SPACES)
_SYMBOL = _table("#*$%&|<>@~^_=+\\{}[]")
_MARK = _table("\"'()-/:;?") | _table("`")


def _share_repeated(keys: np.ndarray) -> tuple[float, float, float]:
    """Distinct share, share of the most frequent key, and share of occurrences of repeated keys."""
    if not len(keys):
        return 0.0, 0.0, 0.0
    counts = np.unique(keys, return_counts=True)[1]
    return len(counts) / len(keys), counts.max() / len(keys), counts[counts > 1].sum() / len(keys)


def text_features(data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, lo: int, hi: int) -> list[float]:
    """The features of one text, from its bytes ``data[lo:hi]`` and its words."""
    part, n = data[lo:hi], len(hashes)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(part)
    counts = np.bincount(part, minlength=256)
    share = lambda table: counts[table].sum() / size
    lengths = end - start
    distinct, top, _ = _share_repeated(hashes)
    pairs = T.combine(hashes[:-1], hashes[1:]) if n > 1 else hashes[:0]
    runs = T.combine(*(hashes[k : n - 4 + k] for k in range(5))) if n >= 5 else hashes[:0]
    lines = part.tobytes().split(b"\n")
    filled = [x for x in lines if x.strip()]
    first, last = data[start], data[end - 1]
    shouted = _UPPER[first] & _UPPER[data[np.minimum(start + 1, end - 1)]] & (lengths > 1)
    return [
        np.log1p(n), lengths.mean(), share(_UPPER), share(_DIGIT), share(_SPACE), counts[128:].sum() / size, counts[ord(".")] / n, counts[ord(",")] / n,
        share(_SYMBOL), counts[ord("|")] / n, counts[ord("!")] / n, share(_MARK),
        distinct, top, _share_repeated(pairs)[2], _share_repeated(runs)[2], len(filled) / n, 1 - len(set(filled)) / max(1, len(filled)), (lengths <= 3).mean(), (lengths >= 12).mean(),
        (_UPPER[first] & ~shouted).mean(), shouted.mean(), (_SYMBOL[last] | _SYMBOL[first]).mean(), (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0.0,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """``(doc_id, features)`` of every row of ``docs(doc_id, text)``; nothing else is looked at."""

    def features(batches):
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            out, step = [], 1024
            for lo in range(0, len(offsets) - 1, step):
                own = offsets[lo : lo + step + 1]
                hashes, first, start, end = T.words(data, own, spans=True)
                for k in range(len(own) - 1):
                    part = slice(first[k], first[k + 1])
                    out.append(text_features(data, hashes[part], start[part], end[part], int(own[k]), int(own[k + 1])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(features, "doc_id long, features array<double>")


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        at_cut = np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip((self.raw(features) - self.threshold) * self.scale + at_cut, -500, 500)))


def _flat(width: int, any_bad: bool) -> Ranking:
    """All scores are equal: at label 0 if there is one, else at label 1."""
    return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 1.0 if any_bad else -1.0, 1.0)


def _pairs(labels: np.ndarray, own: np.ndarray, draw: np.random.Generator, pairs_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Which row of label 1 is preferred to which of label 0: ``pairs_each`` partners for each row that is ``own``."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    mine, others = np.flatnonzero((labels == 1) & own), np.flatnonzero((labels == 0) & own)
    a = np.concatenate([np.repeat(mine, pairs_each), draw.choice(good, len(others) * pairs_each)])
    b = np.concatenate([draw.choice(bad, len(mine) * pairs_each), np.repeat(others, pairs_each)])
    return a, b


def _loss_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of differences, and sums of the logistic loss's gradient and second derivatives, end to end."""
    p = 1 / (1 + np.exp(-np.clip(d @ w, -60, 60)))
    return np.concatenate([[len(d)], d.T @ (p - 1), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def _newton(sums, width: int, ridge: float, rounds: int) -> np.ndarray:
    w = np.zeros(width)
    for _ in range(rounds):
        total = sums(w)
        n, gradient, hessian = total[0], total[1 : width + 1], total[width + 1 :].reshape(width, width)
        step = np.linalg.solve(hessian / n + ridge * np.eye(width), gradient / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_ranking(features: np.ndarray, labels: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE, rounds: int = 50) -> Ranking:
    """Bradley-Terry weights by Newton's method on the pairs' logistic loss.

    Each labelled text is paired with ``pairs_each`` texts of the other label, chosen by a fixed
    sequence. With one label or none all scores are equal, at the label (1 if there is none).
    """
    width = features.shape[1] if features.ndim == 2 else len(FEATURES)
    n_bad = int((labels == 0).sum())
    if not n_bad or not (labels == 1).any():
        return _flat(width, n_bad > 0)
    mean, spread = features.mean(0), np.maximum(features.std(0), 1e-6)
    x = np.clip((features - mean) / spread, -8, 8)
    a, b = _pairs(labels, np.ones(len(labels), bool), np.random.default_rng(20240607), pairs_each)
    w = _newton(lambda w, d=x[a] - x[b]: _loss_sums(d, w), width, ridge, rounds)
    return Ranking(mean, spread, w, float(np.quantile(x @ w, n_bad / len(labels))), 1.0)


def _quantile(values: DataFrame, share: float, n: int) -> float:
    """The exact quantile of ``n`` values ``(raw)``, between its two neighbours in proportion: a sketch brackets it, and of what lies in the bracket only distinct values, about ``4 n / ACCURACY``, are looked at."""
    near = 2.0 / ACCURACY
    low, high = values.agg(F.percentile_approx("raw", [max(0.0, share - near), min(1.0, share + near)], ACCURACY)).first()[0]
    seen = int(values.where(F.col("raw") < low).count())
    inside = values.where(F.col("raw").between(low, high)).groupBy("raw").agg(F.count("*").alias("n")).orderBy("raw").collect()
    place = share * (n - 1)
    ends = np.cumsum([seen, *(r.n for r in inside)])
    at = [min(int(place), n - 1), min(int(place) + 1, n - 1)]
    if at[0] < seen or at[1] >= ends[-1]:
        if not (at[1] >= ends[-1] and at[0] < ends[-1] and place == at[0]):
            raise RuntimeError("the sketch's bracket misses the quantile")
        at[1] = at[0]
    a, b = (inside[int(np.searchsorted(ends, k, "right")) - 1].raw for k in at)
    return float(a + (b - a) * (place - int(place)))


def learn_ranking_of_all(learned: DataFrame, pairs_each: int = PAIRS_EACH, ridge: float = RIDGE, rounds: int = 50) -> Ranking:
    """:func:`learn_ranking` of all rows of a stored ``learned(doc_id, quality, features)``, of any number.

    Rows go by hash into buckets of about ``BUCKET``; each pairs its rows among themselves. Rows of a label that is too rare to be in every bucket
    also serve as partners in others, so that each has about ``EACH_LABEL`` of them, but are paired for themselves once. The driver gets sums only.
    """
    width = len(FEATURES)
    counts = {r.quality: r.n for r in learned.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    n = sum(counts.values())
    if len(counts) < 2:
        return _flat(width, 0 in counts)
    columns = [F.col("features")[i] for i in range(width)]
    moments = learned.agg(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    mean, spread = np.array(moments[:width]), np.maximum(np.array(moments[width:]), 1e-6)
    buckets = -(-n // BUCKET)
    copies = {label: min(buckets, -(-EACH_LABEL * buckets // own)) for label, own in counts.items()}
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == 1, copies[1] - 1).otherwise(copies[0] - 1))).alias("copy")
    dealt = learned.select("doc_id", "quality", "features", copy).withColumn("bucket", F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)) + F.col("copy"), F.lit(buckets)))
    held = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("doc_id", "quality", "copy", "features"))).alias("rows"))
    part = lambda name: F.transform("rows", lambda r: r[name]).alias(name)
    held = stored(held.select("bucket", part("quality"), part("copy"), F.flatten(F.transform("rows", lambda r: r["features"])).alias("features")))

    def sums(w: np.ndarray) -> np.ndarray:
        def add(batches):
            total = np.zeros(1 + width + width * width)
            for batch in batches:
                for bucket, labels, copy, x in zip(*(batch.column(c) for c in ("bucket", "quality", "copy", "features")), strict=True):
                    x = np.clip((np.asarray(x.values, float).reshape(-1, width) - mean) / spread, -8, 8)
                    a, b = _pairs(np.asarray(labels.values), np.asarray(copy.values) == 0, np.random.default_rng([20240607, bucket.as_py()]), pairs_each)
                    total += _loss_sums(x[a] - x[b], w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        cells = held.mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # one matrix
        return np.array([r.v for r in cells])

    found = Ranking(mean, spread, _newton(sums, width, ridge, rounds), 0.0, 1.0)

    def raws(batches):
        for batch in batches:
            x = np.asarray(batch.column("features").flatten(), float).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(found.raw(x), pa.float64())], ["raw"])

    threshold = _quantile(stored(learned.select("features").mapInArrow(raws, "raw double")), counts[0] / n, n)
    return Ranking(mean, spread, found.weights, threshold, 1.0)


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs(doc_id, text)``; other columns are not read.

    ``labels(doc_id, quality)`` are learned from where ``learn_from`` (of doc_id) holds; null or other labels
    are left out. Repeated rows of one doc_id and label count once, and one with both labels once for each; of several texts
    with one doc_id the one with the least features is learned from. Scores go from 0 to 1, higher where label 1 is
    likelier; predicted is 1 from ``CUT`` on. Null and empty texts have all features 0 and a score like
    any other. Repeated rows have equal scores. No labels: all scores are equal. Empty table: no rows.
    """
    known = labels.where(learn_from & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    rows = stored(with_features(docs))
    ranking = learn_ranking_of_all(stored(rows.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("features").alias("features"))))

    def score(batches):
        for batch in batches:
            own = batch.column("features").values if isinstance(batch.column("features"), pa.ListArray) else None
            x = np.array(batch.column("features").to_pylist(), float).reshape(-1, len(FEATURES)) if own is None else np.array(batch.column("features").flatten()).reshape(-1, len(FEATURES))
            scores = ranking.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= CUT).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, score double, predicted int")
