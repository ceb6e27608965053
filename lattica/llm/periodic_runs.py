"""Periodic runs of words: where a text says the same few words over and over.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) and at least
``max(min_length, min_exponent * q)`` words that no neighbouring word extends keeping the period.

Repeated k-grams mask the rest. In a run of ``L`` words and period ``q`` the stretch and its own shift by ``q`` share ``L - q`` words, so
every word lies in a k-gram that the text holds again, for any ``k`` up to the least such overlap (:func:`least_overlap`: 5 words at the
usual bounds). Words outside repeated k-grams join no run and break the text into segments; most texts have none left.

The segments that survive are halved as Main and Lorentz do: a run that crosses a middle ``m`` has a whole period on one side of it, so for
each period ``p`` the words that agree with those ``p`` further on, to the right and to the left of ``m``, give the
run, in ``n log n`` pairs of a middle and a period in all. The extensions come from equal ranks of blocks of 1, 2, 4, ... words. All
segments of a few megabytes of text are halved together, one level at a time, in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .cluster import packed, unpacked

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Bytes of text whose segments are worked on together; a longer text is taken alone.
CHUNK_BYTES = 4_000_000

_RUN = "struct<start:long,length:long,period:long>"


def least_overlap(min_length: int, min_exponent: int) -> int:
    """The fewest words that a run and its shift by one period share."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, -(-min_length // min_exponent) + 1))


class _Blocks:
    """Ranks of the blocks of 1, 2, 4, ... words that start at each word: equal ranks, equal blocks."""

    def __init__(self, words: np.ndarray, longest: int):
        self.ranks = [words]
        while 2 << (len(self.ranks) - 1) <= longest and int(self.ranks[-1].max()) + 1 < len(self.ranks[-1]):
            last, half = self.ranks[-1], 1 << (len(self.ranks) - 1)
            pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on, or with ``back`` those before; at most ``most``."""
        got = np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            step, ranks = 1 << level, self.ranks[level]
            fits = np.flatnonzero(got + step <= most)
            shift = -(got[fits] + step) if back else got[fits]
            same = ranks[a[fits] + shift] == ranks[b[fits] + shift]
            got[fits[same]] += step
        return got


def _runs_of_segments(words: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """``(start, end, period)`` of the runs in the segments ``bounds[i]:bounds[i + 1]`` of ``words``, numbers from 0 without gaps."""
    lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    left, right = lo, hi  # of the segment of each node
    blocks, found = _Blocks(words, int((hi - lo).max())), []
    while True:
        large = hi - lo >= min_length
        lo, hi, left, right = lo[large], hi[large], left[large], right[large]
        if not len(lo):
            break
        middle = (lo + hi) // 2
        periods = (hi - lo) // min_exponent
        node = np.repeat(np.arange(len(lo)), periods)
        p = np.arange(len(node)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        m, first, last = middle[node], left[node], right[node]
        for a in (m, m - p):  # a whole period to the right of the middle, or to the left
            b = a + p
            inside = np.flatnonzero((b <= hi[node]) & (a >= lo[node]))
            # b is m itself or beyond it; at a segment's end there is no word to compare
            ahead = np.zeros(len(inside), bool)
            has = b[inside] < last[inside]
            ahead[has] = words[a[inside[has]]] == words[b[inside[has]]]
            behind = np.zeros(len(inside), bool)
            has = a[inside] > first[inside]
            behind[has] = words[a[inside[has]] - 1] == words[b[inside[has]] - 1]
            own = inside[ahead | behind]
            forward = blocks.agree(a[own], b[own], last[own] - b[own])
            backward = blocks.agree(a[own], b[own], a[own] - first[own], back=True)
            long = backward + forward + p[own] >= np.maximum(min_length, min_exponent * p[own])
            own, forward, backward = own[long], forward[long], backward[long]
            found.append(np.stack([a[own] - backward, b[own] + forward, p[own]], 1))
        lo, hi, left, right = np.concatenate([lo, middle]), np.concatenate([middle, hi]), np.concatenate([left, left]), np.concatenate([right, right])
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a stretch that is found with a period and its multiples has the smallest
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def word_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each list of words, by start and period."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64)
    first = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    k = least_overlap(min_length, min_exponent)
    n = len(ids) - k + 1
    if n < 1:
        return out
    # equal grams of one text have equal keys; should others have them too, a segment is longer than it need be
    with np.errstate(over="ignore"):
        values, keys = T.mix(np.arange(1, len(known) + 1, dtype=np.uint64))[ids], T.mix(text[:n].astype(np.uint64) + np.uint64(1 << 40))
        for j in range(k):
            keys = keys + values[j : n + j] * np.uint64(2 * pow(3, 20 + j) + 1)
    whole = np.flatnonzero(text[:n] == text[k - 1 :])
    order = whole[np.argsort(keys[whole], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(ids) + 1, np.int64)
    repeated = np.union1d(order[1:][same], order[:-1][same])
    np.add.at(again, repeated, 1)
    np.add.at(again, repeated + k, -1)
    covered = np.cumsum(again[:-1]) > 0
    starts = np.flatnonzero(covered & ~(np.append(False, covered[:-1]) & (np.append(-1, text[:-1]) == text)))
    ends = np.flatnonzero(covered & ~(np.append(covered[1:], False) & (np.append(text[1:], -1) == text))) + 1
    long = ends - starts >= min_length
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return out
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)
    words = np.unique(ids[place], return_inverse=True)[1].astype(np.int64)
    for start, end, period in _runs_of_segments(words, bounds, min_length, min_exponent).tolist():
        own = int(text[place[start]])
        out[own].append((int(place[start] - first[own]), end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact ratio of length to period, then the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2] or run[1] * best[2] == best[1] * run[2] and (run[0], run[2]) < (best[0], best[2]):
            best = run
    return best


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def collapse_runs(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs(text)`` with the periodic runs of each whole text, one row per row.

    Added (columns of these names are replaced): n_words; runs, an array of ``(start, length, period)`` in words from 0, by start and period; strongest,
    the run of the greatest length / period (ties: smallest start, then period; null without runs); collapsed, the words left, joined by one space, when every
    run keeps its first period only. ``min_exponent`` is 2 at least.
    Null text counts as empty: no words, no runs, collapsed is empty. Repeated rows have equal results; null ids and any other columns pass through. A text of
    any length is taken whole, in one task, in ``n log n`` steps. Empty table: no rows.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run holds at least two periods and two words")
    added = ("n_words", "runs", "strongest", "collapsed")
    names = [c for c in docs.columns if c not in added]
    rows = packed(docs.withColumn("_whole", F.coalesce(F.col("text").cast("string"), F.lit(""))), "_whole", without=(*added, "_whole"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def as_struct(run):
        return None if run is None else dict(zip(("start", "length", "period"), run, strict=True))

    def collapse(batches):
        for batch in batches:
            data, offsets = T.utf8(batch.column("_whole"))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1)
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(at, end)]
                found = word_runs(texts, min_length, min_exponent)
                kept = [b" ".join(_collapsed(words, runs)).decode("utf-8", "replace") for words, runs in zip(texts, found, strict=True)]
                columns = [
                    batch.column("row").slice(at, end - at), pa.array([len(words) for words in texts], pa.int64()), pa.array([[as_struct(r) for r in runs] for runs in found], pa.list_(run_type)),
                    pa.array([as_struct(strongest(runs)) for runs in found], run_type), pa.array(kept, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", *added])
                at = end

    schema = rows.select("row").withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast(f"array<{_RUN}>"), "strongest": F.lit(None).cast(_RUN), "collapsed": F.lit("")}).schema
    return rows.mapInArrow(collapse, schema).select(*unpacked(names), *added)
