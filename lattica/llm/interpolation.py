"""Deleted interpolation: a bigram language model over a corpus of any size.

A token's probability mixes three estimates by the training count ``c(v)`` of its context ``v``:

    p(w | v) = l2[b] * c(v, w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1),   b = bucket of c(v)

Counts are maximum-likelihood counts. The weights of each bucket of context frequency are learned by
expectation-maximisation on held-out counts: a tenth of the training texts is deleted, and their
tokens are scored by the counts of the others. The final estimates use all training texts.

How counts move. Texts are scanned in blocks of bounded bytes. A block sends each of its distinct
n-grams once, as packed 64-bit hashes dealt out by hash, with its own counts; the reducers of each hash
range add up all blocks' counts and send back the totals. Neither the vocabulary nor any
n-gram table is ever held whole anywhere, and a frequent n-gram is one entry per block. Sorted hashes move as differences, so
an entry takes about 6 bytes, and numbers take as many bytes as the largest of them needs, up to 64 bits; a block sends a row to a range only if it has an entry there, so what is sent is never more than
a row for each entry, and grows with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from ..session import checkpointed

#: Bytes of text of a scan partition that make a block; a longer text is a block of its own.
BLOCK_BYTES = 16_000_000
#: Bytes of text for each range of hashes.
RANGE_BYTES = 12_000_000
#: Buckets of context frequency: 0, 1, 2-3, 4-7, ... the last is open.
BUCKETS = 24
#: Probabilities on held-out tokens are gathered in steps of 1/4 of a power of two, down to 2**-40; index 0 is for zero.
#: So the weights are learned from probabilities that are off by at most a factor of 2**(1/8), 9 %; scores use exact ones.
STEPS, LOWEST = 4, 40
GRID = STEPS * LOWEST + 2
#: Shorter packed values aren't compressed.
_PLAIN = 256

_END = np.uint64(0xE4D0F7E475E4D0F7)
_START = np.uint64(0x57A8757A8757A875)
UNIGRAM, BIGRAM = 0, 1

TRAIN, DELETED, UNSEEN = 0, 1, 2


def checksum(doc_id: Column) -> Column:
    """crc32 of doc_id as text; a null doc_id counts as an empty text, so 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text modulo ``of``."""
    return checksum(doc_id) % of


def bigram_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return T.mix(left * np.uint64(0x9E3779B97F4A7C15) + T.mix(right))


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (words and one end per text), the hash before each, and at which token each text starts."""
    hashes, first = T.words(data, offsets)
    n = len(first) - 1
    begin = first + np.arange(n + 1)
    tokens = np.empty(len(hashes) + n, np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[begin[1:] - 1] = True
    tokens[is_end], tokens[~is_end] = _END, hashes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begin[:-1]] = _START
    return tokens, before, begin


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = T.utf8(texts)
    tokens, before, begin = _tokens(data, offsets)
    return tokens, bigram_hash(before, tokens), begin


def _pack(values: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on, up to the last that one of them needs; many are compressed, too."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :width].T).tobytes()
    return bytes([2 * width]) + raw if len(raw) < _PLAIN else bytes([2 * width + 1]) + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(packed: bytes) -> np.ndarray:
    width, raw = packed[0] // 2, zstandard.ZstdDecompressor().decompress(packed[1:]) if packed[0] % 2 else packed[1:]
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    out = np.zeros((len(planes), 8), np.uint8)
    out[:, :width] = planes
    return out.view("<u8").ravel()


def _pack_keys(sorted_hashes: np.ndarray) -> bytes:
    return _pack(np.diff(sorted_hashes, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


@lru_cache(maxsize=2)
def _edges(ranges: int) -> np.ndarray:
    return np.array([k * (1 << 64) // ranges for k in range(1, ranges)], np.uint64)


def _ranges_of(sorted_hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges, of ``ranges`` equal ones of 64-bit hashes, that have an entry, and where each begins; the last entry is the end."""
    place = np.searchsorted(_edges(ranges), sorted_hashes, "right")
    own, at = np.unique(place, return_index=True)
    return own, np.append(at, len(place))


def _block_rows(block: int, group: int, texts: pa.Array, ranges: int) -> Iterator[tuple]:
    tokens, bigrams, begin = _grams(texts)
    # the start of each text is a context, so it is counted like one
    starts = np.full(len(begin) - 1, _START, np.uint64)
    for kind, grams in ((UNIGRAM, np.concatenate([tokens, starts])), (BIGRAM, bigrams)):
        keys, counts = np.unique(grams, return_counts=True)
        own, at = _ranges_of(keys, ranges)
        for k, start, end in zip(own.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield (k, kind, block, group, _pack_keys(keys[start:end]), _pack(counts[start:end]))


_SENT = "range int, kind int, block long, grp int, keys binary, counts binary"


class _Blocks:
    """Numbers of the blocks of one scan partition, batch by batch: a new one when the texts of the last have ``block_bytes``."""

    def __init__(self, block_bytes: int):
        self.first, self.total, self.block_bytes = TaskContext.get().partitionId() << 33, 0, block_bytes

    def of(self, texts: pa.Array) -> np.ndarray:
        sizes = np.diff(T.utf8(texts)[1])
        before = self.total + np.cumsum(sizes) - sizes
        self.total += int(sizes.sum())
        return self.first + before // self.block_bytes


def _sent(base: DataFrame, ranges: int, block_bytes: int) -> DataFrame:
    schema = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("grp", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def send(batches):
        waiting: dict[int, list] = {}
        numbers = _Blocks(block_bytes)

        def flush(group):
            block, texts = waiting.pop(group)
            rows = list(_block_rows(block, group, pa.concat_arrays(texts), ranges))
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            blocks, groups = numbers.of(batch.column("text")), batch.column("grp").to_numpy()
            texts = batch.column("text").cast(pa.large_string())
            for group in (TRAIN, DELETED, UNSEEN):
                rows = np.flatnonzero(groups == group)
                cuts = np.flatnonzero(np.diff(blocks[rows])) + 1
                for own in np.split(rows, cuts) if len(rows) else []:
                    block = int(blocks[own[0]])
                    if group in waiting and waiting[group][0] != block:
                        yield flush(group)
                    waiting.setdefault(group, (block, []))[1].append(texts.take(pa.array(own)))
        for group in list(waiting):
            yield flush(group)

    return base.select("grp", "text").mapInArrow(send, _SENT)


_TOTALS = "block long, grp int, kind int, range int, kept binary, deleted binary, n_kept long, n_deleted long, v long"


def _totals(sent: DataFrame) -> DataFrame:
    """For each packed row its keys' total counts, in order; and one row with block null of each range's sums.

    ``kept`` counts the training texts that aren't deleted, ``deleted`` the others.
    """

    def add_up(key, frame: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpack_keys(x) for x in frame["keys"]]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(x) for x in keys])
        sums = np.zeros((2, len(distinct)), np.int64)
        for end, own, group, packed in zip(ends, keys, frame["grp"], frame["counts"], strict=True):
            if group != UNSEEN:
                sums[group][place[end - len(own) : end]] += _unpack(packed).astype(np.int64)  # a block has each key once
        out = []
        for end, own, block, group in zip(ends, keys, frame["block"], frame["grp"], strict=True):
            at = place[end - len(own) : end]
            out.append((block, group, key[1], key[0], _pack(sums[0][at]), _pack(sums[1][at]), None, None, None))
        tokens = distinct != _START
        seen = (sums.sum(0) > 0) & tokens
        out.append((None, None, key[1], key[0], None, None, int(sums[0][tokens].sum()), int(sums[1][tokens].sum()), int(seen.sum())))
        return pd.DataFrame(out, columns=["block", "grp", "kind", "range", "kept", "deleted", "n_kept", "n_deleted", "v"], dtype=object)

    return sent.groupBy("range", "kind").applyInPandas(add_up, _TOTALS)


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2-3, 4-7, ... as 0, 1, 2, 3, ..."""
    return np.minimum(np.frexp(counts.astype(float))[1], BUCKETS - 1)


def _step(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log2(p) * STEPS), 0, GRID - 2) + 1, 0).astype(np.int64)


def _looked_up(texts: pa.Array, totals: pd.DataFrame, with_deleted: bool):
    """c(w), c(v), c(v, w) of each token, as totals have them, and where each text starts."""
    tokens, bigrams, begin = _grams(texts)
    starts = np.full(len(begin) - 1, _START, np.uint64)
    found = {}
    for kind, grams in ((UNIGRAM, np.concatenate([tokens, starts])), (BIGRAM, bigrams)):
        keys, place = np.unique(grams, return_inverse=True)
        rows = totals[totals["kind"] == kind].sort_values("range")
        counts = np.concatenate([_unpack(x) for x in rows["kept"]]).astype(np.int64)
        if with_deleted:
            counts = counts + np.concatenate([_unpack(x) for x in rows["deleted"]]).astype(np.int64)
        if len(counts) != len(keys):
            raise ValueError("a block's rows changed between two scans; store the table first")
        found[kind] = counts[place]
    single = found[UNIGRAM][: len(tokens)]
    context = np.empty_like(single)
    context[1:] = single[:-1]
    context[begin[:-1]] = found[UNIGRAM][len(tokens) :]
    return single, context, found[BIGRAM], begin


def learn_weights(cells: np.ndarray, counts: np.ndarray, v: int, rounds: int = 200, prior: float = 1.0) -> np.ndarray:
    """Mixture weights ``(BUCKETS, 3)`` for the bigram, unigram and uniform estimates, by EM.

    ``cells``: columns bucket, step of the bigram estimate, step of the unigram estimate; ``counts``:
    held-out tokens of each. ``prior`` pseudo-tokens a component keep weights off zero.
    A bucket without held-out tokens gets equal weights; where the context is unseen, the
    bigram weight goes to the unigram estimate.
    """
    def value(steps):
        return np.where(steps > 0, np.exp2(-(steps - 1) / STEPS), 0.0)

    p = np.stack([value(cells[:, 1]), value(cells[:, 2]), np.full(len(cells), 1.0 / (v + 1))], 1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        share = weights[cells[:, 0]] * p
        share *= (counts / share.sum(1))[:, None]
        sums = np.full((BUCKETS, 3), prior)
        np.add.at(sums, cells[:, 0], share)
        new = sums / sums.sum(1, keepdims=True)
        settled = np.abs(new - weights).max() < 1e-9
        weights = new
        if settled:
            break
    weights[0] = [0.0, weights[0, 0] + weights[0, 1], weights[0, 2]]
    return weights


def _blocked(base: DataFrame, block_bytes: int) -> DataFrame:
    """``base(doc_id, text, grp)`` with the ``block`` of each row, the same as its n-grams are sent under."""
    schema = "doc_id long, text string, grp int, block long"

    def deal(batches):
        numbers = _Blocks(block_bytes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", "grp")), pa.array(numbers.of(batch.column("text")), pa.int64())], ["doc_id", "text", "grp", "block"])

    return base.mapInArrow(deal, schema)


def score_texts(docs: DataFrame, held_out: Column, *, deleted: Column | None = None, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Scores every text of ``docs(doc_id, text)`` with a model learned from those that aren't held out.

    ``held_out`` and ``deleted`` are boolean columns of ``docs``; ``deleted`` (by default one training
    text in ten by hash of its doc_id) chooses the texts whose tokens teach the weights. ``docs`` must be a
    stored table, as it is scanned more than once with the same partitions; an error says so if not.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that training texts hold),
    train_tokens, base_score (add-0.1 unigrams), score (the model's log10 probability).
    Null and empty texts consist of the end. Repeated rows count as often as they come and have equal
    scores. Without training texts both estimates are uniform. A text of any length is scored whole, in one task. Empty table: no rows.
    """
    deleted = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("deleted")), F.lit(10)) == 0 if deleted is None else deleted
    group = F.when(held_out, UNSEEN).when(deleted, DELETED).otherwise(TRAIN)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), group.cast("int").alias("grp"))
    base = _blocked(rows, block_bytes)
    ranges = max(1, -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // range_bytes))
    totals = checkpointed(_totals(_sent(rows, ranges, block_bytes)))
    sums = totals.where("block IS NULL").groupBy("kind").agg(F.sum("n_kept").alias("n_kept"), F.sum("n_deleted").alias("n_deleted"), F.sum("v").alias("v"))
    of_kind = {row["kind"]: row for row in sums.collect()}  # two rows
    single = of_kind.get(UNIGRAM)
    n_kept, n_deleted, v = (single["n_kept"], single["n_deleted"], single["v"]) if single else (0, 0, 0)
    n = n_kept + n_deleted
    by_block = totals.where("block IS NOT NULL").select("block", "grp", "kind", "range", "kept", "deleted")

    def gather(key, texts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        one, context, pair, _ = _looked_up(pa.array(texts["text"], pa.large_string()), own, False)
        buckets = bucket_of(context)
        cells = (buckets * GRID + _step(pair / np.maximum(context, 1))) * GRID + _step(one / max(n_kept, 1))
        cell, count = np.unique(cells, return_counts=True)
        return pd.DataFrame({"cell": cell, "n": count})

    learning = base.where(F.col("grp") == DELETED).groupBy("block").cogroup(by_block.where(F.col("grp") == DELETED).groupBy("block")).applyInPandas(gather, "cell long, n long")
    grid = learning.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS * GRID * GRID cells
    cell = np.array([row["cell"] for row in grid], np.int64)
    cells = np.stack([cell // (GRID * GRID), cell // GRID % GRID, cell % GRID], 1)
    weights = learn_weights(cells, np.array([row["n"] for row in grid], float), v)

    def score(key, texts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        group = key[1]
        one, context, pair, begin = _looked_up(pa.array(texts["text"], pa.large_string()), own, True)
        mixed = weights[bucket_of(context)]
        p = mixed[:, 0] * (pair / np.maximum(context, 1)) + mixed[:, 1] * (one / max(n, 1)) + mixed[:, 2] / (v + 1) + (mixed[:, 1] / (v + 1) if n == 0 else 0)
        plain = np.log10((one + 0.1) / (n + 0.1 * (v + 1)))
        return pd.DataFrame({
            "doc_id": texts["doc_id"], "held_out": group == UNSEEN, "n_tokens": np.diff(begin),
            "n_known": np.add.reduceat((one > 0).astype(np.int64), begin[:-1]), "train_tokens": n,
            "base_score": np.add.reduceat(plain, begin[:-1]), "score": np.add.reduceat(np.log10(p), begin[:-1]),
        })

    scored = base.groupBy("block", "grp").cogroup(by_block.groupBy("block", "grp")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored
