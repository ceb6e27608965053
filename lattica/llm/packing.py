"""Packing of documents into training sequences by order-preserving dynamic programming.

Each scan partition is one stream of tokens in its rows' order. A stream is cut into windows of at most
``length`` tokens. The cost of a window is its padding; the cost of a cut is 0 at the end of
a document, ``sentence_penalty`` at the end of a sentence and ``hard_penalty`` elsewhere (candidates
there are set only where no other boundary comes for a 32nd of a window). With f(i) the least cost of
the stream up to boundary i at token p(i),

    f(i) = cut(i) + length - p(i) + min over j with p(i) - length <= p(j) < p(i) of (f(j) + p(j)),

and the minimum over a moving window is kept by a monotone queue: constant time per boundary. The last
window costs what its rest does below.

A stream goes through in runs of bounded tokens. Of a run only the windows are cut that all least-cost ways to its last window's length of
boundaries share; the rest goes on to the next run. So runs don't show in the result: the cuts are the best of the whole partition,
and only its end has a short window. That rest is
split into powers of two, which need no padding, where this costs less than padding it.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

LENGTH = 4096
END_ID = 2
SENTENCE_PENALTY, HARD_PENALTY, PIECE_PENALTY = 8, 64, 32
#: Tokens that are cut at once; a longer document is one run of its own.
RUN_TOKENS = 1 << 20
#: Bytes of text that are tokenised at once, and distinct words that a worker remembers.
BATCH_BYTES, CACHE_WORDS = 4 << 20, 3_000_000
TOKENIZER = "word_bpe_49k.json"
#: Texts that a worker tokenises both ways.
TRIAL_TEXTS = 64

DOC, SENTENCE, HARD = 0, 1, 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of whole texts from ids of words: exact for tokenizers that never look across white space.

    Distinct words are tokenised once and remembered in sorted arrays, by 64-bit hash. The first texts that a worker sees are
    tokenised both ways; where these differ it takes whole texts from then on, with sentence ends unknown.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word: bool | None = None  # not yet known
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        lists = []
        for lo in range(0, len(words), 20_000):
            lists += [e.ids for e in self.tokenizer.encode_batch_fast(words[lo : lo + 20_000], add_special_tokens=False)]
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for own in lists for i in own), np.uint32, int(count.sum()))
        begin = self.used + np.cumsum(count) - count
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.count = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """``(ids, first, word_end, is_last)``: ids of all texts in a row, where each text starts, and after which
        ids a word ends, with whether it ends a sentence."""
        if self.by_word is None:
            self.by_word = True  # try it
            ids, first, *_ = self.encode(data, offsets)
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:TRIAL_TEXTS], offsets[1 : TRIAL_TEXTS + 1], strict=False)]
            whole = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            self.by_word = all(own.ids == ids[first[k] : first[k + 1]].tolist() for k, own in enumerate(whole))
        if not self.by_word:
            whole = self.tokenizer.encode_batch_fast([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)], add_special_tokens=False)
            first = np.concatenate([[0], np.cumsum([len(own.ids) for own in whole])]).astype(np.int64)
            return np.fromiter((i for own in whole for i in own.ids), np.uint32, int(first[-1])), first, np.zeros(0, np.int64), np.zeros(0, bool)
        hashes, first, start, end = T.words(data, offsets, fold_case=False, spans=True)
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        distinct, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes() if len(data) < 1 << 26 else memoryview(data)
            self._learn(distinct[new], [bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(start[sample[new]], end[sample[new]], strict=True)])
            at = np.searchsorted(self.keys, distinct)
        count = self.count[at][place]
        word_end = np.cumsum(count)
        where = np.repeat(self.begin[at][place] - (word_end - count), count) + np.arange(word_end[-1] if len(word_end) else 0)
        edges = np.concatenate([[0], word_end])
        closes = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)) if len(end) else np.zeros(0, bool)
        return self.ids[where], edges[first], word_end, closes


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _ways_back(position: np.ndarray, kind: np.ndarray, length: int, sentence_penalty: int, hard_penalty: int) -> tuple[list, list]:
    """Least cost up to each boundary, 0 being the start, as a cut, and the boundary where the last window of that way starts."""
    n = len(position)
    places = position.tolist()
    cost = (np.array([0, sentence_penalty, hard_penalty])[kind] + length - position).tolist()
    best, back = [0] * (n + 1), [0] * (n + 1)
    queue, key, at = [0], [0], [0]  # boundaries in reach, with rising f(j) + p(j), and their positions
    head = 0
    for i in range(n):
        p = places[i]
        while at[head] < p - length:
            head += 1
        f = key[head] + cost[i]
        back[i + 1] = queue[head]
        best[i + 1] = f
        own = f + p
        while len(queue) > head and key[-1] >= own:
            queue.pop()
            key.pop()
            at.pop()
        queue.append(i + 1)
        key.append(own)
        at.append(p)
    return best, back


def _cuts_to(back: list[int], i: int) -> list[int]:
    cuts = []
    while i > 0:
        cuts.append(i - 1)
        i = back[i]
    return cuts[::-1]


def cut_windows(position: np.ndarray, kind: np.ndarray, length: int, sentence_penalty: int = SENTENCE_PENALTY, hard_penalty: int = HARD_PENALTY, rest_cost=lambda size: 0) -> list[int]:
    """Indexes of the boundaries at which windows end, the last boundary included.

    ``position``: increasing token positions of all boundaries, each at most ``length`` after the one
    before; ``kind``: DOC, SENTENCE or HARD. The stream starts at 0 and ends at the last position.
    The last window isn't padded: it costs ``rest_cost`` of its size.
    """
    n = len(position)
    best, back = _ways_back(position, kind, length, sentence_penalty, hard_penalty)
    places = [0, *position.tolist()]
    reach, least = n - 1, None
    while reach >= 0:
        size = places[n] - places[reach]
        if size > length:
            break
        total = best[reach] + rest_cost(size)
        if least is None or total < least:
            least, back[n] = total, reach
        reach -= 1
    return _cuts_to(back, n)


def shared_cuts(position: np.ndarray, kind: np.ndarray, length: int, sentence_penalty: int = SENTENCE_PENALTY, hard_penalty: int = HARD_PENALTY) -> list[int]:
    """Indexes of the cuts that are settled whatever follows: those on the way to every boundary at which a later window may start."""
    _, back = _ways_back(position, kind, length, sentence_penalty, hard_penalty)
    open_ = [int(i) + 1 for i in np.flatnonzero(position >= position[-1] - length)]
    if position[-1] <= length:
        open_.append(0)
    heap = [-i for i in set(open_)]
    heapq.heapify(heap)
    while len(heap) > 1:  # the latest goes one window back until all ways are one
        latest = -heapq.heappop(heap)
        while heap and heap[0] == -latest:
            heapq.heappop(heap)
        if not heap:
            return _cuts_to(back, latest)
        heapq.heappush(heap, -back[latest])
    return _cuts_to(back, -heap[0])


def boundaries(n_tokens: int, doc_end: np.ndarray, sentence_end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All candidate cuts, rising: ends of documents and sentences, and others where these are far apart."""
    soft = np.union1d(doc_end, sentence_end)
    soft = soft[(soft > 0) & (soft <= n_tokens)]
    gaps = np.diff(np.concatenate([[0], soft]))
    step = max(1, length // 32)
    extra = [np.arange(at - gap + step, at, step) for at, gap in zip(soft[gaps > step], gaps[gaps > step], strict=True)]
    position = np.union1d(soft, np.concatenate(extra)) if extra else soft
    kind = np.full(len(position), HARD)
    kind[np.isin(position, sentence_end)] = SENTENCE
    kind[np.isin(position, doc_end)] = DOC
    return position.astype(np.int64), kind


def split_rest(size: int, length: int) -> list[int]:
    """A last window of ``size`` tokens: as it is, or as powers of two if these cost less than its padding."""
    parts, rest = [], size
    while rest:
        parts.append(1 << (rest.bit_length() - 1))
        rest -= parts[-1]
    return [size] if length - size <= PIECE_PENALTY * (len(parts) - 1) else parts


def rest_cost(size: int, length: int) -> int:
    return min(length - size, PIECE_PENALTY * (size.bit_count() - 1))


class _Stream:
    """The tokens of a partition that aren't cut yet, and the documents they belong to."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.ids, self.sentence_end, self.size = [], [], 0
        self.docs: list[list] = []  # doc_id, its tokens, tokens before this stream's start, end position here
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, sentences: np.ndarray) -> None:
        self.ids.append(ids)
        self.sentence_end.append(sentences + self.size)
        self.size += len(ids)
        self.docs.append([doc_id, len(ids), 0, self.size])

    def cut(self, final: bool) -> None:
        if not self.size:
            return
        ids = np.concatenate(self.ids)
        sentences = np.concatenate(self.sentence_end)
        position, kind = boundaries(self.size, np.array([d[3] for d in self.docs]), sentences, self.length)
        found = cut_windows(position, kind, self.length, rest_cost=lambda size: rest_cost(size, self.length)) if final else shared_cuts(position, kind, self.length)
        ends = [int(position[k]) for k in found]
        if final:
            begin = ends[-2] if len(ends) > 1 else 0
            ends[-1:] = [begin + x for x in np.cumsum(split_rest(self.size - begin, self.length)).tolist()]
        at, k = 0, 0
        for end in ends:
            offset = 0
            while at < end:
                doc_id, tokens, before, doc_end = self.docs[k]
                upto = min(end, doc_end)
                start = tokens - (doc_end - at)
                self.rows.append((doc_id, start, upto - at, zlib.crc32(ids[at:upto].astype("<u4").tobytes()), tokens, self.sequence, offset))
                offset += upto - at
                at = upto
                if upto == doc_end:
                    k += 1
            self.sequence += 1
        self.ids, self.size = [ids[at:]], self.size - at
        self.sentence_end = [sentences[sentences > at] - at]
        self.docs = [[d, n, b, e - at] for d, n, b, e in self.docs[k:]]


def pack_documents(docs: DataFrame, *, length: int = LENGTH, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)`` in sequences of at most ``length`` tokens; other columns are not read.

    A document's tokens are its text's ids and then ``end_id``; a null or empty text has the end alone. Each token lies
    in one piece, and pieces of a sequence follow one another from offset 0. Returns doc_id, start (the document's
    tokens before the piece), length, ids_crc32 (of its little-endian 32-bit ids), doc_tokens, sequence_id, offset.
    Null doc_ids are kept; repeated rows are packed as often as they come. Empty table: no rows. A text of any length is taken whole; its
    tokens must fit a task.
    ``path`` names a tokenizer file that the tasks can open (default: the installed one).
    No shuffle; a sequence_id holds the partition's number in its upper bits.
    """
    types = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

    def pack(batches):
        words = encoder(path or tokenizer_path())
        stream, limit = _Stream(length, TaskContext.get().partitionId() << 33), RUN_TOKENS

        def flush():
            columns = list(zip(*stream.rows, strict=True)) or [[]] * len(types)
            stream.rows = []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types.values(), strict=True)], list(types))

        end = np.array([end_id], np.uint32)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            data, offsets = T.utf8(batch.column("text"))
            lo = 0
            while lo < len(names):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BATCH_BYTES, "right")) - 1)
                part = data[offsets[lo] : offsets[hi]]
                ids, first, word_end, closes = words.encode(part, offsets[lo : hi + 1] - offsets[lo])
                closed = word_end[closes]
                inside = np.searchsorted(closed, first, "right")
                for k in range(hi - lo):
                    own = np.concatenate([ids[first[k] : first[k + 1]], end])
                    stream.add(names[lo + k], own, closed[inside[k] : inside[k + 1]] - first[k])
                    if stream.size >= limit:
                        stream.cut(final=False)
                        limit = max(RUN_TOKENS, 2 * stream.size)
                lo = hi
            if len(stream.rows) > 10_000:
                yield flush()
        stream.cut(final=True)
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
