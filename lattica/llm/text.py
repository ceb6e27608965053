"""Words and word hashes of whole Arrow text columns, vectorised over batches.

A word is a run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; all of these are
ASCII, so words can be cut from UTF-8 bytes without decoding.  Hashes have 64
bits: with ``n`` distinct strings, ``n * n / 2**65`` collisions are expected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes that are hashed at once; longer texts are cut at white space.
SLICE = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


def _byte_values(fold_case: bool) -> np.ndarray:
    table = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        table[65:91] = table[97:123]
    table[_IS_SPACE] = 0
    return table


_VALUES = {fold: _byte_values(fold) for fold in (True, False)}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of the sequence of the given hashes, element by element."""
    out = np.full(parts[0].shape, len(parts), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(_BASE) + part)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each text's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Slices of about SLICE bytes: (start, end, breaks inside the slice)."""
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        end = min(last, at + SLICE)
        if end < last:
            fits = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if fits > at:
                end = fits
            else:  # one text is longer: up to the last white space, or else to the next
                spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
                doc_end = int(offsets[np.searchsorted(offsets, at, "right")])
                while not len(spaces) and end < doc_end:
                    end = min(doc_end, end + SLICE)
                    spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
                end = at + int(spaces[-1]) + 1 if len(spaces) else doc_end
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        yield at, end, inside
        at = end


def words(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True, spans: bool = False):
    """Hashes of all words in order, and at which word each text starts.

    Returns ``(hashes, first)`` with ``len(first) == len(offsets)``; with ``spans``
    also the words' byte positions ``(hashes, first, start, end)``.
    """
    values, out, starts, ends = _VALUES[fold_case], [], [], []
    for at, end, inside in _pieces(data, offsets):
        part = data[at:end]
        gap = _IS_SPACE[part]
        before = np.empty(len(part), bool)
        before[0], before[1:] = True, gap[:-1]
        before[inside] = True
        start = np.flatnonzero(before & ~gap)
        if not len(start):
            continue
        power, inverse = powers(len(part))
        sums = np.add.reduceat(values[part] * power[: len(part)], start)
        out.append(mix(sums * inverse[start]))
        starts.append(start + at)
        if spans:
            after = np.empty(len(part), bool)
            after[-1], after[:-1] = True, gap[1:]
            after[inside[inside > 0] - 1] = True
            ends.append(np.flatnonzero(after & ~gap) + 1 + at)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    first = np.searchsorted(start, offsets)
    if spans:
        return hashes, first, start, (np.concatenate(ends) if ends else np.zeros(0, np.int64))
    return hashes, first
