from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import text as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab A\t\n\x0b\x0c\r\x1c\u00a0é漢.!"), max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([3, 16, 1 << 21]))
def test_words_are_those_of_plain_splitting(texts, slice_bytes):
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    before, T.SLICE = T.SLICE, slice_bytes
    try:
        hashes, first, start, end = T.words(data, offsets, fold_case=False, spans=True)
    finally:
        T.SLICE = before
    for k, text in enumerate(texts):
        own = slice(first[k], first[k + 1])
        assert [data[a:b].tobytes() for a, b in zip(start[own], end[own], strict=True)] == (text or "").encode().split()
    words = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    assert len(set(words)) == len(set(hashes.tolist()))
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words))


def test_case_is_folded_for_ascii_only():
    data, offsets = T.utf8(pa.array(["ABC abc É é"]))
    hashes, _ = T.words(data, offsets)
    assert hashes[0] == hashes[1] and hashes[2] != hashes[3]


def test_hash_does_not_depend_on_place():
    data, offsets = T.utf8(pa.array(["w " * 1000 + "word", "word"]))
    hashes, first = T.words(data, offsets)
    assert hashes[first[1] - 1] == hashes[first[1]]
    assert len(np.unique(hashes)) == 2
