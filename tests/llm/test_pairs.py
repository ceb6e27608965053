"""Exact and near duplicates against plain versions."""

from __future__ import annotations

import hashlib
import random

import pytest

from lattica.llm import exact_dedup, near_dup
from lattica.llm.cluster import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, bucket int, digest string, sid long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 7) for i, t in rows], SCHEMA)


def strip(text):
    return "".join(c for c in (text or "") if c not in " \t\n\x0b\x0c\r")


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(strip(t), []).append((i, t or ""))
    out = {}
    for own in groups.values():
        keep = min(own, key=lambda r: (-len(r[1]), r[0]))[0]
        for i, t in own:
            out[i] = (keep, len(own), i == keep, hashlib.sha256(strip(t).encode()).hexdigest())
    return out


@pytest.mark.parametrize("capacity", [1, 3, 512])
def test_exact_groups(spark, capacity):
    rng = random.Random(3)
    texts = ["a b", "ab", " a  b\n", "", None, "é\u00a0x", "x" * 5000, "c d e"]
    rows = [(i, rng.choice(texts)) for i in range(120)] + [(200, "single")]
    found = exact_dedup.exact_duplicates(documents(spark, rows).repartition(5), capacity).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == plain_exact(rows)
    kept = exact_dedup.drop_exact_duplicates(documents(spark, rows), capacity)
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in plain_exact(rows).items() if x[2])


def test_exact_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None)]
    for capacity in (1, 8):
        found = exact_dedup.exact_duplicates(documents(spark, rows), capacity).collect()
        assert len(found) == 7 and sum(r.kept for r in found) == 3
        assert {r.keep_id for r in found if r.text_sha256 == hashlib.sha256(b"a").hexdigest()} == {1}
        assert exact_dedup.drop_exact_duplicates(documents(spark, rows), capacity).count() == 3
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0
    assert exact_dedup.drop_exact_duplicates(documents(spark, [])).count() == 0


def test_misra_gries_finds_every_frequent_key(spark):
    rng = random.Random(5)
    keys = ["hot"] * 300 + ["warm"] * 120 + [f"k{rng.randrange(400)}" for _ in range(580)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    found = {r.key: r.counter for r in exact_dedup.misra_gries(df, "key", 20).collect()}
    assert {"hot", "warm"} <= set(found) and len(found) <= 20
    assert all(n <= keys.count(k) for k, n in found.items())


def plain_near(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(shingle, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    passage = [word() for _ in range(30)]
    rows, base = [], []
    for i in range(90):
        kind = i % 6
        if kind == 0 or not base:
            base = [word() for _ in range(rng.randrange(8, 60))]
            text = base
        elif kind < 4:  # a chain of edits
            base = list(base)
            base[rng.randrange(len(base))] = word()
            text = base
        elif kind == 4:
            text = passage + [word() for _ in range(rng.randrange(1, 12))]
        else:
            text = base + [word()]
        rows.append((i, " ".join(text).upper() if i % 7 == 0 else "\t".join(text)))
    return [*rows, (90, ""), (91, None), (92, "one"), (93, "ONE"), (94, "two words"), (95, " \n "), (96, "ça Ça"), (97, "ça ça")]


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_components_equal_brute_force(spark, shingle, percent):
    rows = near_rows(shingle)
    found = near_dup.near_duplicates(documents(spark, rows), shingle=shingle, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == plain_near(rows, shingle, percent)
    kept = near_dup.drop_near_duplicates(documents(spark, rows), shingle=shingle, percent=percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in plain_near(rows, shingle, percent).items() if x[2])


def test_near_group_of_many_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(250):
        text = list(base)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(120)] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(text)))
    found = near_dup.near_duplicates(documents(spark, rows), shingle=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == plain_near(rows, 3, 85)


def test_near_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (None, "q r s t"), (2, None)]
    found = near_dup.near_duplicates(documents(spark, rows), shingle=3, percent=85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (2, 2)]
    assert near_dup.drop_near_duplicates(documents(spark, rows), shingle=3, percent=85).count() == 5
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_paths_cycles_and_hubs(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(500, 501 + k) for k in range(30)] + [(None, 3), (2, None), (100, 101)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {**{k: 0 for k in range(21)}, **{k: 100 for k in (100, 101, 102)}, **{k: 500 for k in range(500, 531)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
