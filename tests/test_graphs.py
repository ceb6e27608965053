"""Medians by brackets, and features of neighbour graphs, against plain versions."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import graphs
from lattica.operators.quantiles import medians


def test_medians_equal_exact_ones(spark):
    rng = np.random.default_rng(5)
    groups = {"odd": rng.normal(size=801), "even": rng.normal(size=500), "ties": rng.integers(0, 3, 400).astype(float), "one": np.array([7.0]), None: np.array([1.0, 2.0, math.inf]), "flat": np.full(900, 2.5)}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("none", None), ("none", None), ("odd", math.nan), ("odd", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for accuracy in (20, 100, 10_000):
        found = {r.g: (r["median"], r.n) for r in medians(df, ["g"], "v", accuracy).collect()}
        assert found == {k: (float(np.median(own)), len(own)) for k, own in groups.items()} | {"none": (None, 0)}
    whole = medians(df, [], "v").collect()
    assert [tuple(r) for r in whole] == [(float(np.median(np.concatenate(list(groups.values())))), sum(map(len, groups.values())))]


def test_median_of_a_large_group_orders_few_rows(spark):
    df = spark.range(300_000).selectExpr("id % 2 AS g", "cast(hash(id) AS double) AS v")
    want = {r.g: r.m for r in df.groupBy("g").agg({"v": "median"}).withColumnRenamed("median(v)", "m").collect()}
    assert {r.g: r["median"] for r in medians(df, ["g"], "v").collect()} == want


def test_medians_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert medians(empty, ["g"], "v").collect() == []
    assert [tuple(r) for r in medians(empty, [], "v").collect()] == [(None, 0)]


def ring(n: int, chords: list[tuple[int, int]]) -> set[tuple[int, int]]:
    pairs = {(i, (i + 1) % n) for i in range(n)} | set(chords)
    return pairs | {(b, a) for a, b in pairs}


def plain_values(pairs: set[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    names = sorted({a for a, _ in pairs})
    at = {v: i for i, v in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for x, y in pairs:
        a[at[x], at[y]] = 1.0
    d = a.sum(1)
    lap = np.eye(len(a)) - a / np.sqrt(np.outer(d, d))
    return np.linalg.eigvalsh(lap), lap


def test_spectral_coordinates_equal_dense_ones(spark):
    rng = np.random.default_rng(3)
    blocks = {(int(a) + 40 * g, int(b) + 40 * g) for g in range(3) for a, b in rng.integers(0, 40, (200, 2)) if a != b} | {(5, 45), (50, 90), (2, 100)}
    sets = {"ring": ring(60, [(0, 30), (7, 45)]), "blocks": blocks | {(b, a) for a, b in blocks}, "tiny": ring(3, [])}
    rows = [(g, a, b) for g, pairs in sets.items() for a, b in pairs]
    df = spark.createDataFrame(rows, "graph string, src long, dst long").repartition(5)
    coords, values = graphs.spectral_coordinates(df, 4, steps=10, cycles=8, tolerance=1e-6)
    by = {}
    for r in coords.collect():
        by.setdefault(r.graph, {})[r.node] = r.coords
    for g, pairs in sets.items():
        exact, lap = plain_values(pairs)
        n = min(4, len(exact))
        assert len(values[g]) == n and np.allclose([v for v, _ in values[g]], exact[:n], atol=1e-8), (g, values[g], exact[:n])
        assert all(error <= 1e-6 for _, error in values[g]), values[g]
        x = np.array([by[g][v] for v in sorted(by[g])])[:, :n]
        assert np.allclose(x.T @ x, np.eye(n), atol=1e-7)
        assert np.abs(lap @ x - x * exact[:n]).max() < 2e-6


def test_spectral_errors_are_bounds(spark):
    """After too few steps the values are off, by no more than is said."""
    df = spark.createDataFrame([("r", a, b) for a, b in ring(90, [(0, 30)])], "graph string, src long, dst long")
    exact, _ = plain_values(ring(90, [(0, 30)]))
    (found,) = graphs.spectral_coordinates(df, 3, steps=3)[1].values()
    assert all(np.abs(exact - v).min() <= error + 1e-12 for v, error in found) and max(error for _, error in found) > 1e-4


def test_spectral_coordinates_of_nothing(spark):
    coords, values = graphs.spectral_coordinates(spark.createDataFrame([], "graph string, src long, dst long"), 3)
    assert coords.count() == 0 and values == {}


def test_spectral_steps_move_a_row_a_node_between_places(spark, monkeypatch):
    """Parts of a few nodes, by place and by hash, give the dense values; with places a step gives few rows more than nodes, however many edges there are."""
    monkeypatch.setattr(graphs, "PART_NODES", 12)
    pairs = {(i, (i + j) % 48) for i in range(48) for j in (1, 2, 3)} | {(0, 24)}
    pairs |= {(b, a) for a, b in pairs}
    df = spark.createDataFrame([("r", a, b) for a, b in pairs], "graph string, src long, dst long").repartition(3)
    places = spark.createDataFrame([("r", i, i // 16) for i in range(48)], "graph string, node long, place long")
    exact, _ = plain_values(pairs)
    for of in (places.where("node > 20"), None):
        coords, values = graphs.spectral_coordinates(df, 3, steps=10, places=of)
        assert coords.count() == 48 and np.allclose([v for v, _ in values["r"]], exact[:3], atol=1e-8)
    monkeypatch.setattr(graphs, "PART_NODES", 16)
    degree = graphs._parts(df.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").cast("double").alias("degree")), places)
    x = degree.select("graph", "part", "node", F.array(F.sqrt("degree")).alias("x"))
    moved = graphs._moved(graphs._packed(df, degree), x, 1)
    sums = {r.node: r.y for r in moved.groupBy("node").agg(F.sum(F.col("y")[0]).alias("y")).collect()}
    assert moved.count() == 3 * (16 + 6) + 2 and all(abs(sums[r.node] - r.degree**0.5) < 1e-9 for r in degree.collect())


def test_places_hold_points_that_lie_together(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, *map(float, rng.normal(size=2))) for s in (0, 1) for i in range(2000 if s else 3000)]
    found = graphs.point_places(spark.createDataFrame(rows, "section_id int, id long, x double, y double"), 200).collect()
    xy, by = {(s, i): (x, y) for s, i, x, y in rows}, {}
    for r in found:
        by.setdefault((r.section_id, r.place), []).append(xy[r.section_id, r.id])
    assert len(found) == 5000 and max(map(len, by.values())) < 260 and len(by) == 32
    assert np.median([np.ptp(np.array(v), axis=0).max() for v in by.values()]) < 2.5


def test_random_walks_equal_plain_ones(spark):
    pairs = ring(12, [(0, 6), (1, 4)])
    df = spark.createDataFrame([("g", a, b) for a, b in pairs], "graph string, src long, dst long")
    near = {v: sorted(b for a, b in pairs if a == v) for v in range(12)}
    want = set()
    for node in range(12):
        for walk in (1, 2, 3):
            at = node
            want.add((node, walk, 0, at))
            for step in range(1, 6):
                draw = int(hashlib.md5(f"9:g:{node}:{walk}:{step}".encode()).hexdigest()[:12], 16)
                at = near[at][draw % len(near[at])]
                want.add((node, walk, step, at))
    walks = graphs.random_walks(df, 5, 3, seed=9)
    found = [(r.node, r.walk, r.step, r.at) for r in walks.collect()]
    assert len(found) == len(want) and set(found) == want
    steps = {(n, w, s): a for n, w, s, a in want}
    counts = Counter((a, steps[n, w, s + d]) for n, w, s, a in want for d in (1, 2) if (n, w, s + d) in steps)
    assert {(r.a, r.b): r.n for r in graphs.co_visits(walks, 2).collect()} == counts


@pytest.mark.parametrize("ks", [[2], [1, 3, 5]])
def test_neighbour_scales_take_ranks_of_one_search(spark, ks):
    rng = np.random.default_rng(1)
    points = [(int(s), int(i), *map(float, rng.normal(size=2))) for s in range(2) for i in range(25)]
    found = {tuple(r) for r in graphs.neighbour_scales(spark.createDataFrame(points, "section_id int, id long, x double, y double"), ks).collect()}
    want = set()
    for s, i, x, y in points:
        others = sorted(((x - u) ** 2 + (y - v) ** 2, j) for t, j, u, v in points if t == s and j != i)
        for k in ks:
            for _, j in others[:k]:
                want |= {(s, k, i, j), (s, k, j, i)}
    assert found == want
