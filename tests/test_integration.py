"""Communities, neighbourhood features, batch correction and gene selection against plain versions."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import communities as C
from lattica.operators import integration as I
from lattica.operators import vectors


def knn_graph(n=2000, groups=12, k=10, seed=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=5) * 5 + rng.normal(size=(n // groups, 5)) * 1.5 for _ in range(groups)])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return [(i, int(j)) for i, row in enumerate(np.argsort(d, 1)[:, :k]) for j in row]


def plain_modularity(edges, community, resolution=1.0):
    both = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    k, inside = defaultdict(float), 0.0
    for a, b in both:
        k[community[a]] += 1
        inside += community[a] == community[b]
    return inside / len(both) - resolution * sum(v * v for v in k.values()) / len(both) ** 2


def plain_louvain(edges, resolution=1.0, seed=0):
    """Node after node, level after level, in dictionaries."""
    weights = defaultdict(lambda: defaultdict(float))
    for a, b in {(min(e), max(e)) for e in edges}:
        weights[a][b] += 1
        weights[b][a] += 1
    label, total = {v: v for v in weights}, sum(sum(w.values()) for w in weights.values())
    while True:
        own, tot = {v: v for v in weights}, {v: sum(w.values()) for v, w in weights.items()}
        degree, moved, changed = dict(tot), True, False
        while moved:
            moved = False
            for v in random.Random(seed).sample(sorted(weights), len(weights)):
                near = defaultdict(float)
                for u, w in weights[v].items():
                    if u != v:
                        near[own[u]] += w
                tot[own[v]] -= degree[v]
                best = max([own[v], *near], key=lambda c: near[c] - resolution * degree[v] * tot[c] / total + (1e-9 if c == own[v] else 0))
                tot[best] += degree[v]
                if best != own[v]:
                    own[v], moved, changed = best, True, True
        label = {v: own[c] for v, c in label.items()}
        if not changed:
            return label
        merged = defaultdict(lambda: defaultdict(float))
        for v, w in weights.items():
            for u, x in w.items():
                merged[own[v]][own[u]] += x
        weights = merged


def found(df):
    return {r.node: r.community for r in df.collect()}


def test_communities_of_2000_points(spark):
    edges = knn_graph()
    table = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, community int")
    own = found(C.communities(table, nodes=spark.createDataFrame([(5000,), (3,), (None,)], "node long")))
    assert own.pop(5000) == 5000 and len(own) == 1992
    assert all(own[c] == c <= v for v, c in own.items())  # named by the least member
    want = plain_modularity(edges, plain_louvain(edges))
    assert plain_modularity(edges, own) >= 0.99 * want
    labels = spark.createDataFrame(list(own.items()), "node long, community long")
    assert C.modularity(table, labels).first().modularity == pytest.approx(plain_modularity(edges, own))
    hit = C.communities_of_count(table, 15)
    assert len(set(found(hit).values())) == 15 and hit.select("resolution").distinct().count() == 1


def test_communities_over_many_blocks(spark):
    edges = knn_graph(360, 6, 6, seed=3)
    table = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    own = found(C.communities(table, block_nodes=60))
    assert plain_modularity(edges, own) >= 0.99 * plain_modularity(edges, plain_louvain(edges))


def test_search_for_a_count_moves_the_whole_graph_at_one_resolution(spark, monkeypatch):
    """Beyond a block, passes begin from parts of the graph: no table of edges of all resolutions is made of it, and communities are as good as those of the graph itself."""
    edges = knn_graph(360, 6, 6, seed=3)
    table = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    whole, seen, blocked = C.undirected(table).count(), [], C._blocked
    monkeypatch.setattr(C, "_blocked", lambda tables, graph, *more: seen.append(graph.count()) or blocked(tables, graph, *more))
    hit = C.communities_of_count(table, 9, nodes=spark.createDataFrame([(5000,), (3,), (None,)], "node long"), block_nodes=200).cache()
    assert seen and max(seen) <= whole
    own = found(hit)
    resolution = hit.select("resolution").distinct().collect()
    assert len(resolution) == 1 and len(set(own.values())) == 9 and own[5000] == 5000
    assert set(own) == {v for e in edges for v in e} | {5000} and all(own[c] == c <= v for v, c in own.items())
    r = resolution[0].resolution
    got, want = (C.modularity(table, labels.select("node", "community"), r).first().modularity for labels in (hit, C.communities(table, r)))
    assert got >= want - 0.01 * abs(want)


def test_parts_of_a_graph_are_never_joined(spark):
    rows = [(1, 2, 1.0), (2, 1, 3.0), (2, 3, 1.0), (1, 3, 1.0), (7, 8, 0.5), (9, 9, 1.0), (None, 4, 1.0), (5, 6, -1.0), (5, 6, float("nan"))]
    table = spark.createDataFrame(rows, "src long, dst long, w double")
    assert found(C.communities(table, 0.2)) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert sorted(tuple(r) for r in C.undirected(table).where("src < dst").collect()) == [(1, 2, 3.0), (1, 3, 1.0), (2, 3, 1.0), (7, 8, 0.5)]
    assert C.communities(table.where("src = 9")).count() == 0 and C.modularity(table.where("src = 9"), table.selectExpr("src AS node", "src AS community")).first().modularity is None


def plain_harmony(z, batch, centres, theta=2.0, sigma=0.1, ridge=1.0, rounds=4, passes=4):
    n, b, k = len(z), batch.max() + 1, len(centres)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    phi = np.eye(b)[batch]
    shares, y, now = phi.mean(0), unit(centres), z.copy()
    o = np.outer(np.full(k, n / k), shares)
    for _ in range(rounds):
        for last in range(passes + 1):
            r = np.exp(-2 * (1 - unit(now) @ y.T) / sigma) * ((o.sum(1)[:, None] * shares + 1) / (o + 1)).T[batch] ** theta
            r /= r.sum(1, keepdims=True)
            if last < passes:
                o, y = (o + r.T @ phi) / 2, unit(r.T @ unit(now))
        now = z.copy()
        for c in range(k):
            x = np.hstack([np.ones((n, 1)), phi])
            w = np.linalg.solve(x.T @ (r[:, c : c + 1] * x) + ridge * np.diag([0] + [1] * b), x.T @ (r[:, c : c + 1] * z))
            w[0] = 0
            now -= r[:, c : c + 1] * (x @ w)
    return now


def test_batches_mix_after_correction(spark):
    rng = np.random.default_rng(2)
    means = rng.normal(size=(4, 6)) * 4
    batch, kind = rng.integers(0, 3, 360), rng.integers(0, 4, 360)
    z = means[kind] + rng.normal(size=(360, 6)) * 0.5 + batch[:, None] * np.array([1.5, -1, 1, 0, 0.5, 2])
    rows = spark.createDataFrame([(i, f"s{b}", v.tolist()) for i, (b, v) in enumerate(zip(batch, z, strict=True))] + [(999, "s0", None)], "id long, batch string, vector array<double>").repartition(4)
    centres = z[rng.permutation(360)[:8]]
    out = I.harmonised(rows, centres=centres)
    got = {r.id: r.corrected for r in out.collect()}
    assert np.allclose([got[i] for i in range(360)], plain_harmony(z, batch, centres), atol=1e-8) and 999 not in got

    def mixing(column):
        v = out.select("id", F.col(column).alias("vector"))
        scores = vectors.ilisi(vectors.vector_knn(v, v, 30), out.select("id", "batch"), 30)
        return vectors.scaled_median(scores, "ilisi", 3).first().scaled

    assert mixing("corrected") > mixing("vector") + 0.3
    one = I.harmonised(rows.where("batch = 's0'"), 3)
    assert all(np.allclose(r.corrected, r.vector, atol=1e-6) for r in one.collect()) and I.harmonised(rows.limit(0)).count() == 0


def test_gradients_of_neighbours(spark):
    """Around (0, 0) the value rises to the right only: its gradient is as large as its weighted sum of cosines."""
    points = [(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, -1.0, 0.0), (0, 3, 0.0, 1.0), (0, 4, 0.0, -1.0), (1, 9, 0.0, 0.0)]
    values = [(1, "g", 4.0), (2, "g", -4.0), (9, "flat", 0.0)]
    p = spark.createDataFrame(points, "section_id int, id long, x double, y double")
    rows = {(r.id, r.m, r.feature): r.value for r in I.banksy_features(p, spark.createDataFrame(values, "id long, feature string, value double"), k=2, max_m=1, mix=0.5).collect()}
    assert len(rows) == 6 * 3 * 2 and all(v == 0 for (_, _, f), v in rows.items() if f == "flat")
    w = I.neighbour_weights(spark.createDataFrame([(0, 0, j, 1.0) for j in (1, 2, 3, 4)], "section_id int, src long, dst long, d2 double"), p, 1).collect()
    assert [r.w for r in w] == pytest.approx([0.25] * 4) and sum(r.re * dict((i, v) for i, _, v in values).get(r.dst, 0) for r in w) == pytest.approx(2.0)
    assert rows[(0, 1, "g")] == max(v for (_, m, f), v in rows.items() if (m, f) == (1, "g"))


def test_neighbourhood_features_equal_plain_ones_and_move_points_not_features(spark, monkeypatch):
    """Sparse values, three orders, two sections, a point alone; no shuffle has a row for each feature of each neighbour."""
    rng = np.random.default_rng(12)
    xy, section, k, mix = rng.normal(size=(61, 2)), np.append(rng.integers(0, 2, 60), 2), 3, 0.3
    v = np.where(rng.uniform(size=(61, 4)) < 0.5, rng.normal(size=(61, 4)), 0.0)
    plans, keep = [], I.Tables.keep
    monkeypatch.setattr(I.Tables, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    points = spark.createDataFrame([(int(s), i, *map(float, p)) for i, (s, p) in enumerate(zip(section, xy, strict=True))], "section_id int, id long, x double, y double")
    values = spark.createDataFrame([(i, f"g{j}", float(v[i, j])) for i in range(61) for j in range(4) if v[i, j]] + [(99, "g0", 5.0)], "id long, feature string, value double")
    got = {(r.id, r.m, r.feature): r.value for r in I.banksy_features(points, values, k=k, max_m=2, mix=mix).collect()}
    want = np.zeros((4, 61, 4))
    want[0] = v
    for i in range(61):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
        others = sorted((d[j], j) for j in range(61) if j != i and section[j] == section[i])
        for m in range(3):
            near = [j for _, j in others[: k * (m + 1)]]
            if near:
                w = np.exp(-((d[near] / np.median(d[near])) ** 2))
                w /= w.sum()
                turn = w * np.exp(1j * m * np.arctan2(xy[near, 1] - xy[i, 1], xy[near, 0] - xy[i, 0]))
                want[m + 1, i] = w @ v[near] if m == 0 else np.abs(turn @ (v[near] - w @ v[near]))
    want = (want - want.mean(1, keepdims=True)) / want.std(1, keepdims=True)
    want *= np.sqrt([1 - mix, *(mix / 1.75 * 2.0**-m for m in range(3))])[:, None, None]
    assert len(got) == want.size
    # a gradient is of values less their weighted mean of the same order
    for (i, m, f), value in got.items():
        assert abs(value - want[m + 1, i, int(f[1])]) < 1e-8
    assert len(plans) == 2 and not any("hashpartitioning" in line and "feature" in line for plan in plans for line in plan.split("\n"))


def test_local_quadratic_is_exact_on_a_parabola_and_equals_plain_fits():
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, 60)
    assert np.allclose(I.local_quadratic(x, 1 + x - 3 * x * x), 1 + x - 3 * x * x)
    y = np.sin(3 * x) + rng.normal(size=60)
    for i, fit in enumerate(I.local_quadratic(x, y)):
        near = np.argsort(abs(x - x[i]))[:18]
        w = (1 - (abs(x[near] - x[i]) / abs(x[near] - x[i]).max()) ** 3) ** 3
        assert np.polyval(np.polyfit(x[near], y[near], 2, w=np.sqrt(w)), x[i]) == pytest.approx(fit)
    assert np.allclose(I.local_quadratic(np.ones(5), np.arange(5.0)), 2.0)


def test_genes_that_vary_are_chosen(spark):
    rng = np.random.default_rng(5)
    counts = rng.poisson(np.linspace(0.5, 8, 40), (120, 40))
    counts[:60, 7] *= 6
    counts[:, 39] = 3  # flat
    rows = [(c, g, int(v)) for c in range(120) for g, v in enumerate(counts[c]) if v]
    cells = spark.createDataFrame([(c, c % 2) for c in range(120)], "cell_id long, batch int")
    out = {r.gene_id: r for r in I.seurat_v3(spark.createDataFrame(rows, "cell_id long, gene_id long, value long"), cells, 5).collect()}
    assert len(out) == 40 and sum(r.chosen for r in out.values()) == 5 and out[7].rank == 0 and out[7].batches == 2
    assert out[39].variance == 0 and not out[39].chosen
    own = counts[0::2].astype(float)
    mean, var = own.mean(0), own.var(0, ddof=1)
    fit = np.zeros(40)
    fit[var > 0] = I.local_quadratic(np.log10(mean[var > 0]), np.log10(var[var > 0]))
    sd = np.sqrt(10**fit)
    first = ((np.minimum(own, mean + sd * math.sqrt(60)) - mean) ** 2).sum(0) / (59 * sd**2)
    assert np.argmax(first) == 7


def test_joins_of_community_rounds_do_not_pass_through_the_driver(spark):
    """Tables small enough to be broadcast are shuffled all the same: over the rounds they add up."""
    a, b = spark.range(50).withColumnRenamed("id", "node"), spark.range(40).selectExpr("id AS node", "id % 3 AS community")
    for how in ("inner", "left", "left_anti"):
        joined = C._joined(a, b, ["node"], how)
        assert joined.count() == {"inner": 40, "left": 50, "left_anti": 10}[how]
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString() and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
