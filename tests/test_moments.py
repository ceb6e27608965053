"""Figures about the mean where means are large, tiles of kernels, and columns told by names and values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import columns, coupling, panel, reports, vectors


@pytest.mark.parametrize("mean", [0.0, 1e6, 1e9])
def test_correlation_with_large_means(spark, mean):
    rng = np.random.default_rng(1)
    a = mean + rng.normal(size=500)
    b = mean + (a - mean + rng.normal(size=500))
    rows = spark.createDataFrame([(0, i, float(x), float(y), "all") for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(1, 0, mean, 1.0, "all"), (1, 1, mean, 2.0, "all"), (0, 900, None, 3.0, "all")], "row int, col int, target double, predicted double, part string").repartition(3)
    found = {r.row: r.pearson for r in panel.pearson(rows, ["row"]).collect()}
    assert found[0] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9 if mean < 1e9 else 1e-6) and found[1] is None
    pooled = reports.pooled_pearson(rows.where("row = 0"), ["part"]).first()
    assert pooled.pearson == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)


def test_correlation_with_zeros_left_out(spark):
    rng = np.random.default_rng(2)
    a, b = rng.poisson(0.7, 80) * 1.5, rng.poisson(0.7, 80) * 1.0
    rows = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x or y], "row int, col int, target double, predicted double")
    assert panel.pearson(rows, ["row"], F.lit(80)).first().pearson == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_variance_of_large_values(spark):
    rng = np.random.default_rng(3)
    logs = 30 + rng.normal(size=(60, 3)) * [1e-6, 2e-6, 1e-7]
    rows = spark.createDataFrame([(c, g, float(np.expm1(logs[c, g]))) for c in range(60) for g in range(3)], "cell_id long, gene_id long, value double")
    found = panel.top_variance(rows, 60, 3).orderBy("rank").collect()
    assert [r.gene_id for r in found] == [1, 0, 2]
    assert [r.variance for r in found] == pytest.approx([logs[:, g].var() for g in (1, 0, 2)], rel=1e-3)


def test_alignment_with_large_means(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = x @ rng.normal(size=(3, 2)) + rng.normal(size=(200, 2))

    def figures(shift):
        df = spark.createDataFrame([((u + shift).tolist(), (v - shift).tolist()) for u, v in zip(x, y, strict=True)] + [(None, [0.0, 0.0])], "x array<double>, y array<double>").repartition(3)
        return vectors.linear_cka(df, "x", "y", 3, 2).first().cka, coupling.canonical_correlation(df, "x", "y", 2)

    assert figures(1e6) == pytest.approx(figures(0.0), abs=1e-7)


def test_discrepancy_of_all_pairs_of_batches(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_ROWS", 16)
    rng = np.random.default_rng(5)
    batch = rng.integers(0, 3, 150)
    z = rng.normal(size=(150, 4)) * 0.4 + batch[:, None]
    rows = spark.createDataFrame([(i, f"b{k}", v.tolist()) for i, (k, v) in enumerate(zip(batch, z, strict=True))] + [(900, None, [0.0] * 4), (901, "alone", [0.0] * 4)], "id long, batch string, vector array<double>").repartition(4)

    def mean(x, y):
        return np.exp(-(np.abs(x[:, None] - y[None]).sum(2) ** 2) / 2).mean()

    found = {(r.a, r.b): r.mmd for r in vectors.mmd_between_batches(rows).collect()}
    assert len(found) == 6
    for i, j in ((0, 1), (0, 2), (1, 2)):
        x, y = z[batch == i], z[batch == j]
        want = mean(x, x) + mean(y, y) - 2 * mean(x, y)
        assert found[(f"b{i}", f"b{j}")] == pytest.approx(want)
        assert vectors.mmd_l1(rows.where(F.col("batch") == f"b{i}"), rows.where(F.col("batch") == f"b{j}")).first().mmd == pytest.approx(want)
    assert {tuple(sorted(x)) for x in found} == {("b0", "b1"), ("b0", "b2"), ("b1", "b2"), ("alone", "b0"), ("alone", "b1"), ("alone", "b2")}
    assert vectors.mmd_l1(rows.limit(0), rows.where("batch = 'b0'")).first().mmd is None
    small = vectors.mmd_between_batches(rows, most=5)
    assert small.count() == 6


def test_columns_by_names_and_values(spark):
    rows = [(i, f"s{i % 50}", f"s{i % 51}", i % 500, i % 501, i, 1.0 if i % 2 else float("nan"), "x", [i], None if i % 3 else "a") for i in range(2000)]
    names = "id long, sample string, section_51 string, cluster int, leiden int, batch_id int, region double, niche string, label array<int>, donor string"
    df = spark.createDataFrame(rows, names)
    assert columns.column_roles(df) == {"sample": "batch", "cluster": "label"}
    assert columns.column_roles(df, ["leiden"]) == {"sample": "batch", "leiden": "label"}
    assert columns.column_roles(df.limit(0)) == {} and columns.column_roles(df.select("id")) == {}


def test_kernel_means_over_stacks_send_a_row_to_few_tasks(spark, monkeypatch):
    """Small tiles and stacks give what brute force gives, and tiles are copied once for each stack, not for each tile."""
    monkeypatch.setattr(vectors, "TILE_ROWS", 8)
    monkeypatch.setattr(vectors, "STACK_TILES", 5)
    monkeypatch.setattr(vectors, "STACKS", 3)
    x = np.random.default_rng(8).normal(size=(203, 5))
    rows = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "batch int, vector array<double>").repartition(4)
    kernel = np.exp(-(np.abs(x[:, None] - x[None]).sum(2) ** 2) / (2 * 2.5**2))
    found = {(r.a, r.b): r.m for r in vectors._kernel_means(rows, 2.5).collect()}
    assert set(found) == {(a, b) for a in range(3) for b in range(a, 3)}
    for (a, b), m in found.items():
        assert m == pytest.approx(kernel[a::3, b::3].mean(), abs=1e-12)
    assert "collect_set" not in vectors._kernel_means(rows, 2.5)._jdf.queryExecution().toString()


def test_kernel_sums_in_single_precision_are_those_of_double(monkeypatch):
    """Far pairs need no double precision; near ones, copies, far-off and large vectors keep it."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 64)) / 8
    y = np.concatenate([x[:40] + 0.01, rng.normal(size=(280, 64)) / 8])
    plain = vectors._plain_kernel_sum
    called = []
    monkeypatch.setattr(vectors, "_plain_kernel_sum", lambda *z: called.append(1) or plain(*z))
    for move, scale, sigma in ((0.0, 1.0, 1.0), (0.0, 1.0, 5.0), (1e4, 1.0, 1.0), (0.0, 1e3, 1.0), (0.0, 1e40, 1.0), (0.0, 1e-30, 1.0)):
        a, b = x * scale + move, y * scale + move
        want = np.exp(-(np.abs(a[:, None] - b[None]).sum(2) ** 2) / (2 * sigma**2)).mean()
        called.clear()
        assert vectors._l1_kernel_sum(a, b, sigma) / (len(a) * len(b)) == pytest.approx(want, abs=1e-13, rel=1e-12)
        assert bool(called) == (sigma > 1 or scale in (1e40, 1e-30))
    assert np.isnan(vectors._l1_kernel_sum(np.full((2, 3), np.nan), np.ones((2, 3)), 1.0))
