"""Components of sparse values against a dense decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from lattica.operators import sparse_pca


@pytest.mark.parametrize("most,rounds,apart", [(10.0, sparse_pca.ROUNDS, 0.05), (1.5, 25, 1e-3), (None, 25, 1e-3)])
def test_components_equal_the_dense_ones(spark, monkeypatch, most, rounds, apart):
    """The fourth and the fifteenth singular value, on which the passes' gain rests, are less than 1.5 times apart here."""
    monkeypatch.setattr(sparse_pca, "BLOCK", 300)
    rng = np.random.default_rng(1)
    x = rng.poisson(np.exp(rng.normal(size=(160, 4)) @ rng.normal(size=(4, 30)) * 0.5)) * (rng.random((160, 30)) < 0.4) * 1.0
    x[17], x[:, 29] = 0, 0
    x[:, 28] = 2.0  # flat
    rows = [(c, f"g{g:02}", float(x[c, g]), 1) for c in range(160) for g in range(30) if x[c, g]]
    expr = spark.createDataFrame([*rows, (0, "g00", None, 1), (0, "g01", float("nan"), 1), (777, "g02", 50.0, 1)], "cell_id long, gene_id string, value double, pc int").repartition(4)
    cells = spark.createDataFrame([(c,) for c in range(160)], "cell_id long")
    out = {r.cell_id: r.pc for r in sparse_pca.sparse_components(expr, cells, 4, most=most, rounds=rounds).collect()}
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    z = z if most is None else np.clip(z, -most, most)
    z = z - z.mean(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([out[c] for c in range(160)])
    # the largest angle between the two spaces, and each component's scores
    angle = np.arccos(np.clip(np.linalg.svd(np.linalg.qr(got)[0].T @ u[:, :4], compute_uv=False), -1, 1)).max()
    assert len(out) == 160 and angle < apart
    for j in range(4):
        assert abs(abs(got[:, j] @ u[:, j]) / s[j] - 1) < apart
    assert (got.T @ got)[~np.eye(4, dtype=bool)] == pytest.approx(0, abs=0.5 if apart > 0.01 else 1e-2)


def test_components_without_genes_or_cells(spark):
    expr = spark.createDataFrame([], "cell_id long, gene_id long, value double")
    cells = spark.createDataFrame([(1,), (1,), (2,)], "cell_id long")
    assert sorted((r.cell_id, r.pc) for r in sparse_pca.sparse_components(expr, cells, 3).collect()) == [(1, []), (2, [])]
    assert sparse_pca.sparse_components(expr, cells.limit(0), 3).count() == 0
    one = spark.createDataFrame([(1, 5, 2.0)], "cell_id long, gene_id long, value double")
    found = {r.cell_id: r.pc for r in sparse_pca.sparse_components(one, cells, 3).collect()}
    assert len(found[1]) == 1 and found[1][0] == pytest.approx(-found[2][0])
