"""Splits, codes, reports, couplings, rank tests and guarded scans against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import codes, coupling, harmonise, panel, ranges, reports, spatial, splits, stats, vectors
from lattica.sources import guards


def test_knn_keeps_sections_apart_when_ids_repeat(spark):
    rng = random.Random(1)
    rows = [(s, i, rng.random(), rng.random()) for s in (1, 2) for i in range(5)]
    p = spark.createDataFrame(rows, "section_id int, id long, x double, y double")
    found = spatial.knn_join(p, p, 2).collect()
    for s, i, x, y in rows:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for t, j, a, b in rows if t == s and j != i)[:2]
        assert [r.dst for r in sorted(found, key=lambda r: r.rank) if (r.section_id, r.src) == (s, i)] == [j for _, j in near]


def test_knn_of_a_clump_with_outliers(spark):
    rng = random.Random(2)
    rows = [(0, i, rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for i in range(3000)] + [(0, 9000 + i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(40)]
    p = spark.createDataFrame(rows, "section_id int, id long, x double, y double")
    xy, ids = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    got = {}
    for r in spatial.knn_join(p, p, 4).collect():
        got.setdefault(r.src, []).append((r.d2, r.dst))
    for k in [*range(0, 3000, 97), *range(3000, 3040)]:
        d = ((xy - xy[k]) ** 2).sum(1)
        d[k] = np.inf
        assert [j for _, j in sorted(got[ids[k]])] == ids[np.lexsort((ids, d))[:4]].tolist()


def test_running_totals_and_numbers(spark):
    rng = random.Random(3)
    values = rng.sample(range(10_000), 700)
    df = spark.createDataFrame([(v, v % 7) for v in values], "k long, w long").repartition(5)
    got = {r.k: r.t for r in ranges.running_totals(df, [F.desc("k")], {"t": F.col("w")}).collect()}
    total = 0
    for v in sorted(values, reverse=True):
        total += v % 7
        assert got[v] == total
    assert [r._n for r in ranges.numbered(df, "k").orderBy("k").collect()] == list(range(700))
    assert ranges.numbered(df.where("false"), "k").count() == 0


def test_average_ranks_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0), (4, 5.0)], "id long, v double")
    assert {r.id: r.r for r in panel.average_ranks(df, [], "v", "r").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: 4.0}


def test_mask_is_exact_at_any_share(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    for share in (0.0, 0.013, 0.5, 1.0):
        assert splits.scattered_mask(df, "k", share, 5).where("masked").count() == int(share * 500)
    assert splits.scattered_mask(df.where("false"), "k", 0.5).count() == 0


def test_nan_policy_and_reference_errors(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [3.0, 4.0]), (3, [5.0, None])], "id long, v array<double>")
    with pytest.raises(ValueError, match="2 of 3"):
        splits.nan_policy(df, "v")
    filled = {r.id: r.v for r in splits.nan_policy(df, "v", 1.0, fill=True).collect()}
    assert filled == {1: [1.0, 4.0], 2: [3.0, 4.0], 3: [5.0, 4.0]}
    e = spark.createDataFrame([(1, 7, 2.0)], "cell_id long, gene_id long, value double")
    with pytest.raises(ValueError, match="no gene"):
        splits.aligned_to_reference(e, spark.createDataFrame([(0, 8)], "place int, gene_id long"))


def test_replacement_takes_whole_donors(spark):
    e = spark.createDataFrame([(c, g, float(10 * c + g)) for c in range(8) for g in range(3)], "cell_id long, gene_id long, value double")
    groups = spark.createDataFrame([(c, "m" if c < 3 else "p" if c < 6 else "r") for c in range(8)], "cell_id long, label string")
    rows = splits.perturbed(e, groups, "m", "p", "replacement").collect()
    for c in range(3):
        own = sorted((r.gene_id, r.value) for r in rows if r.cell_id == c)
        assert own in [[(g, 10.0 * d + g) for g in range(3)] for d in (3, 4, 5)]
    assert len(rows) == 24


def test_selectors_and_code_readers(spark):
    with pytest.raises(ValueError, match="unknown selector"):
        splits.select_metric(None, None, "other|x")
    df = spark.createDataFrame([(1, [1, 2], 5), (2, [3, 4], 6)], "id long, codes array<int>, n int")
    with pytest.raises(KeyError):
        codes.code_stack(df, "id", ["absent"], ["n"])
    stack = codes.code_stack(df, "id", ["absent", "codes"], ["n"])
    assert {r["name"]: r["size"] for r in codes.code_sizes(stack).collect()} == {"cell.L0": 4, "cell.L1": 5, "niche.L0": 7}
    assert codes.labels_present(df.withColumn("l", F.lit("nan")).withColumn("m", F.lit("x")), ["l", "none", "m", "n"], True) == ["m", "n"]
    assert reports.cluster_column(["a", "novae_domains_7", "novae_domains_12"]) == "novae_domains_12"
    assert reports.cluster_column(["leiden", "novae_domains_7"]) == "leiden" and reports.cluster_column(["a"]) is None


def exact_u(a, b):
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    values, n = sorted([*a, *b]), len(a)
    all_u = [sum(x > y for x in (values[i] for i in c) for y in (values[i] for i in range(len(values)) if i not in c)) for c in itertools.combinations(range(len(values)), n)]
    return min(1.0, 2 * min(sum(v <= u for v in all_u), sum(v >= u for v in all_u)) / len(all_u))


def test_rank_tests_against_all_orders(spark):
    rng = random.Random(6)
    a, b = [rng.random() for _ in range(5)], [rng.random() + 0.3 for _ in range(5)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(a)] + [("b", k, v) for k, v in enumerate(b)], "g string, seed int, v double")
    assert stats.mann_whitney_p(stats.mann_whitney(df, [], "g", "a", "b", "v")).first().p == pytest.approx(exact_u(a, b))
    d = sorted((abs(x - y), x > y) for x, y in zip(a, b, strict=True))
    w = sum(k + 1 for k, (_, up) in enumerate(d) if up)
    sums = [sum(s) for s in itertools.product(*((0, k + 1) for k in range(5)))]
    p = min(1.0, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))
    assert stats.wilcoxon(df, [], "seed", "g", "a", "b", "v").first().p == pytest.approx(p)
    tied = df.withColumn("v", F.round("v", 1))
    assert 0 < stats.mann_whitney_p(stats.mann_whitney(tied, [], "g", "a", "b", "v")).first().p <= 1


def test_couplings_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4))
    y = np.hstack([x[:, :2] @ rng.normal(size=(2, 2)) + 0.1 * rng.normal(size=(120, 2)), rng.normal(size=(120, 1))])
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), "ab"[int(x[i, 0] > 0)]) for i in range(120)], "id long, x array<double>, y array<double>, label string").repartition(3)
    cx, cy = x - x.mean(0), y - y.mean(0)
    linear = (np.linalg.norm(cx.T @ cy) ** 2) / (np.linalg.norm(cx.T @ cx) * np.linalg.norm(cy.T @ cy))
    assert vectors.linear_cka(df, "x", "y", 4, 3).first().cka == pytest.approx(linear)
    whole = np.linalg.svd(np.linalg.svd(cx, full_matrices=False)[0].T @ np.linalg.svd(cy, full_matrices=False)[0], compute_uv=False)
    assert coupling.canonical_correlation(df, "x", "y", 2) == pytest.approx(np.clip(whole[:2], 0, 1).mean())

    def gram(z):
        d = ((z[:, None] - z[None]) ** 2).sum(2)
        return np.exp(-d / np.median(d[d > 0]))

    h = np.eye(120) - 1 / 120
    k, m = h @ gram(x) @ h, h @ gram(y) @ h
    assert coupling.rbf_cka(df, "x", "y", n_sub=500).first().cka == pytest.approx((k * m).sum() / math.sqrt((k * k).sum() * (m * m).sum()))
    assert coupling.neighbour_classifier(df, "x", "label", k=7).first().balanced_accuracy > 0.7
    assert coupling.neighbour_classifier(df.limit(20), "x", "label").count() == 0
    assert math.isnan(coupling.canonical_correlation(df.where("false"), "x", "y"))


def test_classifier_learns_from_and_tries_all_rows(spark):
    """More rows than the sample of 8,000 it once took: the figures are those of brute force over all of them, a rare class included."""
    n, k = 8600, 5
    x = np.round(np.random.default_rng(9).normal(size=(n, 3)), 6)
    label = np.where(np.arange(n) % 1720 == 3, "rare", np.where(x[:, 0] > 0, "a", "b"))
    df = spark.createDataFrame([(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id long, x array<double>, label string").repartition(3)
    found = coupling.neighbour_classifier(df, "x", "label", k=k).first()
    half = np.array([int(hashlib.md5(f"1:{i}".encode()).hexdigest()[:8], 16) % 2 for i in range(n)])
    z = (x - x[half == 0].mean(0)) / (x[half == 0].std(0) + 1e-8)
    train, right = np.flatnonzero(half == 0), {}
    for i in np.flatnonzero(half == 1):
        near = label[train[np.argsort(((z[train] - z[i]) ** 2).sum(1), kind="stable")[:k]]].tolist()
        right.setdefault(label[i], []).append(min(sorted(set(near)), key=lambda c: -near.count(c)) == label[i])
    assert found.n_classes == len(right) and found.balanced_accuracy == pytest.approx(np.mean([np.mean(r) for r in right.values()]))


def test_mixing_is_that_of_every_vector(spark, tmp_path):
    """Vectors whose id 20 divides lie among all three batches, the others among their own: the indexes and their median are those of all."""
    from lattica import plans

    rng = np.random.default_rng(6)
    at = np.arange(600)
    v = rng.normal(size=(600, 64)) / 100
    v[:, 0] += np.where(at % 20 == 0, 50, at % 3 * 10)
    spark.createDataFrame([(int(i), x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.id: r.ilisi for r in plans.QUERIES["ilisi"](spark, str(tmp_path)).collect()}
    assert sorted(found) == at.tolist() and all(found[i] == pytest.approx(1.0) for i in at[at % 20 > 0])
    assert np.mean([found[i] for i in at[::20]]) > 1.5
    assert plans.QUERIES["ilisi_scaled"](spark, str(tmp_path)).first().scaled == 0.0


def test_tied_batches_mix_fully_and_apart_not_at_all(spark):
    tied = spark.createDataFrame([(i, [0.0, 0.0], "l", i % 2) for i in range(120)], "id long, vector array<double>, label string, batch int")
    far = tied.withColumn("vector", F.array(F.col("batch") * 100.0 + F.col("id") * 1e-3, F.lit(0.0)))
    assert coupling.label_mixing(tied, tied, k=30).first().score > 0.8
    assert coupling.label_mixing(far, far, k=30).first().score < 0.05
    s = coupling.label_mixing_summary(coupling.label_mixing(far, far, k=30)).first()
    assert s.n_labels == 1 and s.plain == s.cell_weighted


def test_fill_goes_from_the_edge_inwards(spark):
    known = spark.createDataFrame([(0, i, float(i), 0.0, 1.0) for i in range(5)], "section_id int, id long, x double, y double, value double")
    holes = spark.createDataFrame([(0, 10 + i, 5.0 + i, 0.0) for i in range(6)], "section_id int, id long, x double, y double")
    rows = {r.id: (r.step, r.value) for r in spatial.fill_from_boundary(known, holes, 2, 3, "linear").collect()}
    assert {i: s for i, (s, _) in rows.items()} == {10: 1, 11: 1, 12: 2, 13: 2, 14: 3, 15: 3}
    assert all(v == 1.0 for _, v in rows.values())


def test_annotation_and_gene_map(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    note = spark.createDataFrame([(1, "x", "kept out")], "id long, note string, v string")
    assert sorted(map(tuple, harmonise.annotated(rows, note, "id").collect())) == [(1, "a", "x"), (2, "b", None)]
    with pytest.raises(ValueError, match="more than once"):
        harmonise.annotated(rows, note.union(note), "id")


def test_guarded_scans(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [3.0, 4.0], "b")], "id long, v array<double>, batch string").write.parquet(good)
    spark.createDataFrame([(1, [1.0, float("inf")], "a"), (2, [3.0, 4.0], None)], "id long, v array<double>, batch string").write.parquet(bad)
    assert guards.scan_columns(spark, good, ["v"]).columns == ["v"]
    with pytest.raises(KeyError, match="nope"):
        guards.scan_columns(spark, good, ["nope"])
    assert guards.scan_embedding(spark, good, "v", "batch", 2).count() == 2
    with pytest.raises(ValueError, match="1 vectors"):
        guards.scan_embedding(spark, bad, "v", "batch")
    with pytest.raises(ValueError, match="2 batches"):
        guards.scan_embedding(spark, good, "v", "batch", 3)
    with pytest.raises(TypeError):
        guards.scan_embedding(spark, good, "id", "batch")
    assert guards.probe(spark, good, {"v": "array"}) is None
    assert "absent" in guards.probe(spark, good, {"w": "array"}) and guards.probe(spark, str(tmp_path / "none"), {})
    assert list(guards.listed_sections(spark, {"good": good}, ("v",))) == ["good"] and not guards.listed_sections(spark, {"good": good})


def test_moves_of_tables(spark, tmp_path):
    df = spark.createDataFrame([(3, 1), (5, 2), (7, 3)], "section_id int, id int").withColumn("id", F.col("id").cast("string"))
    assert sorted(map(tuple, guards.restamped(df, [7, 3]).collect())) == [(0, "s0_3"), (1, "s1_1")]
    root = str(tmp_path / "t")
    guards.supersede(df, root, 1)
    guards.supersede(df.limit(1), root, 2)
    assert guards.current(spark, root).count() == 1 and spark.read.parquet(f"{root}/v=000001").count() == 3
    out = guards.collated([df, df.withColumnRenamed("id", "cell").withColumn("extra", F.lit(1))], {"cell": "id"})
    assert out.count() == 6 and out.where("extra IS NULL").count() == 3
    kept, manifest = guards.gene_set(spark.createDataFrame([(1, "g", 2.0), (1, "h", 3.0)], "cell_id long, gene_id string, value double"), ["g", "z"])
    assert kept.count() == 1 and json.loads(manifest) == {"genes": ["g"], "absent": ["z"], "n_rows": 1, "n_cells": 1}
    cells = {(r.row, r.column): r.value for r in guards.printed_table(spark, "ari nmi\na 0.5 -\n\nb 1 2").collect()}
    assert cells == {("a", "ari"): 0.5, ("a", "nmi"): None, ("b", "ari"): 1.0, ("b", "nmi"): 2.0}
    with pytest.raises(Exception, match="another length"):
        guards.printed_table(spark, "ari nmi\na 0.5").collect()
    assert guards.scoring_seed(spark.createDataFrame([(4,), (2,)], "seed int")) == (2, "2 seeds; the lowest is taken")
    guards.split_by_sample(df.select(F.col("id").alias("batch"), F.lit("t").alias("cell_type")), "batch", {"1": 0, "3": 1}, {"cell_type": "label"}, str(tmp_path / "s"))
    assert {(r.section_id, r.label) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(0, "t"), (1, "t")}
    typed = guards.sanitised(df, spark.createDataFrame([], "id long, note string").schema)
    assert dict(typed.dtypes) == {"id": "bigint", "note": "string"}
    runs = spark.createDataFrame([(1, "r1", "ok"), (2, "", "failed")], "seed int, run_dir string, status string")
    stamps = spark.createDataFrame([(2, "t2"), (3, "t3")], "seed int, run string")
    assert {r.seed: (r.run, r.status) for r in guards.seed_index(runs, stamps).collect()} == {1: ("r1", "ok"), 2: ("t2", "failed"), 3: ("t3", "unlisted")}


def test_agreement_of_large_clusters(spark):
    from lattica.operators import agreement

    table = spark.createDataFrame([("a", "a", 40_000_000), ("a", "b", 10_000_000), ("b", "a", 10_000_000), ("b", "b", 40_000_000)], "x string, y string, n long")
    assert agreement.adjusted_mutual_information(table).first().ami == pytest.approx(agreement.partition_scores(table).first().nmi, abs=1e-4)


def test_index_holds_every_row_and_finds_most_neighbours(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 3
    x = centres[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    queries = df.where("id % 20 = 0")
    got, want = ({(r.src, r.dst) for r in edges.collect()} for edges in (vectors.approximate_knn(df, queries, 10, cells=16, probes=6), vectors.vector_knn(df, queries, 10)))
    assert len(got & want) / len(want) >= 0.9
    whole = {(r.src, r.dst) for r in vectors.approximate_knn(df, queries, 10, cells=4, probes=4).collect()}
    assert whole == want


def test_run_is_recomputed_against_every_label(spark):
    df = spark.createDataFrame([(i % 2, "ab"[i % 2], "x" if i < 5 else None, "nan") for i in range(10)], "leiden int, l1 string, l2 string, l3 string")
    rows = {r.label_key: r for r in reports.recomputed_run(df, ["l3", "l1", "l2", "l4"], 0).collect()}
    assert set(rows) == {"l1", "l2"} and rows["l1"].nmi == pytest.approx(1.0) and rows["l1"].code_key == "leiden"
    with pytest.raises(KeyError):
        reports.recomputed_run(df.drop("leiden"), ["l1"], 0)


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from lattica.session import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_components_and_vocabulary_against_numpy(spark):
    from lattica.operators import embedding

    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [float("nan")] * 5)]
    found = {r.id: r.pc for r in embedding.principal_components(spark.createDataFrame(rows, "id long, vector array<double>"), 2).collect()}
    assert found.pop(900) is None
    _, _, vt = np.linalg.svd(x - x.mean(0))
    for k in range(2):
        own, want = np.array([found[i][k] for i in range(80)]), x @ vt[k]
        assert np.allclose(own, want, atol=1e-6) or np.allclose(own, -want, atol=1e-6)
    clumps = spark.createDataFrame([(i, [float(i % 3 * 100), float(i % 7) * 0.01]) for i in range(90)], "id long, vector array<double>")
    book = embedding.vocabulary(clumps, "vector", 3)
    tokens = {r.id: r.token for r in vectors.nearest_centroid(clumps, book, "token").collect()}
    assert len(set(tokens.values())) == 3 and all(tokens[i] == tokens[i % 3] for i in range(90))


def test_usage_summary_stars_and_balanced_accuracy(spark):
    from lattica.functions import stars
    from lattica.operators import agreement

    usage = spark.createDataFrame([("a", 8, s, 0.2 + s / 10, 0.5, 0.1 * s) for s in range(3)], "level string, codebook_size int, seed int, active_fraction double, normalized_perplexity double, max_code_share double")
    row = agreement.usage_summary(usage, "level").first().asDict()
    assert [v for k, v in row.items() if k.startswith("active_fraction")] == pytest.approx([0.3, 0.1])
    marks = spark.createDataFrame([(p,) for p in (0.0005, 0.005, 0.03, 0.2)], "p double").select(stars(F.col("p")).alias("m"))
    assert [r.m for r in marks.collect()] == ["***", "**", "*", "ns"]
    truth = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id long, label string")
    guess = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b")], "id long, label string")
    assert vectors.balanced_accuracy(guess, truth).first().balanced_accuracy == pytest.approx((2 / 3 + 1) / 2)
