"""Operators on fixtures that are checked by hand or with NumPy."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import agreement, harmonise, panel, spatial, stats, tables, vectors
from lattica.schema import conform, require_columns, resolve_column


def points(spark, rows):
    return spark.createDataFrame(rows, "section_id int, id long, x double, y double")


def brute(rows, k):
    out = {}
    for s, i, x, y in rows:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for t, j, a, b in rows if t == s and j != i)
        out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("shape", ["uniform", "clumps", "line", "one place"])
def test_knn_join_is_exact(spark, shape):
    rng = random.Random(len(shape))
    make = {
        "uniform": lambda: (rng.random(), rng.random()),
        "clumps": lambda: (rng.choice([0, 0, 0, 50]) + rng.gauss(0, 0.01), rng.choice([0, 9]) + rng.gauss(0, 0.01)),
        "line": lambda: (rng.random(), 0.0),
        "one place": lambda: (1.0, 1.0),
    }[shape]
    rows = [(i % 2, i, *map(float, make())) for i in range(160)] + [(5, 900, 0.0, 0.0), (5, 901, 1.0, 0.0)]
    p = points(spark, rows)
    found = spatial.knn_join(p, p, 6).collect()
    got = {i: [] for _, i, *_ in rows}
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r.src].append(r.dst)
    assert got == brute(rows, 6)


def test_grid9_radius_and_degrees(spark):
    rows = [(s, 9 * s + 3 * a + b, float(a), float(b)) for s in range(2) for a in range(3) for b in range(3)]
    p = points(spark, rows)
    degree = {r.id: r.degree for r in spatial.degrees(spatial.radius_join(p, 1.0), p).collect()}
    assert [degree[k] for k in range(9)] == [2, 3, 2, 3, 4, 3, 2, 3, 2] and degree[13] == 4
    edges = spatial.radius_join(p, 1.0, self_loop=True)
    assert edges.where("src = dst").count() == 18 and edges.where("abs(src - dst) > 8").count() == 0


def test_line5_split_regression(spark):
    p = points(spark, [(0, i, float(i), 0.0) for i in range(1, 6)]).withColumn("data_split", F.when(F.col("id") >= 4, "test").otherwise("train"))
    edges = spatial.knn_join(p, p.where("data_split = 'train'"), 5)
    assert {r.src: r.n for r in edges.groupBy("src").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 2, 3: 2, 4: 3, 5: 3}
    values = p.select("id", F.lit("v").alias("feature"), (F.col("id") * 1.0).alias("value"))
    mean = {r.id: r.predicted for r in spatial.knn_regress(edges, values).collect()}
    assert mean[4] == pytest.approx(2.0)
    near = {r.id: r.predicted for r in spatial.knn_regress(edges, values, "distance").collect()}
    assert near[4] == pytest.approx((3 / 1 + 2 / 2 + 1 / 3) / (1 + 1 / 2 + 1 / 3), abs=1e-6)
    with pytest.raises(ValueError):
        spatial.knn_regress(edges, values, "other")


def test_contingency_scores(spark):
    df = spark.createDataFrame([("a", "x", "p")] * 4 + [("b", "y", "p")] * 4 + [(None, "x", "p")], "l string, m string, one string")
    s = agreement.partition_scores(agreement.contingency(df, F.col("l"), F.col("m"))).first()
    assert (s.nmi, s.ari, s.n_cells) == (pytest.approx(1.0), pytest.approx(1.0), 8)
    s = agreement.partition_scores(agreement.contingency(df, F.col("l"), F.col("one"))).first()
    assert (s.nmi, s.ari) == (0.0, 0.0)
    s = agreement.partition_scores(agreement.contingency(df, F.col("one"), F.col("one"))).first()
    assert (s.nmi, s.ari) == (1.0, 1.0)
    ami = agreement.adjusted_mutual_information(agreement.contingency(df, F.col("l"), F.col("m"))).first().ami
    assert ami == pytest.approx(1.0)


def test_dead_codes(spark):
    df = spark.createDataFrame([(c,) for c in [0, 0, 0, 0, 0, 1, 1, 1, 2, 2]], "code int")
    u = agreement.code_usage(df, F.col("code"), 4).first()
    p = np.array([0.5, 0.3, 0.2])
    assert (u.n_used, u.n_dead, u.codebook_size, u.max_code_share) == (3, 1, 4, 0.5)
    assert u.entropy_bits == pytest.approx(-(p * np.log2(p)).sum()) and u.perplexity == pytest.approx(math.exp(-(p * np.log(p)).sum()))


def test_jsd_of_disjoint_and_equal_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "g int, c string")
    sim = {(r.source, r.target): r.similarity for r in agreement.jsd_similarity(agreement.distributions(df, "g", "c"), "g", "c").collect()}
    assert sim[1, 2] == pytest.approx(1.0) and sim[1, 3] == pytest.approx(0.0) and len(sim) == 9


def test_correlation_with_zeros_left_out_and_flat_rows(spark):
    rng = np.random.default_rng(1)
    t, p = rng.poisson(1.0, (4, 30)).astype(float), rng.poisson(1.0, (4, 30)).astype(float)
    t[3] = 2.0
    rows = [(i, j, float(t[i, j]), float(p[i, j])) for i in range(4) for j in range(30) if t[i, j] or p[i, j]]
    found = {r.row: r.pearson for r in panel.pearson(spark.createDataFrame(rows, "row int, col int, target double, predicted double"), ["row"], F.lit(30)).collect()}
    assert found[3] is None
    for i in range(3):
        assert found[i] == pytest.approx(np.corrcoef(t[i], p[i])[0, 1])


def test_ranking_figures(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1), (1, float("nan"))], "y int, s double")
    assert panel.auroc(df, F.col("y"), "s").first().auroc == pytest.approx(0.625)
    assert panel.average_precision(df, F.col("y"), "s").first().average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert panel.auroc(df.where("y = 1"), F.col("y"), "s").first().auroc is None


def test_student_distribution():
    assert stats.student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert stats.student_two_sided(1.0, 1) == pytest.approx(0.5)
    assert stats.student_quantile(1) == pytest.approx(12.7062047, abs=1e-6) and stats.student_quantile(10) == pytest.approx(2.2281389, abs=1e-6)


def test_seeds5_tests_and_corrections(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 5), rng.normal(1, 2, 5)
    rows = [("ref", i, float(v)) for i, v in enumerate(a)] + [("new", i, float(v)) for i, v in enumerate(b)] + [("flat", i, 1.0) for i in range(5)] + [("one", 0, 2.0), ("new", 9, float("nan"))]
    df = spark.createDataFrame(rows, "m string, seed int, v double")
    found = {r.m: r for r in stats.welch_p(stats.welch(df, "m", "ref", [], "v")).collect()}
    va, vb = b.var(ddof=1) / len(b), a.var(ddof=1) / len(a)
    t, dof = (b.mean() - a.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(b) - 1) + vb**2 / (len(a) - 1))
    assert found["new"].t == pytest.approx(t) and found["new"].dof == pytest.approx(dof)
    assert found["one"].t is None and found["one"].p is None
    flat = stats.welch_p(stats.welch(df.where("m = 'flat'").union(df.where("m = 'flat'").withColumn("m", F.lit("ref"))), "m", "ref", [], "v")).first()
    assert flat.degenerate and flat.p == 1.0
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    assert {r.k: r.p_holm for r in stats.holm(p, "p", order="k").collect()} == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06), "d": None}
    u = stats.mann_whitney(df.where("v = v"), [], "m", "ref", "new", "v").first()
    assert u.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    d = stats.paired(df.withColumn("g", F.lit(1)), ["g"], "seed", "m", "ref", "new", "v").first()
    assert d.t == pytest.approx((a - b).mean() / ((a - b).std(ddof=1) / math.sqrt(5)))


def test_duplicate_and_preference_rules(spark):
    df = spark.createDataFrame([("a", "code_level_0", 1, 1.0), ("a", "code", 2, 2.0), ("b", "leiden", 1, 3.0), ("b", "zz", 2, 3.0)], "v string, k string, seed int, x double")
    assert {r.v: r.k for r in tables.preferred(df, ["v"], "k", ["code_level*", "leiden"]).collect()} == {"a": "code_level_0", "b": "leiden"}
    assert tables.duplicate_seeds(df, ["v"], "seed", "x").first().v == "b"
    assert tables.splice(df, df.withColumn("x", F.lit(9.0)), "seed", 1).where("x = 9.0").count() == 2
    s = {r.v: r for r in tables.summary_long(df.where("v = 'b' OR seed = 1"), ["v"], "x").collect()}
    assert (s["a"].sd, s["a"].ci95, s["b"].sd) == (0.0, 0.0, 0.0)


def test_labels_filters_and_schema(spark):
    df = spark.createDataFrame([(" t-cells ",), ("Promo X",), ("fibro",), (None,)], "l string")
    label = harmonise.canonical_label(F.col("l"), {"tcells": "T cell"}, [("promo", "P")])
    assert [r[0] for r in df.select(label).collect()] == ["T cell", "P", "Fibro", None]
    with pytest.raises(Exception, match="aren't whole"):
        harmonise.whole_counts(spark.createDataFrame([(1.5,)], "v double"), "v").collect()
    assert resolve_column(df, ["x", "l"]) == "l" and resolve_column(df, ["x"], required=False) is None
    with pytest.raises(KeyError):
        require_columns(df, ["nope"])
    assert conform(df, spark.createDataFrame([], "l string, n int").schema).dtypes == [("l", "string"), ("n", "int")]


def test_vector_ties_do_not_follow_order(spark):
    rows = [(i, [float(i // 30), 0.0], i % 30 // 15) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, batch int")
    edges = vectors.vector_knn(v, v.where("id % 20 = 0"), 15)
    first = edges.where("rank = 1").collect()
    assert all(r.src == r.dst for r in first)
    mean = vectors.inverse_simpson(edges, v.select("id", "batch")).agg(F.avg("simpson")).first()[0]
    assert mean > 1.7  # neighbours are drawn from both batches, though batches are stored apart
    assert 1.0 <= vectors.ilisi(edges, v.select("id", "batch"), 15).agg(F.avg("ilisi")).first()[0] <= 2.0


def test_mmd_of_whole_sections_equals_brute_force(spark, tmp_path):
    import numpy as np
    from lattica import plans

    v = np.random.default_rng(4).normal(size=(75, 64)) / 40
    v[1::3] += 0.01
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    kernel = lambda x, y: np.exp(-(np.abs(x[:, None] - y[None]).sum(2) ** 2) / 2).mean()
    a, b = v[0::3], v[1::3]
    want = kernel(a, a) + kernel(b, b) - 2 * kernel(a, b)
    assert abs(plans.QUERIES["mmd_l1_sections"](spark, str(tmp_path)).first().mmd - want) < 2e-9


def test_intervals_of_more_than_31_values_and_many_centres(spark):
    from pyspark.sql import functions as F
    from lattica.operators import stats, vectors

    df = spark.createDataFrame([(n,) for n in (1, 7, 31, 40, 101)], "n long")
    found = {r.n: r.t for r in df.select("n", stats.half_width(F.sqrt("n"), F.col("n")).alias("t")).collect()}
    want = {1: 0.0, 7: 2.446911851, 31: 2.042272456, 40: 2.022690920, 101: 1.983971519}
    assert all(abs(found[n] - t) < 1e-6 for n, t in want.items())
    centres = spark.range(100_500).select(F.col("id").alias("label"), F.array(F.col("id").cast("double")).alias("centroid"))
    points = spark.createDataFrame([(k, [float(k)]) for k in (0, 50_000, 100_499)], "id long, vector array<double>")
    assert {r.id: (r.label, r.d2) for r in vectors.nearest_centroid(points, centres, "label").collect()} == {k: (k, 0.0) for k in (0, 50_000, 100_499)}


def test_neighbours_over_many_tiles_are_those_of_brute_force(spark, monkeypatch):
    """Tiles of a few rows, copies, a row that isn't finite and far-off ones; no join makes a row for each pair or holds a block of queries in a row."""
    import numpy as np

    for name, small in (("TILE_VECTORS", 64), ("TILE_QUERIES", 16), ("BLOCK_QUERIES", 5), ("PART_VECTORS", 20)):
        monkeypatch.setattr(vectors, name, small)
    x = np.random.default_rng(3).normal(size=(300, 6)) + 1e6
    x[100:140], x[7] = x[100], np.inf
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, batch int").repartition(5)
    for by in (None, "batch"):
        edges = vectors.vector_knn(df, df.where("id % 5 = 0"), 9, by=by, ties="id")
        found = {(r.src, r["rank"]): r.dst for r in edges.collect()}
        want = {}
        for i in range(0, 300, 5):
            with np.errstate(all="ignore"):
                d = [sum((a - b) ** 2 for a, b in zip(x[i], y, strict=True)) for y in x]
            near = sorted((j for j in range(300) if by is None or j % 2 == i % 2), key=lambda j: (j != i, d[j] != d[j], d[j], j))[:9]
            want |= {(i, rank): j for rank, j in enumerate(near, 1)}
        assert found == want
    hashed = vectors.vector_knn(df.where("id BETWEEN 100 AND 139"), df.where("id IN (100, 120)"), 9).collect()
    assert len({tuple(sorted(r.dst for r in hashed if r.src == q and r["rank"] > 1)) for q in (100, 120)}) == 2
    assert "collect_list" not in edges._jdf.queryExecution().toString() and vectors.vector_knn(df.limit(0), df, 3).count() == 0


def test_a_tile_of_copies_takes_bounded_memory():
    """Where all vectors of a tile are copies, every pair is near; pairs are still compared some at a time."""
    import tracemalloc

    import numpy as np

    n, queries = 60_000, 64
    w, ids, keys = np.ones((n, 2)), np.arange(n), np.zeros(n, np.uint64)
    tracemalloc.start()
    found = [(i, j, d2) for i, j, d2, _ in vectors._nearest_of_tile(w[:queries], w, ids[:queries], ids, keys[:queries], keys, 3)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    i, j, d2 = (np.concatenate(x) for x in zip(*found, strict=True))
    assert [sorted(j[i == q].tolist()) for q in range(queries)] == [sorted([q, *[x for x in range(3) if x != q][:2]]) for q in range(queries)] and d2[0] == -1
    assert peak < 150e6


def test_tiles_of_wide_vectors_hold_no_more_components(spark, monkeypatch):
    """Fewer wide vectors meet in a task, and the neighbours are those of brute force."""
    import numpy as np

    n, width, most, kept, seen = 1100, 8192, 1 << 22, vectors.checkpointed, []
    monkeypatch.setattr(vectors, "checkpointed", lambda df: seen.append(kept(df)) or seen[-1])
    value = lambda j: ((F.col("id") * 7919 + j * 104_729 + F.col("id") * j * j) % 1009).cast("double")
    df = spark.range(n).select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), value).alias("vector"))
    edges = vectors.vector_knn(df, df.where("id % 100 = 0"), 4, ties="id")
    assert width * n / seen[0].first()["_rows"] <= most
    i, j = np.arange(n)[:, None], np.arange(width)[None]
    x = ((i * 7919 + j * 104_729 + i * j * j) % 1009).astype(float)
    want = {}
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(1)
        want |= {(q, rank): (o, d[o]) for rank, o in enumerate(sorted(range(n), key=lambda o: (o != q, d[o], o))[:4], 1)}
    assert {(r.src, r["rank"]): (r.dst, r.d2) for r in edges.collect()} == want


def test_tiles_of_vectors_have_tasks_of_their_own(spark, monkeypatch):
    """However few partitions a shuffle has, many tiles don't meet in one task; where tiles are small, a task gets several."""
    for name, small in (("TILE_VECTORS", 64), ("TILE_QUERIES", 16), ("PART_VECTORS", 20)):
        monkeypatch.setattr(vectors, name, small)
    kept, plans = vectors.checkpointed, []
    monkeypatch.setattr(vectors, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or kept(df))
    df = spark.range(300).select("id", F.array((F.col("id") * 37 % 101).cast("double")).alias("vector"), (F.col("id") % 100).alias("g"))
    for by, tasks in ((None, 96), ("g", 12)):
        plans.clear()
        edges = vectors.vector_knn(df, df.where("id % 5 = 0"), 2, by=by, ties="id")
        assert set(re.findall(r"hashpartitioning\([^()]*_r#[^()]*, (\d+)\)", plans[-1])) == {str(tasks)}
        assert edges.count() == 120 and edges.where("rank = 1 AND src = dst").count() == 60


def test_queries_in_holes_and_far_out_meet_few_targets(spark):
    """Neighbours across a wide hole, around a clump and from far outside equal brute force, and a query in the hole is held against few of all targets."""
    import numpy as np
    from lattica.operators import spatial

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.uniform(size=(3000, 2)), np.full((40, 2), 0.9), [[30.0, -20.0], [0.5, 0.5]]])
    hole = (np.abs(x - 0.5) < 0.3).all(1)
    hole[-2:] = True
    points = spark.createDataFrame([(0, i, *map(float, p), bool(h)) for i, (p, h) in enumerate(zip(x, hole, strict=True))], "section_id int, id long, x double, y double, hole boolean").repartition(3)
    few = spark.createDataFrame([(1, i, float(i), 0.0, False) for i in range(4)], points.schema)
    every = points.unionByName(few)
    targets = every.where("NOT hole")
    found = {}
    for r in spatial.knn_join(every, targets, 6).collect():
        found.setdefault((r.section_id, r.src), []).append((r["rank"], r.dst))
    aims = np.flatnonzero(~hole)
    for i, p in enumerate(x):
        d = ((p - x[aims]) ** 2)
        order = [j for _, j in sorted(zip((d[:, 0] + d[:, 1]).tolist(), aims.tolist(), strict=True)) if j != i][:6]
        assert [j for _, j in sorted(found[0, i])] == order
    assert all(len(found[1, i]) == 3 for i in range(4))
    hashed = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    many = spark.range(60_000).select(F.lit(0).alias("section_id"), "id", hashed(1).alias("x"), hashed(2).alias("y")).where("abs(x - 0.5) >= 0.3 OR abs(y - 0.5) >= 0.3")
    grid = spatial.section_grid(many, 6, 2.0)
    cells = spatial._in_cells(many, grid, 1.0).groupBy("section_id", "gx", "gy").agg(F.count("*").alias("n"))
    middle = many.limit(1).select("section_id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    met = spatial._near_cells(middle, cells, grid, 1.0, 3, 6).join(cells, ["section_id", "gx", "gy"]).agg(F.sum("n")).first()[0]
    assert 6 < met < many.count() / 8


def test_regression_in_a_hole_spreads_over_tasks_and_its_width_is_no_buffer(spark, monkeypatch):
    """A point in a hole meets the cells within its own reach, dealt by cell over all tasks of a shuffle; the Gaussian width is an exact median from merged sketches."""
    import numpy as np
    from lattica.operators import spatial
    from lattica.operators.quantiles import medians

    x = np.random.default_rng(8).uniform(size=(4000, 2))
    hole = (np.abs(x - 0.5) < 0.3).all(1)
    points = spark.createDataFrame([(0, i, *map(float, p), bool(h)) for i, (p, h) in enumerate(zip(x, hole, strict=True))], "section_id int, id long, x double, y double, hole boolean")
    targets, left = points.where("NOT hole"), points.where("hole").select("section_id", F.col("id").alias("src"), "x", "y")
    grid = spatial.section_grid(targets, 4, 2.0)
    cells = spatial._in_cells(targets, grid, 1.0).groupBy("section_id", "gx", "gy").agg(F.count("*").alias("n"))
    own = spatial._cells_of_points(left, cells, grid, 1.0, 2, 4)
    assert own.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = spatial._near_cells(left, cells, grid, 1.0, 2, 4).withColumnsRenamed({"gx": "tx", "gy": "ty"})
    by_cell = spatial._in_cells(left, grid, 1.0).join(near, (F.col("gx") == F.col("qx")) & (F.col("gy") == F.col("qy")))
    assert 2 * own.count() < by_cell.count()

    taken = []
    monkeypatch.setattr(spatial, "medians", lambda *a: taken.append(medians(*a)) or taken[-1])
    values = targets.select("id", F.lit(0).alias("feature"), F.col("x").alias("value"))
    found = {r.id: r.predicted for r in spatial.knn_regress(spatial.knn_join(points, targets, 4), values, "gaussian").collect()}
    aims = np.flatnonzero(~hole)
    d2 = ((x[:, None] - x[aims][None]) ** 2).sum(2)
    d2[aims, np.arange(len(aims))] = np.inf
    best = np.argsort(d2, 1)[:, :4]
    d2 = np.take_along_axis(d2, best, 1)
    w = np.exp(-d2 / (2 * np.median(np.sqrt(d2)) ** 2))
    want = (w * x[aims][best, 0]).sum(1) / w.sum(1)
    assert len(taken) == 1 and all(abs(found[i] - want[i]) < 1e-9 or w[i].sum() < 1e-300 for i in range(len(x)))
