"""Queries of neighbourhood joins and of what is gathered over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import position_encoding
from ..operators import spatial, vectors
from .common import CELLS, FEATURES, cells, features, knn_sql
from .registry import query, table

K = 8
REGIONS = {0: (0.10, 0.35, 0.30, 0.80), 1: (0.55, 0.80, 0.20, 0.65)}
_SPLIT = """box AS (SELECT section_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY 1),
split AS (SELECT cells.*, CASE
  WHEN cells.section_id = 0 AND x BETWEEN x0 + (x1 - x0) * 0.10 AND x0 + (x1 - x0) * 0.35 AND y BETWEEN y0 + (y1 - y0) * 0.30 AND y0 + (y1 - y0) * 0.80 THEN 'test'
  WHEN cells.section_id = 1 AND x BETWEEN x0 + (x1 - x0) * 0.55 AND x0 + (x1 - x0) * 0.80 AND y BETWEEN y0 + (y1 - y0) * 0.20 AND y0 + (y1 - y0) * 0.65 THEN 'test'
  ELSE 'train' END AS data_split FROM cells JOIN box USING (section_id))"""


def _edges(spark, d, k=K):
    c = cells(spark, d)
    return spatial.knn_join(c, c, k)


def _train_edges(spark, d):
    split = spatial.holdout_split(cells(spark, d), REGIONS)
    return split, spatial.knn_join(split, split.where("data_split = 'train'"), K)


_TRAIN_KNN = f"WITH {CELLS}, {_SPLIT}, train AS (SELECT * FROM split WHERE data_split = 'train'), {knn_sql(K, source='split', target='train')}, {FEATURES}"


@query(f"WITH {CELLS}, {knn_sql(K)} SELECT section_id, src, dst, round(d2, 6) AS d2, rank FROM knn")
def knn_edges(spark, d):
    return _edges(spark, d).select("section_id", "src", "dst", F.round("d2", 6).alias("d2"), F.col("rank").cast("long").alias("rank"))


@query(f"{_TRAIN_KNN} SELECT src, dst, rank FROM knn")
def knn_train(spark, d):
    return _train_edges(spark, d)[1].select("src", "dst", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CELLS}, {_SPLIT} SELECT id, section_id, data_split FROM split")
def holdout_split(spark, d):
    return spatial.holdout_split(cells(spark, d), REGIONS).select("id", "section_id", "data_split")


@query(
    f"WITH {CELLS} SELECT q.id, count(t.id) AS degree FROM cells q LEFT JOIN cells t ON q.section_id = t.section_id AND q.id <> t.id "
    "AND (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) <= 0.04 * 0.04 GROUP BY 1"
)
def radius_degree(spark, d):
    c = cells(spark, d)
    return spatial.degrees(spatial.radius_join(c, 0.04), c).select("id", F.col("degree").cast("long").alias("degree"))


@query(f"WITH {CELLS}, {knn_sql(K)}, n AS (SELECT src, dst FROM knn UNION ALL SELECT id, id FROM cells) SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM n GROUP BY 1) GROUP BY 1")
def degree_histogram(spark, d):
    c = cells(spark, d)
    loops = spatial.with_self_loops(_edges(spark, d), c)
    return spatial.degrees(loops, c).groupBy("degree").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, {knn_sql(K)}, {FEATURES} SELECT src AS id, feature, round(avg(value), 6) AS value FROM knn JOIN feats ON feats.id = dst GROUP BY 1, 2")
def neighbor_mean(spark, d):
    out = spatial.neighbour_aggregate(_edges(spark, d), features(cells(spark, d)).withColumnRenamed("feature", "gene_id"))
    return out.select("id", F.col("gene_id").alias("feature"), F.round("value", 6).alias("value"))


@query(f"WITH {CELLS}, {knn_sql(K)}, {FEATURES} SELECT dst AS id, feature, round(sum(value), 6) AS value FROM knn JOIN feats ON feats.id = src GROUP BY 1, 2")
def neighbor_sum_t(spark, d):
    out = spatial.neighbour_aggregate(_edges(spark, d), features(cells(spark, d)).withColumnRenamed("feature", "gene_id"), "sum", transposed=True)
    return out.select("id", F.col("gene_id").alias("feature"), F.round("value", 6).alias("value"))


def _regress_sql(weight: str, extra: str = "") -> str:
    return f"{_TRAIN_KNN}{extra} SELECT src AS id, feature, round(sum(({weight}) * value) / sum({weight}), 6) AS predicted FROM knn JOIN feats ON feats.id = dst GROUP BY 1, 2"


def _regress(weighting):
    def run(spark, d):
        split, edges = _train_edges(spark, d)
        return spatial.knn_regress(edges, features(split), weighting).select("id", "feature", F.round("predicted", 6).alias("predicted"))

    return run


query(_regress_sql("1.0"), "knn_regress_uniform")(_regress("uniform"))
query(_regress_sql("1.0 / (sqrt(d2) + 1e-8)"), "knn_regress_distance")(_regress("distance"))
query(_regress_sql("exp(-d2 / (2.0 * (SELECT median(sqrt(d2)) FROM knn) * (SELECT median(sqrt(d2)) FROM knn)))"), "knn_regress_gaussian")(_regress("gaussian"))


@query(
    f"{_TRAIN_KNN}, depth AS (SELECT id, abs(sum(value)) AS depth FROM feats JOIN split USING (id) WHERE data_split = 'train' GROUP BY 1) "
    "SELECT split.id, round(coalesce(avg(depth), (SELECT avg(depth) FROM depth)), 6) AS depth FROM split LEFT JOIN knn ON src = split.id LEFT JOIN depth ON depth.id = dst GROUP BY 1"
)
def read_depth(spark, d):
    split, edges = _train_edges(spark, d)
    train = split.where("data_split = 'train'")
    depth = features(train).groupBy("id").agg(F.abs(F.sum("value")).alias("depth"))
    return spatial.read_depth(edges, depth, split).select("id", F.round("depth", 6).alias("depth"))


@query(f"WITH {CELLS}, {knn_sql(15)}, n AS (SELECT src AS id, label AS code, count(*) AS n FROM knn JOIN cells ON cells.id = dst GROUP BY 1, 2) SELECT id, code, round(n / sum(n) OVER (PARTITION BY id), 6) AS share FROM n")
def code_composition(spark, d):
    c = cells(spark, d)
    return spatial.code_composition(spatial.knn_join(c, c, 15), c.select("id", F.col("label").alias("code"))).select("id", "code", F.round("share", 6).alias("share"))


@query(f"WITH {CELLS}, {knn_sql(K)} SELECT DISTINCT q.id FROM cells q JOIN knn ON src = q.id JOIN cells t ON t.id = dst WHERE t.label = 3 AND q.label <> 3")
def has_neighbor(spark, d):
    return spatial.near_kind(_edges(spark, d), cells(spark, d).select("id", F.col("label").cast("string").alias("kind")), "3")


@query(f"""WITH {CELLS}, {knn_sql(K)}, {FEATURES}, h1 AS (SELECT src AS id, feature, avg(value) AS value FROM knn JOIN feats ON feats.id = dst GROUP BY 1, 2),
h2 AS (SELECT src AS id, feature, avg(value) AS value FROM knn JOIN h1 ON h1.id = dst GROUP BY 1, 2)
SELECT id, 0 AS hop, feature, round(value, 6) AS value FROM feats UNION ALL SELECT id, 1, feature, round(value, 6) FROM h1 UNION ALL SELECT id, 2, feature, round(value, 6) FROM h2""")
def hop_means(spark, d):
    return spatial.hop_means(_edges(spark, d), features(cells(spark, d)), 2).select("id", "hop", "feature", F.round("value", 6).alias("value"))


@query(f"""WITH {CELLS}, {knn_sql(K)}, {FEATURES}, z AS (SELECT id, feature, value - avg(value) OVER (PARTITION BY feature) AS z FROM feats),
own AS (SELECT feature, count(*) AS n, sum(z * z) AS ss FROM z GROUP BY 1),
across AS (SELECT a.feature, count(*) AS w, sum(a.z * b.z) AS s FROM knn JOIN z a ON a.id = src JOIN z b ON b.id = dst AND a.feature = b.feature GROUP BY 1)
SELECT feature, round(n * s / (w * ss), 6) AS moran FROM own JOIN across USING (feature)""")
def morans_i(spark, d):
    return spatial.morans_i(_edges(spark, d), features(cells(spark, d))).select("feature", F.round("moran", 6).alias("moran"))


@query(f"""WITH {CELLS}, {_SPLIT}, m AS (SELECT section_id, avg(x) FILTER (data_split = 'train') AS mx, stddev_pop(x) FILTER (data_split = 'train') AS sx, avg(y) FILTER (data_split = 'train') AS my, stddev_pop(y) FILTER (data_split = 'train') AS sy FROM split GROUP BY 1)
SELECT id, round((x - mx) / sx, 6) AS zx, round((y - my) / sy, 6) AS zy FROM split JOIN m USING (section_id)""")
def zscore_train(spark, d):
    out = spatial.zscore_by_train(spatial.holdout_split(cells(spark, d), REGIONS))
    return out.select("id", F.round("zx", 6).alias("zx"), F.round("zy", 6).alias("zy"))


@query(f"""WITH {CELLS}, c AS (SELECT id, section_id, x - avg(x) OVER (PARTITION BY section_id) AS x, y - avg(y) OVER (PARTITION BY section_id) AS y FROM cells),
r AS (SELECT id, section_id, x * cos(radians(30)) - y * sin(radians(30)) AS rx, x * sin(radians(30)) + y * cos(radians(30)) AS ry FROM c),
g AS (SELECT section_id, sqrt(pow(max(rx) - min(rx), 2) + pow(max(ry) - min(ry), 2)) AS diag FROM r GROUP BY 1)
SELECT id, round(rx / diag, 6) AS rx, round(ry / diag, 6) AS ry FROM r JOIN g USING (section_id)""")
def rotate_unit(spark, d):
    return spatial.rotate_unit(cells(spark, d), 30.0).select("id", F.round("rx", 6).alias("rx"), F.round("ry", 6).alias("ry"))


@query(f"""WITH {CELLS}, {knn_sql(1)}, s AS (SELECT section_id, median(sqrt(d2)) AS m FROM knn GROUP BY 1)
SELECT id, round((x - avg(x) OVER (PARTITION BY section_id)) / m, 6) AS x, round((y - avg(y) OVER (PARTITION BY section_id)) / m, 6) AS y FROM cells JOIN s USING (section_id)""")
def spacing_normalised(spark, d):
    c = cells(spark, d)
    out = spatial.normalise_by_spacing(c, spatial.knn_join(c, c, 1))
    return out.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""SELECT vec_id AS id, round(sin(x), 6) AS s0, round(sin(x * pow(10000, -0.25)), 6) AS s1, round(cos(x * pow(10000, -0.75)), 6) AS c3, round(cos(y), 6) AS cy
FROM (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y FROM embeddings)""")
def pos_encoding(spark, d):
    code = position_encoding(F.col("x") * 10, F.col("y") * 10, 16)
    c = cells(spark, d).select("id", code.alias("c"))
    return c.select("id", F.round(F.col("c")[0], 6).alias("s0"), F.round(F.col("c")[1], 6).alias("s1"), F.round(F.col("c")[7], 6).alias("c3"), F.round(F.col("c")[12], 6).alias("cy"))


# vectors: queries are the rows whose id is divisible by 20, against all rows

_VEC = """vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, (vec_id % 3)::INT AS batch FROM embeddings),
vknn AS (SELECT * FROM (SELECT q.id AS src, t.id AS dst, d2, row_number() OVER (PARTITION BY q.id ORDER BY (q.id <> t.id), d2, t.id) AS rank
  FROM (SELECT q.id AS qid, t.id AS tid, list_sum(list_transform(list_zip(q.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2 FROM vec q, vec t WHERE q.id % 20 = 0) p JOIN vec q ON q.id = qid JOIN vec t ON t.id = tid) WHERE rank <= 15)"""


def _vknn(spark, d, k=15):
    c = cells(spark, d)
    return c, vectors.vector_knn(c, c.where("id % 20 = 0"), k, ties="id")


@query(f"WITH {_VEC} SELECT src, rank, round(CASE WHEN src = dst THEN 0 ELSE d2 END, 6) AS d2 FROM vknn")
def vec_knn(spark, d):
    return _vknn(spark, d)[1].select("src", F.col("rank").cast("long").alias("rank"), F.round("d2", 6).alias("d2"))


@query(f"WITH {_VEC}, n AS (SELECT src, batch, count(*) AS n FROM vknn JOIN vec ON vec.id = dst GROUP BY 1, 2), p AS (SELECT src, n / sum(n) OVER (PARTITION BY src) AS p FROM n) SELECT src AS id, round(1 / sum(p * p), 6) AS simpson FROM p GROUP BY 1")
def inv_simpson(spark, d):
    c, edges = _vknn(spark, d)
    return vectors.inverse_simpson(edges, c.select("id", F.col("section_id").alias("batch"))).select("id", F.round("simpson", 6).alias("simpson"))


@query()
def ilisi(spark, d):
    """Of every vector, not of the searches' queries only."""
    c = cells(spark, d)
    edges = vectors.vector_knn(c, c, 15, ties="id")
    return vectors.ilisi(edges, c.select("id", F.col("section_id").alias("batch")), 15)


@query("SELECT count(*) AS n, count(DISTINCT v) AS n_distinct, max(c) AS largest, round(avg(CASE WHEN c > 1 THEN 1.0 ELSE 0 END), 6) AS tied_share, round(avg(CASE WHEN c > 2 THEN 1.0 ELSE 0 END), 6) AS beyond_k_share FROM (SELECT c_mktsegment || c_nationkey AS v, count(*) OVER (PARTITION BY c_mktsegment || c_nationkey) AS c FROM customer)")
def tie_stats(spark, d):
    out = vectors.tie_statistics(table(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("vector")), 2)
    return out.select("n", "n_distinct", "largest", F.round("tied_share", 6).alias("tied_share"), F.round("beyond_k_share", 6).alias("beyond_k_share"))


@query(f"WITH {_VEC}, n AS (SELECT src, label, count(*) AS n FROM vknn JOIN vec ON vec.id = dst WHERE src <> dst GROUP BY 1, 2) SELECT src AS id, arg_max(label, (n * 1000 - label)) AS label FROM n GROUP BY 1")
def knn_classify(spark, d):
    c, edges = _vknn(spark, d)
    return vectors.knn_vote(edges, c.select("id", "label"))


_CENTRES = "c AS (SELECT label, feature, avg(value) AS m FROM (SELECT label, unnest(range(1, 65)) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings) GROUP BY 1, 2), v AS (SELECT vec_id AS id, unnest(range(1, 65)) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query(f"WITH {_CENTRES}, d AS (SELECT id, label, sum((value - m) * (value - m)) AS d2 FROM v JOIN c USING (feature) GROUP BY 1, 2) SELECT id, label, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, label) AS r FROM d) WHERE r = 1")
def nearest_centroid(spark, d):
    c = cells(spark, d)
    return vectors.nearest_centroid(c, vectors.centroids(c, "label", 64), "label").select("id", "label", F.round("d2", 6).alias("d2"))


@query("""WITH s AS (SELECT vec_id AS id, label < 5 AS a, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT x.a AS xa, y.a AS ya, x.v AS v, y.v AS w FROM s x, s y WHERE x.a >= y.a),
m AS (SELECT xa, ya, avg(exp(-pow(list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))), 2) / 2)) AS m FROM k GROUP BY 1, 2)
SELECT round(sum(CASE WHEN xa <> ya THEN -2 * m ELSE m END), 9) AS mmd FROM m""")
def mmd_l1(spark, d):
    c = cells(spark, d)
    return vectors.mmd_l1(c.where("label < 5"), c.where("label >= 5")).select(F.round("mmd", 9).alias("mmd"))


@query("""WITH s AS (SELECT vec_id % 3 = 0 AS a, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 < 2),
k AS (SELECT x.a AS xa, y.a AS ya, x.v AS v, y.v AS w FROM s x, s y WHERE x.a >= y.a),
m AS (SELECT xa, ya, avg(exp(-pow(list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))), 2) / 2)) AS m FROM k GROUP BY 1, 2)
SELECT round(sum(CASE WHEN xa <> ya THEN -2 * m ELSE m END), 9) AS mmd FROM m""")
def mmd_l1_sections(spark, d):
    c = cells(spark, d)
    return vectors.mmd_l1(c.where("section_id = 0"), c.where("section_id = 1")).select(F.round("mmd", 9).alias("mmd"))


@query("""WITH e AS (SELECT vec_id, unnest(range(1, 33)) AS i, unnest(embedding[1:32])::DOUBLE AS x, unnest(embedding[33:64])::DOUBLE AS y FROM embeddings),
c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x, y - avg(y) OVER (PARTITION BY i) AS y FROM e),
g AS (SELECT a.i, b.i AS j, sum(a.x * b.y) AS xy, sum(a.x * b.x) AS xx, sum(a.y * b.y) AS yy FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2)
SELECT round(sum(xy * xy) / sqrt(sum(xx * xx) * sum(yy * yy)), 6) AS cka FROM g""")
def linear_cka(spark, d):
    c = cells(spark, d).select(F.slice("vector", 1, 32).alias("a"), F.slice("vector", 33, 32).alias("b"))
    return vectors.linear_cka(c, "a", "b", 32, 32).select(F.round("cka", 6).alias("cka"))
