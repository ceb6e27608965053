"""Queries of splits, masks, selectors, codes, and of how two spaces go together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codes as C
from ..operators import coupling as K
from ..operators import embedding as E
from ..operators import harmonise as H
from ..operators import spatial, vectors
from ..operators import splits as S
from .common import CELLS, EXPR, cells, expr, features
from .registry import query, table

_REGIONS = {0: {"x_min_pct": 0.25, "x_max_pct": 0.75, "y_min": 0.0}, 1: {"x_min": -0.05, "x_min_pct": 0.9, "y_max_pct": 0.5}}
_BOXES = f"""{CELLS}, b AS (SELECT section_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY 1),
boxes AS (SELECT 0 AS section_id, x0 + (x1 - x0) * 0.25::DOUBLE AS x_min, x0 + (x1 - x0) * 0.75::DOUBLE AS x_max, 0.0::DOUBLE AS y_min, y1 AS y_max FROM b WHERE section_id = 0
UNION ALL SELECT 1, -0.05::DOUBLE, x1, y0, y0 + (y1 - y0) * 0.5::DOUBLE FROM b WHERE section_id = 1)"""


@query(f"WITH {_BOXES} SELECT section_id, round(x_min, 9) AS x_min, round(x_max, 9) AS x_max, round(y_min, 9) AS y_min, round(y_max, 9) AS y_max FROM boxes")
def region_boxes(spark, d):
    return S.region_boxes(cells(spark, d), _REGIONS).select("section_id", *(F.round(c, 9).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")))


@query(f"WITH {_BOXES} SELECT id, coalesce(x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max, false) AS held_out FROM cells LEFT JOIN boxes USING (section_id)")
def boxed_holdout(spark, d):
    c = cells(spark, d)
    return S.in_boxes(c, S.region_boxes(c, _REGIONS)).select("id", "held_out")


@query(f"""WITH {CELLS}, b AS (SELECT section_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY 1)
SELECT id, CASE WHEN x <= x0 + (x1 - x0) * 0.6::DOUBLE THEN 'train' WHEN y < y0 + (y1 - y0) * 0.5::DOUBLE THEN 'test' ELSE 'val' END AS data_split FROM cells JOIN b USING (section_id)""")
def regional_split(spark, d):
    return S.regional_split(cells(spark, d)).select("id", "data_split")


@query("""WITH h AS (SELECT event_id, ('0x' || substr(md5('3:' || event_id), 1, 12))::BIGINT AS h FROM events)
SELECT event_id, row_number() OVER (ORDER BY h, event_id) <= floor(0.05 * (SELECT count(*) FROM events)) AS masked FROM h""")
def scattered_mask(spark, d):
    return S.scattered_mask(table(spark, d, "events"), "event_id", 0.05, 3).select("event_id", "masked")


@query(f"WITH {CELLS} SELECT id, coalesce(x > -0.1 AND x < 0.1 AND y > -0.1 AND y < 0.1 AND label = 3, false) AS roi FROM cells")
def roi_mask(spark, d):
    return cells(spark, d).select("id", S.roi_mask(None, (-0.1, 0.1, -0.1, 0.1), "label", 3).alias("roi"))


@query(f"WITH {EXPR} SELECT cell_id, gene_id, value FROM expr WHERE gene_id % 3 = 0 AND value <> 0")
def vocabulary_filter(spark, d):
    return S.in_vocabulary(expr(spark, d), spark.range(0, 60, 3).withColumnRenamed("id", "gene_id"))


@query(f"""WITH {EXPR}, r AS (SELECT i AS place, 60 - i * 3 AS gene_id FROM range(20) AS t(i)), c AS (SELECT DISTINCT cell_id FROM expr)
SELECT c.cell_id, r.place, r.gene_id, coalesce(expr.value, 0) AS value FROM c CROSS JOIN r LEFT JOIN expr ON expr.cell_id = c.cell_id AND expr.gene_id = r.gene_id""")
def aligned_genes(spark, d):
    reference = spark.range(20).select(F.col("id").alias("place"), (60 - F.col("id") * 3).alias("gene_id"))
    return S.aligned_to_reference(expr(spark, d), reference)


@query("""WITH v AS (SELECT vec_id AS id, unnest(range(0, 64))::INT AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), n AS (SELECT id, k, CASE WHEN id % 100 = 7 AND k = 2 THEN NULL ELSE x END AS x FROM v)
SELECT id, round(coalesce(x, avg(x) OVER (PARTITION BY k)), 6) AS x FROM n WHERE k = 2""")
def nan_filled(spark, d):
    c = cells(spark, d).select("id", F.transform("vector", lambda v, k: F.when((F.col("id") % 100 == 7) & (k == 2), F.lit(float("nan"))).otherwise(v)).alias("vector"))
    # its table has k = 2 missing in each hundredth row
    return S.nan_policy(c, "vector", 0.02, fill=True).select("id", F.round(F.col("vector")[2], 6).alias("x"))


@query("SELECT l_suppkey, bool_and(l_quantity >= 0 AND l_quantity = round(l_quantity)) AS quantity, bool_and(l_tax >= 0 AND abs(l_tax - round(l_tax)) <= 1e-6) AS tax FROM lineitem GROUP BY 1")
def count_detector(spark, d):
    rows = table(spark, d, "lineitem")
    a = S.looks_like_counts(rows, "l_quantity", ["l_suppkey"]).withColumnRenamed("counts", "quantity")
    return a.join(S.looks_like_counts(rows, "l_tax", ["l_suppkey"]).withColumnRenamed("counts", "tax"), "l_suppkey")


@query("SELECT p_partkey, p_type AS variant FROM part WHERE (p_type GLOB 'S*' OR p_type GLOB '?CON*') AND NOT p_type GLOB '*ARD'")
def variant_globs(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("variant"))
    return S.variants_like(p, "variant", ["S*", "?CON*"], ["*ARD"])


@query("SELECT view, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT 'all' AS view, event_id FROM events UNION ALL SELECT event_type, event_id FROM events WHERE event_type IN ('view', 'error')) GROUP BY 1")
def split_views(spark, d):
    e = S.split_views(table(spark, d, "events"), "event_type", ["all", "view", "error"])
    return e.groupBy("view").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_GROUPS = "g AS (SELECT DISTINCT l_suppkey AS cell_id, CASE l_suppkey % 4 WHEN 0 THEN 'masked' WHEN 1 THEN 'pool' ELSE 'rest' END AS label FROM lineitem)"


def _groups(spark, d):
    return expr(spark, d).select("cell_id", F.when(F.col("cell_id") % 4 == 0, "masked").when(F.col("cell_id") % 4 == 1, "pool").otherwise("rest").alias("label")).distinct()


@query(f"""WITH {EXPR}, {_GROUPS}, pool AS (SELECT gene_id, sum(value) / (SELECT count(*) FROM g WHERE label = 'pool') AS value FROM expr JOIN g USING (cell_id) WHERE label = 'pool' GROUP BY 1)
SELECT cell_id, gene_id, round(value, 6) AS value FROM expr JOIN g USING (cell_id) WHERE label <> 'masked' UNION ALL SELECT cell_id, gene_id, round(value, 6) FROM g, pool WHERE label = 'masked'""")
def perturbed_mean(spark, d):
    return S.perturbed(expr(spark, d), _groups(spark, d), "masked", "pool").select("cell_id", "gene_id", F.round("value", 6).alias("value"))


@query(f"""WITH {EXPR}, {_GROUPS}, genes AS (SELECT DISTINCT gene_id FROM expr), dense AS (SELECT gene_id, coalesce(value, 0) AS value FROM genes CROSS JOIN (SELECT cell_id FROM g WHERE label = 'pool') LEFT JOIN expr USING (cell_id, gene_id)),
pool AS (SELECT gene_id, median(value) AS value FROM dense GROUP BY 1)
SELECT cell_id, gene_id, round(value, 6) AS value FROM expr JOIN g USING (cell_id) WHERE label <> 'masked' UNION ALL SELECT cell_id, gene_id, round(value, 6) FROM g, pool WHERE label = 'masked' AND value <> 0""")
def perturbed_median(spark, d):
    return S.perturbed(expr(spark, d), _groups(spark, d), "masked", "pool", "median").select("cell_id", "gene_id", F.round("value", 6).alias("value"))


def _long(spark, d):
    rows = table(spark, d, "lineitem")
    niche = rows.groupBy(F.col("l_shipdate").cast("date").cast("string").substr(1, 4).alias("variant"), F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("code_key"), F.lit("lab").alias("label_key")).agg(F.round(F.avg("l_tax"), 9).alias("NMI"))
    batchint = rows.groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("emb_key"), F.lit("iLISI").alias("metric")).agg(F.round(F.avg("l_discount"), 9).alias("score"))
    return niche, batchint


@query("""SELECT strftime(l_shipdate, '%Y') AS variant, round(avg(l_tax), 9) AS value, 'niche' AS kind FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1
UNION ALL SELECT l_returnflag, round(avg(l_discount), 9), 'batchint' FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def selected_metrics(spark, d):
    niche, batchint = _long(spark, d)
    a = S.select_metric(niche, batchint, "niche|R|F|lab|NMI").withColumn("kind", F.lit("niche"))
    return a.unionByName(S.select_metric(niche, batchint, "batchint|O|iLISI").withColumn("kind", F.lit("batchint")))


# ---- codes and labels


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 <> 0 THEN p_brand END, CASE WHEN p_size % 2 = 0 THEN p_type END, p_name) AS label FROM part")
def merged_labels(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", C.first_valid(F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).otherwise("nan"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""), F.col("p_name")).alias("label"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN regexp_extract(c_name, '0([1-9][0-9]*)$', 1) END AS donor FROM customer WHERE c_custkey % 2 = 0 AND regexp_matches(c_name, '0([1-9][0-9]*)$') UNION ALL SELECT c_custkey, c_name FROM customer WHERE NOT (c_custkey % 2 = 0 AND regexp_matches(c_name, '0([1-9][0-9]*)$'))")
def donors(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, C.donor_of(F.col("c_name"), "0([1-9][0-9]*)$")).otherwise(F.col("c_name")).alias("donor"))


_STACK = "s AS (SELECT p_partkey AS id, p_size % 5 AS c0, (p_partkey % 7)::INT AS c1 FROM part)"


def _stack(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array((F.col("p_size") % 5).cast("int"), (F.col("p_partkey") % 7).cast("int")).alias("codes"))


@query(f"WITH {_STACK} SELECT id, 'level_0' AS view, c0::BIGINT AS code FROM s UNION ALL SELECT id, 'composite', dense_rank() OVER (ORDER BY c0, c1) - 1 FROM s")
def code_views(spark, d):
    return C.code_views(_stack(spark, d), "id", "codes", 2)


@query(f"WITH {_STACK} SELECT id, (c0 * (max(c1) OVER () + 1) + c1)::BIGINT AS composite FROM s")
def composite_codes(spark, d):
    s = _stack(spark, d).select("id", F.col("codes")[0].alias("c0"), F.col("codes")[1].alias("c1"))
    return C.composite_code(s, "c0", "c1").select("id", F.col("composite").cast("long").alias("composite"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (c_custkey % 10) / 10.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE END AS beta FROM customer")
def decay_variants(spark, d):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("emadecay-0p"), (F.col("c_custkey") % 10).cast("string"))).when(F.col("c_custkey") % 3 == 1, "reference_run").otherwise("other")
    return table(spark, d, "customer").select("c_custkey", C.decay_of(name, "emadecay", "reference", 0.8).alias("beta"))


@query("SELECT c_custkey, printf('%.3f±%.3f', c_custkey % 1000 / 1000.0, c_custkey % 7 / 100.0) || CASE WHEN c_custkey % 3 = 0 THEN '**' ELSE '' END AS text FROM customer")
def cell_texts(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", C.cell_text(k % 1000 / F.lit(1000.0), k % 7 / F.lit(100.0), F.when(k % 3 == 0, "**").otherwise("ns")).alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' WHEN event_id % 4 = 0 THEN printf('%.2f', event_id % 100 / 8.0) WHEN event_id % 4 = 1 THEN printf('%.0f', (event_id % 90 * 60 + 15) / 60.0) ELSE printf('%.3f', event_id % 64 / 64.0 + 0.0001) END AS text FROM events""")
def display_texts(spark, d):
    k = F.col("event_id")
    metric = F.when(k % 4 == 0, "MMD").when(k % 4 == 1, "RT_s").otherwise("ARI")
    value = F.when(k % 4 == 3, F.lit(float("nan"))).when(k % 4 == 0, k % 100 / F.lit(8000.0)).when(k % 4 == 1, (k % 90 * 60 + 15).cast("double")).otherwise(k % 64 / F.lit(64.0) + F.lit(0.0001))
    return table(spark, d, "events").select("event_id", C.display_text(metric, value).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_size END AS level, p_size || '' AS section, CASE WHEN p_size < 2 THEN p_size * 10 END AS nominal FROM part")
def level_parser(spark, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    level = F.when(k == 0, F.concat(F.lit("L"), size)).when(k == 1, F.concat(F.lit("level_"), size)).when(k == 2, size).otherwise("cells")
    return table(spark, d, "part").select("p_partkey", C.level_number(level).alias("level"), C.section_text(F.col("p_size").cast("double")).alias("section"), C.nominal_size(size, None, {"0": 0, "1": 10}).alias("nominal"))


@query("SELECT p_partkey AS id, 0 AS place, 'cell.L0' AS name, p_size % 5 AS code FROM part UNION ALL SELECT p_partkey, 1, 'cell.L1', p_partkey % 7 FROM part UNION ALL SELECT p_partkey, 2, 'niche.L0', p_size FROM part")
def code_stack(spark, d):
    s = _stack(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("niche_code")), "id")
    return C.code_stack(s, "id", ["cell_codes", "codes"], ["niche_codes", "niche_code"])


@query("""WITH l AS (SELECT 'cell.L0' AS level, (p_size % 5)::VARCHAR AS code FROM part UNION ALL SELECT 'cell.L1', (p_partkey % 7)::VARCHAR FROM part UNION ALL SELECT 'joint', p_size % 5 || '_' || p_partkey % 7 FROM part),
n AS (SELECT level, code, count(*) AS n FROM l GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY level) AS p FROM n)
SELECT level, count(*) AS used, sum(n)::BIGINT AS n, round(exp(-sum(p * ln(p))), 6) AS perplexity, round(max(p), 6) AS top_share FROM p GROUP BY 1""")
def usage_rows(spark, d):
    out = C.usage_rows(C.code_stack(_stack(spark, d).withColumn("niche", F.lit(0)), "id", ["codes"], ["niche"]), ["cell.L0", "cell.L1"])
    return out.select("level", "used", "n", F.round("perplexity", 6).alias("perplexity"), F.round("top_share", 6).alias("top_share"))


# ---- two spaces


@query("""WITH s AS (SELECT vec_id AS id, embedding[1:32]::DOUBLE[] AS x, embedding[33:64]::DOUBLE[] AS y FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT 300),
d AS (SELECT a.id, pow(list_distance(a.x, b.x), 2) AS dx, pow(list_distance(a.y, b.y), 2) AS dy FROM s a, s b),
m AS (SELECT median(CASE WHEN dx > 0 THEN dx END) AS mx, median(CASE WHEN dy > 0 THEN dy END) AS my FROM d),
k AS (SELECT id, exp(-dx / (mx + 1e-12)) AS k, exp(-dy / (my + 1e-12)) AS m FROM d, m),
r AS (SELECT id, sum(k) AS k, sum(m) AS m, sum(k * m) AS km, sum(k * k) AS kk, sum(m * m) AS mm FROM k GROUP BY 1),
h AS (SELECT sum(km) - 2.0 / count(*) * sum(k * m) + sum(k) * sum(m) / (count(*) * count(*)) AS km, sum(kk) - 2.0 / count(*) * sum(k * k) + sum(k) * sum(k) / (count(*) * count(*)) AS kk, sum(mm) - 2.0 / count(*) * sum(m * m) + sum(m) * sum(m) / (count(*) * count(*)) AS mm FROM r)
SELECT round(km / sqrt(kk * mm), 6) AS cka FROM h""")
def rbf_cka(spark, d):
    c = cells(spark, d).select("id", F.slice("vector", 1, 32).alias("x"), F.slice("vector", 33, 32).alias("y"))
    return K.rbf_cka(c, "x", "y", n_sub=300).select(F.round("cka", 6).alias("cka"))


@query()
def canonical_correlation(spark, d):
    c = cells(spark, d).select("id", F.slice("vector", 1, 32).alias("x"), F.slice("vector", 33, 32).alias("y"))
    return spark.createDataFrame([(K.canonical_correlation(c, "x", "y"),)], "mean_correlation double")


@query()
def coupling_bundle(spark, d):
    c = cells(spark, d).select("id", "label", F.slice("vector", 1, 16).alias("x"), F.slice("vector", 33, 16).alias("y"))
    return K.coupling_bundle(c, "x", "y", "label", (16, 16), n_sub=300)


@query("""WITH e AS (SELECT vec_id AS id, label, ('0x' || substr(md5('1:' || vec_id), 1, 8))::BIGINT % 2 AS half, unnest(range(1, 65)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT j, avg(v) AS mu, stddev_pop(v) + 1e-8 AS sd FROM e WHERE half = 0 GROUP BY 1), z AS (SELECT id, any_value(label) AS label, any_value(half) AS half, list((v - mu) / sd ORDER BY j) AS v FROM e JOIN m USING (j) GROUP BY 1),
p AS (SELECT q.id AS src, q.label AS truth, t.label, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, t.v), t.id) AS r FROM z q, z t WHERE q.half = 1 AND t.half = 0),
n AS (SELECT src, truth, label::VARCHAR AS label, count(*) AS n FROM p WHERE r <= 15 GROUP BY 1, 2, 3), w AS (SELECT src, truth, label, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS r FROM n)
SELECT round(avg(recall), 6) AS balanced_accuracy, count(*) AS n_classes FROM (SELECT truth, avg(CASE WHEN label = truth::VARCHAR THEN 1.0 ELSE 0 END) AS recall FROM w WHERE r = 1 GROUP BY 1)""")
def neighbour_classifier(spark, d):
    return K.neighbour_classifier(cells(spark, d), "vector", "label").select(F.round("balanced_accuracy", 6).alias("balanced_accuracy"), "n_classes")


_BISECT = """st(src, d, b, low, high, beta, it) AS (
  SELECT src, d, b, 0.0::DOUBLE, 'inf'::DOUBLE, 1.0::DOUBLE, 0 FROM near
  UNION ALL
  SELECT src, d, b, CASE WHEN h > t THEN beta ELSE low END, CASE WHEN h > t THEN high ELSE beta END,
    CASE WHEN h > t THEN (CASE WHEN isinf(high) THEN beta * 2 ELSE (beta + high) / 2 END) ELSE (low + beta) / 2 END, it + 1
  FROM (SELECT *, ln({perplexity}::DOUBLE) AS t, -list_sum(list_transform(w, lambda x: CASE WHEN x > 0 THEN x / list_sum(w) * ln(x / list_sum(w)) ELSE 0 END)) AS h
        FROM (SELECT *, list_transform(d, lambda x: exp(-x * beta)) AS w FROM st WHERE it < 45))
), last AS (SELECT src, unnest(list_transform(d, lambda x: exp(-x * beta))) AS w, unnest(b) AS b FROM st WHERE it = 45),
shares AS (SELECT src, b, sum(w) AS w FROM last GROUP BY 1, 2), simpson AS (SELECT src, 1 / sum(pow(w / total, 2)) AS s FROM (SELECT *, sum(w) OVER (PARTITION BY src) AS total FROM shares) GROUP BY 1)"""
_NEAR = """WITH RECURSIVE v AS (SELECT vec_id AS id, vec_id % 3 AS batch, label, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT q.id AS src, t.id AS dst, t.batch, q.label, CASE WHEN q.id = t.id THEN 0 ELSE list_distance(q.e, t.e) END AS dist FROM v q JOIN v t ON {on}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM pairs) WHERE r <= {k}),
near AS (SELECT src, list(dist - m ORDER BY dist) AS d, list(batch ORDER BY dist) AS b FROM (SELECT *, min(dist) OVER (PARTITION BY src) AS m FROM best) GROUP BY 1), """


@query((_NEAR + _BISECT).format(on="true", k=15, perplexity=5) + " SELECT round(greatest(0, least(1, (median(s) - 1) / 2.0)), 4)::DOUBLE AS scaled FROM simpson")
def ilisi_scaled(spark, d):
    c = cells(spark, d)
    edges = vectors.vector_knn(c, c, 15, ties="id")
    scores = vectors.ilisi(edges, c.select("id", F.col("section_id").alias("batch")), 15)
    return vectors.scaled_median(scores, "ilisi", 3).select(F.round("scaled", 4).alias("scaled"))


@query((_NEAR + _BISECT).format(on="q.label = t.label WHERE q.id % 20 = 0", k=31, perplexity=10) + ", per AS (SELECT label, count(*) AS n_queries, median(s) AS m FROM simpson JOIN v ON v.id = src GROUP BY 1), n AS (SELECT label, count(*) AS n_cells, count(DISTINCT batch) AS n_batches FROM v GROUP BY 1) SELECT label, n_cells, n_batches, n_queries, round(greatest(0, least(1, (m - 1) / (n_batches - 1.0))), 4)::DOUBLE AS score FROM per JOIN n USING (label)")
def label_mixing(spark, d):
    c = cells(spark, d).withColumn("batch", F.col("section_id"))
    return K.label_mixing(c, c.where("id % 20 = 0"), k=30, ties="id").select("label", "n_cells", "n_batches", "n_queries", F.round("score", 4).alias("score"))


@query(f"""WITH {CELLS}, q AS (SELECT section_id, count(*) FILTER (WHERE id % 4 = 0) AS n FROM cells GROUP BY 1) SELECT section_id, n::BIGINT AS filled FROM q""")
def infill_schedule(spark, d):
    c = cells(spark, d).withColumn("value", F.col("vector")[5])
    out = spatial.fill_from_boundary(c.where("id % 4 <> 0"), c.where("id % 4 = 0").select("section_id", "id", "x", "y"), k=4, steps=3)
    return out.groupBy("section_id").agg(F.count("*").alias("filled"))


# ---- genes, crops, chunks


@query("SELECT p_brand AS name, max(p_partkey) AS gene_id FROM part WHERE p_type IN ('ECONOMY', 'SMALL') GROUP BY 1")
def gene_map(spark, d):
    p = table(spark, d, "part")
    return H.gene_map(p.select(F.col("p_partkey").alias("position"), F.col("p_brand").alias("name"), F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("biotype")), ("ECONOMY", "SMALL"))


@query("SELECT DISTINCT p_brand AS program, p_type AS role, p_size AS gene_id FROM part WHERE p_partkey % 3 < 2")
def program_union(spark, d):
    p = table(spark, d, "part")
    return H.program_union([p.where(F.col("p_partkey") % 3 == k).select(F.col("p_brand").alias("program"), F.col("p_type").alias("role"), F.col("p_size").alias("gene_id")) for k in (0, 1)])


@query(f"""WITH {CELLS}, m AS (SELECT section_id, min(x) AS x0, min(y) AS y0 FROM cells GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY (x - x0) * (x - x0) + (y - y0) * (y - y0), id) AS f FROM cells JOIN m USING (section_id)),
d AS (SELECT *, sqrt(pow(x - max(x) FILTER (f = 1) OVER (PARTITION BY section_id), 2) + pow(y - max(y) FILTER (f = 1) OVER (PARTITION BY section_id), 2)) AS far FROM f),
k AS (SELECT section_id, id, CASE WHEN f = 1 THEN -1 WHEN far > 0 THEN -ln((('0x' || substr(md5('0:' || id), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0::DOUBLE) / far END AS k FROM d)
SELECT id, row_number() OVER (PARTITION BY section_id ORDER BY k NULLS LAST, id) AS place FROM k""")
def diagonal_order(spark, d):
    return E.diagonal_order(cells(spark, d)).select("id", F.col("place").cast("long").alias("place"))


@query("""WITH l AS (SELECT s_suppkey AS id, (s_suppkey % 5 + 1)::INT AS n FROM supplier), r AS (SELECT id, n, unnest(range(n))::INT AS i FROM l), c AS (SELECT id, n, i, unnest(range(i + 1))::INT AS c FROM r)
SELECT id, i AS row, c AS col FROM c UNION ALL SELECT id, n + i, c FROM c UNION ALL SELECT id, n + i, n + c FROM c""")
def attention_pairs(spark, d):
    return E.attention_pairs(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5 + 1).cast("int").alias("n")))


@query("""WITH v AS (SELECT vec_id AS id, unnest(range(0, 4))::INT AS feature, unnest(embedding[9:12])::DOUBLE AS value, ('0x' || substr(md5('3:' || vec_id), 1, 8))::BIGINT % 4 AS chunk FROM embeddings),
p AS (SELECT chunk, feature, sum(value) AS s, count(*) AS n FROM v GROUP BY 1, 2), t AS (SELECT feature, sum(s) AS s, sum(n) AS n FROM p GROUP BY 1)
SELECT id, v.feature, round((t.s - p.s) / (t.n - p.n), 6) AS predicted FROM v JOIN p USING (chunk, feature) JOIN t ON t.feature = v.feature""")
def leave_chunk_out(spark, d):
    c = cells(spark, d)
    return E.leave_chunk_out(features(c), E.chunk_contexts(c, 4, 3)).select("id", "feature", F.round("predicted", 6).alias("predicted"))


@query(f"WITH {EXPR} SELECT cell_id, gene_id, round(CASE WHEN gene_id % 7 = 0 THEN 0 ELSE value END / CASE WHEN floor(gene_id / 4.0 + 0.5) = 0 THEN 1 ELSE floor(gene_id / 4.0 + 0.5) END, 6)::DOUBLE AS value FROM expr")
def technology_scaled(spark, d):
    e = expr(spark, d).withColumn("value", F.when(F.col("gene_id") % 7 == 0, float("nan")).otherwise(F.col("value")))
    means = spark.range(50).select(F.col("id").alias("gene_id"), (F.col("id") / 4.0).alias("mean"))
    return E.technology_scaled(e, means).select("cell_id", "gene_id", F.round("value", 6).alias("value"))


@query()
def neighbour_components(spark, d):
    c = cells(spark, d)
    counts = features(c, 8, 6).select("id", F.col("feature").alias("gene_id"), F.abs("value").alias("value"))
    return E.neighbour_components(spatial.neighbour_aggregate(spatial.knn_join(c, c, 8), counts, "sum"), list(range(6)), 3)


@query()
def approximate_knn(spark, d):
    c = cells(spark, d)
    return vectors.approximate_knn(c, c.where("id % 20 = 0"), 10, cells=16, probes=8)
