"""Queries of row-level harmonisation: filters, id mapping, labels, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clamped_codes, missing_label, sanitised
from ..operators import harmonise as H
from .common import EXPR, expr
from .registry import query, table


@query("""SELECT c_nationkey % 3 AS section_id, c_custkey || '-' || (c_nationkey % 3) AS cell_id, c_acctbal AS value, CASE WHEN c_nationkey % 3 = 1 THEN c_mktsegment END AS label FROM customer WHERE c_nationkey % 3 <> 2""")
def concat_sections(spark, d):
    c = table(spark, d, "customer")
    parts = []
    for k in range(3):
        own = c.where(F.col("c_nationkey") % 3 == k).select(F.col("c_custkey").alias("cell_id"), F.col("c_acctbal").alias("value"), *([F.col("c_mktsegment").alias("label")] if k == 1 else []))
        parts.append((k, own))
    return H.concat_sections(parts, held_out=("section2",)).select("section_id", "cell_id", "value", "label")


@query(f"WITH {EXPR}, r AS (SELECT cell_id FROM expr WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT gene_id) >= 50) SELECT cell_id, gene_id, value FROM expr SEMI JOIN r USING (cell_id)")
def min_genes_filter(spark, d):
    return H.min_genes(expr(spark, d), 50).select("cell_id", "gene_id", "value")


@query("SELECT p_partkey, regexp_matches(p_name, '(?i)^(part 1|PART 2|blank)') AS control, starts_with(p_name, 'part') AS strict FROM part")
def control_mask(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", H.control_mask(F.col("p_name"), ["part 1", "PART 2", "blank"]).alias("control"), H.control_mask(F.col("p_name"), ["part"], True).alias("strict"))


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) >= 60 THEN p_type END AS p_type FROM part")
def rare_to_null(spark, d):
    return H.rare_to_null(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", 60)


@query("SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS n_batches FROM customer GROUP BY 1 HAVING count(*) >= 10 AND count(DISTINCT c_mktsegment) >= 2")
def scorable_groups(spark, d):
    return H.scorable_groups(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("""WITH a AS (SELECT p_brand AS key, min(p_partkey) AS id FROM part WHERE p_size < 5 GROUP BY 1), b AS (SELECT p_brand AS key, min(p_partkey) + 1000000 AS id FROM part GROUP BY 1)
SELECT p_partkey, coalesce(a.id, b.id, -1) AS mapped FROM part LEFT JOIN a ON a.key = p_brand LEFT JOIN b ON b.key = p_brand""")
def ortholog_chain(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size < 5").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("id"))
    b = p.select(F.col("p_brand").alias("key"), (F.col("p_partkey") + 1000000).alias("id"))
    return H.mapping_chain(p.select("p_partkey", "p_brand"), "p_brand", [a, b], F.lit(-1)).select("p_partkey", "mapped")


@query(f"WITH {EXPR} SELECT cell_id, 'g' || (gene_id % 7) AS symbol, sum(value) AS value FROM expr WHERE gene_id < 40 GROUP BY ALL")
def gene_collapse(spark, d):
    mapping = spark.range(40).select(F.col("id").alias("gene_id"), F.concat(F.lit("g"), (F.col("id") % 7).cast("string")).alias("symbol"))
    return H.collapse_genes(expr(spark, d), mapping)


@query("SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 45")
def shared_genes(spark, d):
    p = table(spark, d, "part")
    return H.shared_genes(p.where("p_size < 10"), p.where("p_size > 45"), "p_brand")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 100")
def hash_subsample(spark, d):
    return H.hash_subsample(table(spark, d, "customer"), "c_custkey", 100, 7).select("c_custkey", "c_name")


@query("""WITH b AS (SELECT p_partkey, p_type, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS bare FROM part)
SELECT p_partkey, CASE WHEN bare = 'economy' THEN 'Budget' WHEN contains(bare, 'promo') THEN 'Promotion' WHEN contains(bare, 'st') THEN 'Steel' ELSE upper(substr(trim(p_type), 1, 1)) || lower(substr(trim(p_type), 2)) END AS label FROM b""")
def label_canonical(spark, d):
    label = H.canonical_label(F.col("p_type"), {"economy": "Budget"}, [("promo", "Promotion"), ("st", "Steel")])
    return table(spark, d, "part").select("p_partkey", label.alias("label"))


@query("SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
def mode_label(spark, d):
    return H.most_frequent(table(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'new donor' WHEN contains(lower(o_orderpriority), 'high') THEN 'replicate' ELSE 'reference' END AS role FROM orders")
def sample_role(spark, d):
    return table(spark, d, "orders").select("o_orderkey", H.role_of(F.col("o_orderpriority"), [("urgent", "new donor"), ("high", "replicate")], "reference").alias("role"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS label FROM events")
def missing_labels(spark, d):
    raw = F.when(F.col("event_type") == "click", F.when(F.col("event_id") % 2 == 0, "nan").otherwise("None")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", missing_label(raw).alias("label"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'sample') AS name FROM pages")
def sanitised_names(spark, d):
    return table(spark, d, "pages").select("page_id", sanitised(F.col("url")).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 8 ELSE least(7, o_custkey % 12) END AS c0, CASE WHEN o_orderstatus = 'P' THEN 4 ELSE least(3, o_orderkey % 6) END AS c1 FROM orders")
def clamp_codes(spark, d):
    o = table(spark, d, "orders")
    codes = clamped_codes(F.array(F.col("o_custkey") % 12, F.col("o_orderkey") % 6), [8, 4], F.col("o_orderstatus") != "P")
    return o.select("o_orderkey", codes.alias("c")).select("o_orderkey", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"))


@query("""SELECT coalesce(n.n_name, r.r_name) AS key, coalesce(n.n_regionkey, r.r_regionkey)::INT AS value FROM nation n FULL JOIN region r ON n.n_name = r.r_name""")
def metadata_override(spark, d):
    new = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"))
    old = table(spark, d, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("value"))
    return H.override_metadata(old, new, "key").select("key", F.col("value").cast("int").alias("value"))


@query(f"WITH {EXPR}, s AS (SELECT cell_id, sum(value) AS size FROM expr GROUP BY 1) SELECT (SELECT bool_and(value % 1 = 0) FROM expr) AS whole, (SELECT bool_and(value >= 0) FROM expr) AS nonnegative, min(size) AS size_min, median(size) AS size_median, max(size) AS size_max, 0.0::DOUBLE AS missing_share, false AS warn FROM s")
def count_diagnosis(spark, d):
    labels = table(spark, d, "supplier").select(F.col("s_name").alias("label"))
    return H.count_diagnosis(expr(spark, d), labels)
