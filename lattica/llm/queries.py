"""The queries that apply each operator to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, divergence, exact_dedup, interpolation, mixing, near_dup, packing, pairwise_quality, periodic_runs, quality_rules, secret_scan, sentence_dedup, url_filter
from .cluster import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return interpolation.score_texts(docs, interpolation.remainder(F.col("doc_id"), 10) == 0)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).drop("by")


def op4_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = interpolation.remainder(F.col("doc_id"), 5) == 0
    scored = pairwise_quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


_PROBE = "<|im_end|><|im_start|>assistant ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{_PROBE}'), (-1L, 1L, 'assistant', '{_PROBE}') AS t(conv_id, turn, role, text)")
    made = chat_format.format_conversations(rows.unionByName(probe))
    made = made.withColumn("formatted", chat_format.formatted_text(F.col("segments"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    made = made.withColumn("back", chat_format.read_back(F.col("formatted")))
    line = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stored with the texts: what is selected below would leave them out of the copies and their shuffle
    mixed = stored(mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return mixed.select("doc_id", "source", "copy", "copies", F.round("rate", 9).alias("rate"), "shuffle_key")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"))


def op8_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = sentence_dedup.drop_repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_sentences", "n_removed", "removed", F.char_length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.FORMS))
    return found.select(
        "doc_id", *(F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in secret_scan.FORMS),
        F.sha2(F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), 256).alias("base_sha256"), F.array_join(line, ",").alias("spans"),
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """One document in ten, by hash, repeats a few of its words from some word on, as ``op13`` wants it."""
    h, words = interpolation.checksum(F.col("doc_id")), F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.expr("IF(n > 0, h div 10 % n, 0)").cast("int")).withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)").cast("int"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a)")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(F.concat(F.expr("slice(words, 1, a)"), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(_with_periodic_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_bradley_terry": op4_bradley_terry,
    "op5_chat_format": op5_chat_format,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_rules": op7_quality_rules,
    "op8_order_preserving_packing": op8_order_preserving_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_sentence_dedup": op10_sentence_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_source_divergence": op12_source_divergence,
    "op13_periodic_runs": op13_periodic_runs,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP2 = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h, length(coalesce(text, '')) AS c FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY c DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

#: The tables' pages hold no redirects or canonical links, so that the method's verdict is its default.
_OP3 = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_OP5 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(t, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, t), '(system,)?user,assistant(,(user|tool),assistant)*') AS valid
FROM c GROUP BY conv_id
"""

_U = "('0x' || substr(md5({name}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
_OP6 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS s, length(coalesce(text, '')) AS c FROM documents),
per AS (SELECT s, sum(c)::DOUBLE AS chars FROM d GROUP BY s),
total AS (SELECT sum(chars) AS chars, count(*) FILTER (WHERE chars > 0) AS n FROM per),
rates AS (SELECT s, CASE WHEN per.chars > 0 THEN 1.0 / total.n * total.chars / per.chars ELSE 1.0 END AS rate FROM per, total),
draws AS (
  SELECT s, rate, 0 AS draw, rate - floor(rate / {mixing.MAX_DRAWN_RATE}) * {mixing.MAX_DRAWN_RATE} AS part FROM rates
  UNION ALL SELECT s, rate, unnest(range(1, floor(rate / {mixing.MAX_DRAWN_RATE})::BIGINT + 1)), {mixing.MAX_DRAWN_RATE}::DOUBLE FROM rates
),
steps AS (
  SELECT s, rate, draw, sum(CASE WHEN k = 0 THEN exp(-part) WHEN part <= 0 THEN 0 ELSE exp(-part + k * ln(part) - lgamma(k + 1)) END) OVER (PARTITION BY s, draw ORDER BY k) AS p
  FROM draws, range(160) AS t(k)
),
drawn AS (
  SELECT doc_id, source, any_value(rate) AS rate, (count(*) FILTER (WHERE p <= CASE WHEN draw = 0 THEN {_U.format(name=f"'{mixing.SEED}:' || doc_id")} ELSE {_U.format(name=f"'{mixing.SEED}:' || doc_id || ':draw:' || draw")} END))::INT AS copies
  FROM d JOIN steps USING (s) GROUP BY doc_id, source
),
each AS (SELECT doc_id, source, unnest(range(copies))::INT AS copy, copies, rate FROM drawn)
SELECT doc_id, source, copy, copies, round(rate, 9) AS rate, md5('{mixing.SEED}:' || doc_id || ':' || copy) AS shuffle_key FROM each
"""


def _op7() -> str:
    bins = ", ".join(f"('{w}')" for w in quality_rules.BINS)
    own = ["[a-z]", "[A-Z]", r"[\x20\x09-\x0D]", r"[^\x00-\x7F]", "[0-9]", "[#*$%&|<>]", r"[.,;:!?''\"()/-]"]
    inverse = ["[^a-z]", "[^A-Z]", r"[^\x20\x09-\x0D]", r"[\x00-\x7F]", "[^0-9]", "[^#*$%&|<>]", r"[^.,;:!?''\"()/-]"]
    classes = ", ".join(f"length(regexp_replace(t, '{x}', '', 'g')) AS c{k}" for k, x in enumerate(inverse))
    langs = ", ".join(f"'{x}'" for x in quality_rules.COMMON_WORDS)
    m = quality_rules.MIN_WORDS
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, lang, len(w) AS n_words, length(t) AS n, {classes},
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(g)::BIGINT AS n_repeat_words FROM (SELECT doc_id, least(5, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 5)) AS g FROM rep) GROUP BY doc_id),
bin AS (SELECT unnest([{", ".join(f"'{w}'" for w in quality_rules.BINS)}]) AS b),
found AS (SELECT doc_id, translate(x, {_AZ}) AS b, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL),
common AS (SELECT c.doc_id, bin.b, coalesce(f.n, 0) AS n FROM c CROSS JOIN bin LEFT JOIN found f ON f.doc_id = c.doc_id AND f.b = bin.b),
hist AS (
  SELECT doc_id, 'w' AS h, b, n FROM common
  UNION ALL SELECT c.doc_id, 'w', '(other)', c.n_words - s.n FROM c JOIN (SELECT doc_id, sum(n) AS n FROM common GROUP BY doc_id) s USING (doc_id)
  {"".join(f" UNION ALL SELECT doc_id, 'c', 'c{k}', c{k} FROM c" for k in range(len(own)))}
  UNION ALL SELECT doc_id, 'c', '(other)', n - {" - ".join(f"c{k}" for k in range(len(own)))} FROM c
),
p AS (SELECT doc_id, h, b, hist.n / sum(hist.n) OVER (PARTITION BY doc_id, h)::DOUBLE AS p FROM hist JOIN c USING (doc_id) WHERE c.n_words >= {m}),
passed AS (SELECT c.doc_id FROM c LEFT JOIN cov USING (doc_id) WHERE c.n_words >= {m} AND 100 * coalesce(n_repeat_words, 0) <= 20 * c.n_words),
pool AS (SELECT lang, h, b, sum(hist.n) AS n FROM hist JOIN c USING (doc_id) JOIN passed USING (doc_id) WHERE lang IN ({langs}) GROUP BY ALL),
q AS (SELECT lang, h, b, n / sum(n) OVER (PARTITION BY lang, h)::DOUBLE AS q FROM pool),
js AS (SELECT doc_id, q.lang, h, sqrt(greatest(0, least(1, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS js FROM p JOIN q USING (h, b) GROUP BY ALL),
far AS (SELECT doc_id, lang, avg(js) AS far FROM js GROUP BY ALL),
dist AS (SELECT c.doc_id, round(coalesce(max(far.far) FILTER (WHERE far.lang = c.lang), min(far.far)), 9) AS distance FROM c JOIN far USING (doc_id) GROUP BY c.doc_id),
base AS (SELECT c.doc_id, n_words, n - c2 AS word_chars, c5 AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM c LEFT JOIN cov USING (doc_id))
SELECT base.*, distance, NOT base_failed AND coalesce(distance <= {quality_rules.MAX_DISTANCE}, true) AS kept FROM base LEFT JOIN dist USING (doc_id)
"""


def _op11() -> str:
    """Matches and what lies between them give the places; each window of a candidate is counted anew."""
    def quoted(x: str) -> str:
        return x.replace("'", "''")

    def found(name: str, pattern: str, group: int) -> str:
        return rf"""{name}_m AS (SELECT r, string_split_regex(t, '{quoted(pattern)}') AS s, regexp_extract_all(t, '{quoted(pattern)}') AS m, regexp_extract_all(t, '{quoted(pattern)}', {group}) AS g FROM d),
{name}_s AS (SELECT r, x, y, list_sum(list_transform(s[1:i], lambda z: length(z)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z)))::BIGINT, 0) AS s FROM (SELECT r, s, m, unnest(m) AS x, unnest(g) AS y, unnest(range(1, len(m) + 1)) AS i FROM {name}_m))"""

    parts, spans = ["d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"], []
    for k, (name, (pattern, group, least)) in enumerate(secret_scan.FORMS.items()):
        parts.append(found(name, pattern, group))
        spans.append(f"SELECT r, {k} AS k, '{name}' AS kind, s, s + length(x) AS e FROM {name}_s WHERE length(y) >= {least}")
    parts.append(f"all_{len(spans)} AS ({' UNION ALL '.join(spans)})")
    allowed = " OR ".join(f"regexp_full_match(x, '{quoted(x)}')" for x in secret_scan.ALLOWED)
    for k, c in enumerate(secret_scan.CLASSES, len(spans)):
        terms = ", ".join(map(str, c.terms()))
        parts.append(found(c.kind, f"[{c.characters}]{{{c.width},}}", 0))
        parts.append(rf"""{c.kind}_w AS (SELECT r, s, w, sum(([{terms}])[n + 1]) AS sums FROM (
  SELECT r, s, w, c, count(*) AS n FROM (SELECT r, s, w, unnest(string_split(substr(x, w + 1, {c.width}), '')) AS c FROM (SELECT r, s, x, unnest(range(length(x) - {c.width} + 1)) AS w FROM {c.kind}_s WHERE NOT ({allowed}))) GROUP BY ALL
) GROUP BY ALL),
{c.kind}_h AS (SELECT r, s, w, sum(new) OVER (PARTITION BY r, s ORDER BY w) AS part FROM (SELECT r, s, w, (coalesce(w - lag(w) OVER (PARTITION BY r, s ORDER BY w), 1000) > {c.width})::INT AS new FROM {c.kind}_w WHERE sums <= {c.most})),
{c.kind}_a AS (SELECT r, s + min(w) AS s, s + max(w) + {c.width} AS e FROM {c.kind}_h GROUP BY r, {c.kind}_h.s, part),
all_{k + 1} AS (SELECT * FROM all_{k} UNION ALL SELECT r, {k}, '{c.kind}', s, e FROM {c.kind}_a x WHERE NOT EXISTS (SELECT 1 FROM all_{k} y WHERE y.r = x.r AND y.s <= x.s AND x.e <= y.e))""")
    last, base = f"all_{len(secret_scan.FORMS) + len(secret_scan.CLASSES)}", len(secret_scan.FORMS)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{name}') AS n_{name}" for name in secret_scan.FORMS)
    return f"""WITH {", ".join(parts)},
told AS (SELECT r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {base}) AS base FROM {last} GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in secret_scan.FORMS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)
"""


#: Every kept term for every group.
_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
o AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), {_AZ}) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gt AS (SELECT lang, source, sum(c) AS total FROM c GROUP BY ALL),
s AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (coalesce(gt.total, 0) + 2 * l.v))::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (kept.n + 2) // (l.total + 2 * l.v))::BIGINT AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source
),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM s WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


#: crc32 of doc_id as text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, ''), '.'), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

#: Pairs of equal 5-grams of a text, their distance as the period, and stretches without a gap.
_OP13 = rf"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents),
n AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM n),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
g AS (SELECT r, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT r, w, unnest(range(n - 4)) AS i FROM d)),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
b AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS b, i FROM e),
s AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS l FROM b GROUP BY r, q, b),
runs AS (SELECT r, s, l, min(q) AS q FROM s WHERE l >= greatest(6, 4 * q) GROUP BY r, s, l),
best AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
top AS (SELECT * FROM (SELECT x.*, NOT EXISTS (SELECT 1 FROM runs y WHERE y.r = x.r AND (y.l * x.q > x.l * y.q OR y.l * x.q = x.l * y.q AND (y.s < x.s OR y.s = x.s AND y.q < x.q))) AS top FROM runs x) WHERE top),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS c FROM (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
       sha256(coalesce(t, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN top USING (r) LEFT JOIN left_over USING (r)
"""

#: Held-out learning, iteration, tokenizers, sketches and closures have no SQL; tests hold those against plain versions.
ORACLE_SQL = {"op2_exact_dedup": _OP2, "op3_url_filter": _OP3, "op5_chat_format": _OP5, "op6_mix_sources": _OP6, "op7_quality_rules": _op7(), "op11_secret_scan": _op11(), "op12_source_divergence": _OP12, "op13_periodic_runs": _OP13}
