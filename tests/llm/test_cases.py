"""Cases that every operator must take: repeated rows, clashing columns, hubs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import interpolation, mixing, pairwise_quality, quality_rules, url_filter
from lattica.llm.cluster import connected_components, join_dealt

TEXT = "The river runs by the old house and on to the sea, as it has for a long time."


def test_repeated_pages_have_equal_verdicts(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/de/x", None, "h")] * 3 + [(2, "http://b.org/fr/", "<p>", "h")] * 2, "page_id long, url string, html string, host string")
    found = Counter((r.page_id, r.verdict, r.rule) for r in url_filter.judge_urls(pages).collect())
    assert found == {(1, "block", "example.com/de/"): 3, (2, "allow", "org/fr/"): 2}
    assert url_filter.allowed_pages(pages).count() == 2 and url_filter.allowed_pages(pages).columns == pages.columns


def test_repeated_texts_have_equal_quality(spark):
    docs = spark.createDataFrame([(1, TEXT, "en", 9)] * 3 + [(2, "x", "en", 9)] * 2, "doc_id long, text string, lang string, distance int")
    assert Counter((r.doc_id, r.kept) for r in quality_rules.quality_verdicts(docs).collect()) == {(1, True): 3, (2, False): 2}
    kept = quality_rules.keep_by_rules(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_repeated_texts_have_equal_scores(spark):
    docs = spark.createDataFrame([(1, TEXT, 0.5)] * 3 + [(2, "| | |", 0.5), (3, TEXT + " More.", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    found = pairwise_quality.score_quality(docs, labels, F.lit(True)).collect()
    assert len(found) == 5 and len({r.score for r in found if r.doc_id == 1}) == 1


def test_repeated_rows_are_drawn_alike(spark):
    docs = spark.createDataFrame([(i, "abcdef", "s", 1) for i in range(40)] * 2, "doc_id long, text string, source string, copies int")
    found = Counter(r.doc_id for r in mixing.mix_sources(docs, size=2.0).collect())
    assert all(n % 2 == 0 for n in found.values())


def test_model_with_clashing_columns_and_repeated_rows(spark, tmp_path):
    rows = [(i, f"the house of stone {i % 3}", 1, "b", 2.0) for i in range(30)] + [(7, "the house of stone 1", 1, "b", 2.0)] * 2
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, block int, grp string, score double").repartition(2).write.parquet(path)
    found = interpolation.score_texts(spark.read.parquet(path), F.col("doc_id") == 0).collect()
    assert len(found) == 32 and len({(r.n_tokens, r.n_known, round(r.score, 9)) for r in found if r.doc_id == 7}) == 1
    assert {r.train_tokens for r in found} == {31 * 6}


def test_frequent_keys_are_joined_where_they_are(spark):
    rng = random.Random(2)
    keys = [0] * 900 + [rng.randrange(1, 50) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(keys)), "row long, key long").repartition(5)
    keyed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("least"))
    found = join_dealt(rows, keyed, "key", len(keys)).collect()
    assert sorted((r["row"], r["key"], r["least"]) for r in found) == sorted((i, k, keys.index(k)) for i, k in enumerate(keys))


def test_components_of_hubs_and_of_a_random_graph(spark):
    rng = random.Random(3)
    edges = [(10_000, k) for k in range(600)] + [(20_000 + k, 10_000 + k) for k in range(300)] + [(rng.randrange(30_000, 30_400), rng.randrange(30_000, 30_400)) for _ in range(150)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {v: root(v) for e in edges if e[0] != e[1] for v in e}
    assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()} == want


@pytest.mark.parametrize("values", [[], [0], [5, 2**32 + 5, 3], [2**64 - 1] * 50, list(range(300)), [2**40] * 400])
def test_packed_numbers(values):
    packed = interpolation._pack(np.array(values, np.uint64))
    assert interpolation._unpack(packed).tolist() == values


def test_totals_above_32_bits(spark):
    keys, rows = np.array([7, 9, 2**63], np.uint64), []
    for block, group in ((1, interpolation.TRAIN), (2, interpolation.TRAIN), (3, interpolation.DELETED), (4, interpolation.UNSEEN)):
        rows.append((0, interpolation.BIGRAM, block, group, interpolation._pack_keys(keys), interpolation._pack(np.array([1, 2**32 - 1, 3_000_000_000], np.int64))))
    totals = interpolation._totals(spark.createDataFrame([(*r[:4], bytearray(r[4]), bytearray(r[5])) for r in rows], interpolation._SENT)).collect()
    assert len(totals) == 5
    for r in totals:
        if r.block is not None:
            assert interpolation._unpack(bytes(r.kept)).tolist() == [2, 2**33 - 2, 6_000_000_000] and interpolation._unpack(bytes(r.deleted)).tolist() == [1, 2**32 - 1, 3_000_000_000]
        else:
            assert (r.n_kept, r.n_deleted, r.v) == (2**33 + 6_000_000_000, 2**32 + 3_000_000_000, 3)


def test_repeated_labels_and_texts_of_one_doc_id(spark):
    texts = [(1, TEXT), (1, "Other words here."), (2, "| | |"), (3, TEXT + " More."), (4, "a | b | c")]
    labels = [(1, 1), (2, 0), (3, 1), (4, 0)]

    def scores(texts, labels):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        found = pairwise_quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
        return sorted((r.doc_id, r.score) for r in found.collect())

    assert scores(texts, labels) == scores(texts[::-1], [*labels, (1, 1), (1, 1), (4, 0)])
