"""The whole pipeline against plain versions of its stages, chained."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lattica.llm import mixing, packing, queries
from lattica.session import shared_folder
from test_pairs import plain_exact, plain_near


def fixture(spark, tmp_path):
    """The smallest documents with copies and near copies of some, empty texts and a passage without words."""
    rows = duckdb.sql("SELECT doc_id, text, lang, source, n_chars FROM '/root/testdata/sf0.001/documents.parquet' WHERE length(text) < 4000 ORDER BY doc_id").fetchall()
    more = []
    for k, (i, text, lang, source, n) in enumerate(rows[:40]):
        words = (text or "").split(" ")
        if k % 4 == 0:
            more.append((10_000 + i, (text or "") + " ", lang, source, n))
        elif k % 4 == 1 and len(words) > 120:
            more.append((20_000 + i, " ".join([*words[:60], "other", *words[61:]]), lang, "src0", n))
    rows = rows + more + [(30_000, None, "en", None, 0), (30_001, "", None, "src1", 0), (30_002, "\\n \\n", "xx", "src1", 3)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows, path


def plain_copies(rows):
    """How often each document comes, by summing the Poisson distribution until it passes the draw."""
    chars = Counter()
    for _, text, _, source, _ in rows:
        chars[source or ""] += len(text or "")
    total, n = sum(chars.values()), sum(c > 0 for c in chars.values())
    copies = {}
    for i, _, _, source, _ in rows:
        own = chars[source or ""]
        rate = total / n / own if own else 1.0
        whole = int(rate // mixing.MAX_DRAWN_RATE)
        count = 0
        for k, part in enumerate([rate - whole * mixing.MAX_DRAWN_RATE, *[mixing.MAX_DRAWN_RATE] * whole]):
            name = f"{mixing.SEED}:{i}" if k == 0 else f"{mixing.SEED}:{i}:draw:{k}"
            u = int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / (1 << 48)
            p, reached = math.exp(-part), math.exp(-part)
            for j in range(1, 160):
                if reached > u:
                    break
                count += 1
                p *= part / j
                reached += p
        copies[i] = count
    return copies


def test_pipeline_equals_its_plain_stages(spark, tmp_path):
    rows, path = fixture(spark, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op7_quality_rules']}) WHERE kept").fetchall()}
    left = [r for r in rows if r[0] in good]
    exact = plain_exact([(r[0], r[1]) for r in left])
    left = [r for r in left if exact[r[0]][2]]
    near = plain_near([(r[0], r[1]) for r in left], 5, 80)
    kept = [r for r in left if near[r[0]][2]]
    assert len(good) < len(rows) and len(left) < len(good) and len(kept) < len(left)
    copies = plain_copies(kept)
    found = corpus_pipeline.run(spark, path).collect()
    tokens = defaultdict(int)
    for r in found:
        tokens[r.doc_id] += r.length
    lengths = {r.doc_id: r.doc_tokens for r in found}
    assert {i: n // lengths[i] for i, n in tokens.items()} == {i: n for i, n in copies.items() if n}
    # pieces of the copies: each copy's ids are whole and in order, and sequences have no gaps
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts, pieces, at = {r[0]: r[1] for r in kept}, defaultdict(list), defaultdict(int)
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert max(at.values()) <= packing.LENGTH
    for i, own in pieces.items():
        ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        assert lengths[i] == len(ids)
        assert all(zlib.crc32(ids[start : start + n].tobytes()) == crc for start, n, crc in own)
        ends = Counter(start + n for start, n, _ in own)
        assert all(start == 0 or ends[start] for start, *_ in own) and ends[len(ids)] == copies[i]


def test_run_leaves_nothing_but_its_rows(spark, tmp_path):
    """No text and no step's table stays in the shared folder: of all files there that ``run`` added, only those of its result have rows."""
    _, path = fixture(spark, tmp_path)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    found = corpus_pipeline.run(spark, path)
    rows = {f: pq.read_metadata(f).num_rows for f in set(folder.rglob("*.parquet")) - before}
    assert sum(rows.values()) == found.count() > 0
    assert {f.parent for f, n in rows.items() if n} == {Path(f.removeprefix("file:")).parent for f in found.inputFiles()}


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_empty_tables(spark, k):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.STAGES[k][1](spark, docs, "")
    assert out.count() == 0
    assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
