"""Language model, ranking, mixing, packing and substring dedup against plain versions."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import cluster, interpolation, mixing, near_dup, packing, pairwise_quality, queries, sentence_dedup

WORDS = "the of and to in house river stone walk quick".split()


def corpus(n=150, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text, w = [], "the"
        for _ in range(rng.randrange(0, 40)):
            w = WORDS[(WORDS.index(w) + rng.choice([1, 1, 1, 2])) % 10] if rng.random() < 0.8 else rng.choice(WORDS)
            text.append(w if rng.random() < 0.95 else f"Rare{rng.randrange(400)}")
        rows.append((i, " ".join(text)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "É é É"), (n + 2, "É é É"), (None, "the of")]


def stored(spark, tmp_path, rows, schema="doc_id long, text string", parts=3):
    path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def rounded(p):
    """To a quarter power of two, 2**-40 at least."""
    return 0.0 if p == 0 else 2.0 ** -(min(160, max(0, round(-4 * math.log2(p)))) / 4)


def plain_em(seen, v):
    """Weights of each bucket by expectation-maximisation, a token at a time, with one prior token for each estimate."""
    weights = {}
    for bucket in range(interpolation.BUCKETS):
        own, m = [(p2, p1, n) for (b, p2, p1), n in seen.items() if b == bucket], [1 / 3] * 3
        for _ in range(200):
            sums = [1.0] * 3
            for p2, p1, n in own:
                share = [m[0] * p2, m[1] * p1, m[2] / (v + 1)]
                sums = [s + n * x / sum(share) for s, x in zip(sums, share)]
            m = [s / sum(sums) for s in sums]
        weights[bucket] = m if bucket else [0.0, m[0] + m[1], m[2]]
    return weights


def plain_model(rows, held, deleted):
    """Counts in dictionaries, and the EM above."""
    tokens = lambda t: (t or "").encode().lower().split() + [0]
    one, pair, context = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        if not held(i):
            k, w = int(deleted(i)), tokens(t)
            for v, x in zip([1, *w], w):
                one[k][x] += 1
                pair[k][v, x] += 1
                context[k][v] += 1
    n_kept, n = one[0].total(), one[0].total() + one[1].total()
    v_all = len(one[0] | one[1])
    bucket = lambda c: min(c.bit_length(), interpolation.BUCKETS - 1)
    seen = Counter()
    for i, t in rows:
        if not held(i) and deleted(i):
            w = tokens(t)
            for v, x in zip([1, *w], w):
                c = one[0][v] if v != 1 else context[0][1]
                seen[bucket(c), rounded(pair[0][v, x] / max(c, 1)), rounded(one[0][x] / max(n_kept, 1))] += 1
    weights = plain_em(seen, v_all)
    out = defaultdict(list)
    for i, t in rows:
        w, score, base, known = tokens(t), 0.0, 0.0, 0
        for v, x in zip([1, *w], w):
            c1 = one[0][x] + one[1][x]
            c = sum((o[v] if v != 1 else k[1]) for o, k in zip(one, context))
            m = weights[bucket(c)]
            p = m[0] * (pair[0][v, x] + pair[1][v, x]) / max(c, 1) + m[1] * c1 / max(n, 1) + m[2] / (v_all + 1)
            score += math.log10(p)
            base += math.log10((c1 + 0.1) / (n + 0.1 * (v_all + 1)))
            known += c1 > 0
        out[i].append((held(i), len(w), known, n, base, score))
    return out


@pytest.mark.parametrize("block_bytes,range_bytes", [(24_000_000, 12_000_000), (700, 300), (1, 20)])
def test_interpolation_equals_plain_model(spark, tmp_path, block_bytes, range_bytes):
    rows = corpus()
    crc = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    docs = stored(spark, tmp_path, rows)
    found = interpolation.score_texts(docs, interpolation.remainder(F.col("doc_id"), 10) == 0, deleted=interpolation.remainder(F.col("doc_id"), 10) == 1, block_bytes=block_bytes, range_bytes=range_bytes).collect()
    plain = plain_model(rows, lambda i: crc(i) % 10 == 0, lambda i: crc(i) % 10 == 1)
    assert len(found) == len(rows)
    for r in found:
        want = plain[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9) and r.score == pytest.approx(want[5], rel=1e-6)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_interpolation_probabilities_sum_to_one():
    cells = np.array([[3, 5, 9], [3, 0, 12], [0, 0, 7]])
    w = interpolation.learn_weights(cells, np.array([10.0, 4.0, 2.0]), 100)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and w[3, 0] > w[5, 0]


def test_interpolation_without_training_or_rows(spark, tmp_path):
    rows = [(1, "a b"), (2, None)]
    found = interpolation.score_texts(stored(spark, tmp_path, rows), F.lit(True)).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in found} == {1: (3, 0, 0), 2: (1, 0, 0)}
    assert all(r.score == pytest.approx(0.0) for r in found)
    assert interpolation.score_texts(stored(spark, tmp_path, []), F.lit(True)).count() == 0


def test_ranking_separates_held_out_texts(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.4) for _ in range(rng.randrange(12, 60))).capitalize() + "."
    bad = lambda: rng.choice([" | ".join(rng.choice(WORDS) for _ in range(30)), "BUY!! NOW!! " * 9, "same same same " * 8])
    rows = [(i, good() if i % 4 else bad(), "en", "s", 1) for i in range(240)] + [(900, None, "en", "s", 1), (901, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, features int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(240)] + [(5, None), (6, 9), (None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in pairwise_quality.score_quality(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    held = [i for i in range(240) if i % 5 == 0]
    assert sum(found[i].predicted == (i % 4 > 0) for i in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values()) and len(found) == 242
    flat = pairwise_quality.score_quality(docs, labels.where("false"), F.lit(True))
    assert flat.select("score").distinct().count() == 1
    assert pairwise_quality.score_quality(docs.where("false"), labels, F.lit(True)).count() == 0


def test_ranking_weights_solve_the_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.2, size=400) > 0).astype(int)
    r = pairwise_quality.learn_ranking(x, y)
    assert r.weights[0] > 0 > r.weights[1] and abs(r.weights[2]) < r.weights[0] / 5
    assert ((r.score(x) >= pairwise_quality.CUT) == (y == 1)).mean() > 0.93


def test_ranking_weights_equal_gradient_descent():
    """The same loss by plain gradient descent over all drawn pairs, a step at a time."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 3)) * [1.0, 5.0, 0.2]
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    r = pairwise_quality.learn_ranking(x, y, pairs_each=4, ridge=0.05)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(20240607)
    winners = np.concatenate([np.repeat(good, 4), draw.choice(good, len(bad) * 4)])
    losers = np.concatenate([draw.choice(bad, len(good) * 4), np.repeat(bad, 4)])
    w = np.zeros(3)
    for _ in range(20_000):
        slope = 0.05 * w
        for k in range(3):
            slope[k] -= np.mean((z[winners, k] - z[losers, k]) / (1 + np.exp((z[winners] - z[losers]) @ w)))
        w -= 0.5 * slope
        if np.abs(slope).max() < 1e-10:
            break
    assert np.allclose(r.weights, w, atol=1e-6)
    assert r.threshold == pytest.approx(np.quantile(z @ w, len(bad) / 60), abs=1e-5)


def test_a_score_at_the_cut_is_predicted_good():
    r = pairwise_quality.Ranking(np.zeros(1), np.ones(1), np.ones(1), 0.5, 1.0)
    assert r.score(np.array([[0.5], [0.5 + 1e-6], [0.5 - 1e-3]])) == pytest.approx([0.3, 0.3, 0.3], abs=1e-3)
    assert r.score(np.array([[0.5 + 1e-6]]))[0] >= pairwise_quality.CUT > r.score(np.array([[0.5 - 1e-3]]))[0]


def test_mixing_reaches_targets(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(1, 200), rng.choice("aaaaaaaabbc"), "n", 5) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string, rate int")
    mixed = mixing.mix_sources(docs, weights={"a": 1.0, "b": 2.0, "c": 1.0}).select("doc_id", "source", F.length("text").alias("n"), "copy", "copies", "rate").collect()
    chars = Counter()
    for r in mixed:
        chars[r.source] += r.n
    total = sum(chars.values())
    assert abs(total / sum(len(t) for _, t, *_ in rows) - 1) < 0.15
    assert all(abs(chars[s] / total - w) < 0.06 for s, w in (("a", 0.25), ("b", 0.5), ("c", 0.25)))
    seen = defaultdict(list)
    for r in mixed:
        seen[r.doc_id].append((r.copy, r.copies))
    assert all(sorted(c for c, _ in own) == list(range(own[0][1])) for own in seen.values())
    # counts follow the Poisson distribution of their rate
    rate = next(r.rate for r in mixed if r.source == "b")
    n = sum(1 for x in rows if x[2] == "b")
    zero = n - len({r.doc_id for r in mixed if r.source == "b"})
    assert abs(zero / n - math.exp(-rate)) < 0.03


def test_mixing_draws_invert_the_distribution(spark):
    for rate in (0.0, 0.3, 1.0, 31.9):
        steps = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s")).first().s
        want = np.cumsum([math.exp(-rate + (k * math.log(rate) if k else 0) - math.lgamma(k + 1)) if rate or not k else 0.0 for k in range(160)])
        assert np.allclose(steps, want, atol=1e-12)


def test_mixing_nulls_large_rates_and_empty_table(spark):
    rows = [(1, "abc", None), (2, None, "e"), (None, "abc", "z"), (3, "a", "tiny"), (4, "b" * 4000, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs).collect()
    assert sum(r.source == "tiny" for r in mixed) > 700 and sum(r.source == "e" for r in mixed) <= 8
    assert mixing.mix_sources(docs.where("false")).count() == 0
    order = [r.shuffle_key for r in mixing.mix_sources(docs).coalesce(1).collect()]
    assert len(set(order)) == len(order)


TOKENIZER = pytest.importorskip("tokenizers").Tokenizer


def check_packing(rows, found, length=packing.LENGTH):
    tokenizer = TOKENIZER.from_file(packing.tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    padding = tokens = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        tokens += at
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / max(1, padding + tokens)


def test_packing_round_trip(spark):
    rng = random.Random(5)
    odd = ["", None, "<|endoftext|> a", "É́é  it's DON'T 12345", "　漢字 \x1c x\x85y", "á ́b", "\U0001f600\U0001f1e9\U0001f1ea"]
    rows = list(enumerate(odd)) + [(100 + i, " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", "", ".", "!"]) for _ in range(rng.randrange(1, 900)))) for i in range(60)]
    rows += [(500, "long" * 3000), (501, "no stop " * 9000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, length string").coalesce(1)
    assert check_packing(rows, packing.pack_documents(docs).collect()) < 0.01
    assert check_packing(rows, packing.pack_documents(docs.repartition(5)).collect()) < 0.01
    assert packing.pack_documents(docs.where("false")).count() == 0
    twice = packing.pack_documents(docs.where("doc_id = 500").union(docs.where("doc_id = 500"))).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.sampled_from([0, 1, 2])), min_size=1, max_size=40))
def test_cuts_are_optimal(steps):
    length = 16
    position = np.cumsum([s for s, _ in steps])
    kind = np.array([k for _, k in steps])
    cost = [[0, 8, 64][k] for k in kind]
    cost[-1] = 0
    rest = lambda size: size % 5
    best = [0.0] + [math.inf] * len(steps)
    at = [0, *position.tolist()]
    for i in range(1, len(at)):
        for j in range(i):
            if at[i] - at[j] <= length:
                size = at[i] - at[j]
                best[i] = min(best[i], best[j] + (rest(size) if i == len(steps) else cost[i - 1] + length - size))
    cuts = packing.cut_windows(position, kind, length, rest_cost=rest)
    got, last = 0, 0
    for c in cuts:
        assert position[c] - last <= length
        size = int(position[c] - last)
        got += rest(size) if c == len(steps) - 1 else cost[c] + length - size
        last = position[c]
    assert cuts[-1] == len(steps) - 1 and got == best[-1]


@pytest.mark.parametrize("run_tokens", [64, 500, 5000])
def test_runs_do_not_show_in_the_cuts(monkeypatch, run_tokens):
    rng = np.random.default_rng(4)
    docs = [(k, rng.integers(5, 900, int(n)).astype(np.uint32)) for k, n in enumerate(rng.integers(1, 400, 150))]

    def pieces(limit):
        stream, at = packing._Stream(256, 0), limit
        for k, ids in docs:
            stream.add(k, ids, np.flatnonzero(ids % 11 == 0) + 1)
            if stream.size >= at:
                stream.cut(final=False)
                at = max(limit, 2 * stream.size)
        stream.cut(final=True)
        return stream.rows

    assert pieces(run_tokens) == pieces(1 << 40)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_gives_its_own_ids(name):
    path = packing.tokenizer_path(name)
    texts = ["Two  words\n\n and   more. ", "", "x", "it's 12 %% \t a."]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, first, *_ = packing.WordIds(path).encode(np.frombuffer(data, np.uint8), offsets)
    whole = TOKENIZER.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def plain_spans(rows, span, min_words, few):
    first, gone, count = {}, {}, Counter()
    for _, text in rows:
        data = (text or "").encode()
        cuts = sentence_dedup.sentence_starts(data).tolist()
        parts = [data[a:b].lower().split() for a, b in zip(cuts, cuts[1:])] if data else []
        count.update(tuple(w for p in parts[k : k + span] for w in p) for k in range(len(parts) - span + 1))
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        cuts = sentence_dedup.sentence_starts(data).tolist()
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:])] if data else []
        own = set()
        for k in range(len(parts) - span + 1):
            words = tuple(w for p in parts[k : k + span] for w in p.lower().split())
            begun = first.setdefault(words, (i, k))
            if begun != (i, k) if len(words) >= min_words else words and begun[0] != i and count[words] <= few:
                own |= set(range(k, k + span))
        gone[i] = (len(parts), len(own), b"".join(p for k, p in enumerate(parts) if k not in own).decode())
    return gone


@pytest.mark.parametrize("span", [2, 3])
def test_repeated_spans_equal_brute_force(spark, span):
    rng = random.Random(span)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(2, 9))) + rng.choice([".", "!", "?\"", "\n"]) for _ in range(25)]
    passage = ["The shared passage begins here with words.", "It goes on for a while longer.", "Then it ends, as passages do, here."]
    rows = []
    for i in range(60):
        text = [rng.choice(pool) for _ in range(rng.randrange(0, 9))]
        if i % 5 == 0:
            text[1:1] = passage
        rows.append((i, rng.choice([" ", "  "]).join(text)))
    rows += [(100, None), (101, ""), (102, "é. " * 40), (None, " ".join(passage)), (103, " ".join(passage))]
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, starts string, removed int")
    for few in (sentence_dedup.FEW, 2):
        found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentence_dedup.drop_repeated_spans(docs, span=span, few=few).collect()}
        assert found == plain_spans(rows, span, sentence_dedup.MIN_WORDS, few)
    assert found[0][1] < found[5][1] or found[0][1] == 0
    assert sentence_dedup.drop_repeated_spans(docs.where("false")).count() == 0


def test_repeated_rows_count_once(spark):
    text = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen."
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (1, "else. other. third one.")], "doc_id long, text string")
    found = sentence_dedup.drop_repeated_spans(docs, min_words=12).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(1, 0), (1, 0), (1, 0), (2, 3)]


def test_phrases_and_repeats_in_one_text_stay(spark):
    licence = "Shared under the usual terms. All rights are kept. See the notice."
    shouted = " ".join("buy!! now!!" for _ in range(60))
    own = [" ".join(f"w{i}x{k}" for k in range(40)) + "." for i in range(3)]
    rows = [(0, f"{licence} {own[0]}"), (1, f"{own[1]} {licence}"), (2, f"start {shouted} end"), (3, f"{own[2]} {shouted}")] + [(10 + i, f"{licence} other{i} words.") for i in range(sentence_dedup.FEW)]
    found = {r.doc_id: r.text for r in sentence_dedup.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == rows[0][1] and found[1] == rows[1][1]
    assert found[3].startswith(own[2]) and len(found[3].split()) < 70  # another text's run is a repeat


@pytest.mark.parametrize("size", [9, 15, 20, 24, 30])
def test_short_passages_of_two_texts_are_found(spark, size):
    """Three whole sentences of any length that two texts share, in fresh text."""
    rng = random.Random(size)
    fresh = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**9)}" for _ in range(n)) + ". "
    rows = []
    for i in range(40):
        passage = "".join(fresh(size // 3) for _ in range(3))
        rows += [(2 * i, fresh(30) + passage + fresh(20)), (2 * i + 1, fresh(10) + passage + fresh(40))]
    found = {r.doc_id: r for r in sentence_dedup.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(found[2 * i].n_removed == 0 and found[2 * i + 1].n_removed == 3 and len(found[2 * i + 1].text.split()) == 50 for i in range(40))


def test_repeated_passages_of_any_sentences_are_found(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10**9)}" for _ in range(n)]
    one, two = fresh(60), [*fresh(30)[:-1], "ends.", *fresh(30)]
    han = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(60))
    rows, planted = [], {}
    for i in range(0, 60, 2):
        passage = (one, two)[i // 2 % 2]
        cut = rng.randrange(0, 60 - 49)
        own = passage if i < 4 else passage[cut : cut + 49]
        rows.append((i, " ".join([*fresh(rng.randrange(0, 30)), *own, *fresh(rng.randrange(0, 30))])))
        rows.append((i + 1, " ".join(fresh(120))))
        planted[i] = own
    rows += [(100, "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(30)) + han), (101, han[5:55] + "\u6f22\u3002" + "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in sentence_dedup.drop_repeated_spans(docs).collect()}
    texts = dict(rows)
    for i in (0, 2, 100, *range(1, 60, 2)):
        assert (found[i].n_removed, found[i].text) == (0, texts[i])
    for i in range(4, 60, 2):
        left, whole, own = found[i].text.split(), texts[i].split(), set(planted[i])
        assert found[i].n_removed > 0 and 25 <= len(whole) - len(left)
        assert [w for w in left if w not in own] == [w for w in whole if w not in own]
    assert found[101].n_removed > 0 and found[101].text.endswith("x y z") and len(texts[101]) - len(found[101].text) >= 25


@pytest.mark.parametrize("size", [25, 30, 48])
def test_short_texts_of_one_sentence_are_found(spark, size):
    """Texts with fewer runs of words than a window has: equal ones go, and so does a long text's copy of one that a selected run of its lies in."""
    rng = random.Random(size)
    fresh = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(10**9)}" for _ in range(n))
    texts = [fresh(size) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t + ("." if k % 2 else "")) for k, t in enumerate(texts)] + [(200 + k, fresh(size)) for k in range(30)]
    rows += [(300 + k, f"{fresh(60)} {t} {fresh(60)}") for k, t in enumerate(texts)]
    found = {r.doc_id: r for r in sentence_dedup.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(found[k].text == t and found[200 + k].n_removed == 0 for k, t in enumerate(texts))
    assert all(found[100 + k].text == "" for k in range(0, 30, 2)) and all(found[100 + k].n_removed == (k % 2 == 0 or size > 25) for k in range(30))
    caught = [300 + k for k in range(30) if found[300 + k].n_removed]
    assert len(caught) == 30 if size == 48 else len(caught) < 30
    assert all(len(found[i].text.split()) <= 120 + size - 25 for i in caught)


def test_no_repeat_of_a_run_and_window_survives(spark):
    rng = random.Random(13)
    pool = [f"w{k}" for k in range(3000)]
    rows = [(i, " ".join(pool[a : a + rng.randrange(20, 200)])) for i in range(80) for a in [rng.randrange(2900)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, n = set(), sentence_dedup.RUN + sentence_dedup.WINDOW - 1
    for r in sorted(sentence_dedup.drop_repeated_spans(docs).collect(), key=lambda r: r.doc_id):
        left, whole = r.text.split(), rows[r.doc_id][1].split()
        assert not any(tuple(left[k : k + n]) in seen for k in range(len(left) - n + 1))
        seen |= {tuple(whole[k : k + n]) for k in range(len(whole) - n + 1)}


def test_mix_query_moves_whole_documents(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * (i % 7 + 1), "ab"[i % 3 > 0]) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    monkeypatch.setattr(queries, "stored", lambda df: made.append(cluster.stored(df)) or made[-1], raising=False)
    found = queries.op6_mix_sources(spark, str(tmp_path)).collect()
    assert len(made) == 1
    assert sorted((r.shuffle_key, r.text) for r in made[0].collect()) == sorted((r.shuffle_key, rows[r.doc_id][1]) for r in found)


@pytest.mark.parametrize("rate", [31.5, 40.0, 64.0])
def test_mixing_counts_of_large_rates_are_poisson(spark, rate):
    docs = spark.createDataFrame([(i, "abc", "s") for i in range(2000)], "doc_id long, text string, source string")
    counts = Counter(r.doc_id for r in mixing.mix_sources(docs, size=rate).select("doc_id").collect())
    n = np.array([counts[i] for i in range(2000)])
    assert abs(n.mean() / rate - 1) < 0.02 and abs(n.var() / rate - 1) < 0.15


def test_very_long_texts(spark, tmp_path):
    """A text of 200,000 words through the operators that run Python, beside short ones."""
    rng = random.Random(12)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(200_000)) + "."
    rows = [(1, long), (2, long + " more"), (3, "a short text of seven words here"), (4, None)]
    docs = stored(spark, tmp_path, rows)
    scored = {r.doc_id: r for r in interpolation.score_texts(docs, F.col("doc_id") == 3).collect()}
    assert scored[1].n_tokens == 200_001 and scored[2].n_tokens == 200_002 and scored[1].n_known == 200_001
    near = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    assert check_packing(rows, packing.pack_documents(docs).collect()) < 0.02
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert pairwise_quality.score_quality(docs, labels, F.lit(True)).where("score IS NOT NULL").count() == 4
    cleaned = {r.doc_id: r for r in sentence_dedup.drop_repeated_spans(docs).collect()}
    assert cleaned[1].text == long and len(cleaned[2].text.split()) < 100 and cleaned[3].n_removed == 0


def test_ranking_learns_from_every_labelled_row(spark, monkeypatch):
    """Over many small buckets, with a rare label: means, threshold and weights are those of all rows, and there are pairs for each of them."""
    monkeypatch.setattr(pairwise_quality, "BUCKET", 40)
    monkeypatch.setattr(pairwise_quality, "EACH_LABEL", 8)
    counted = []
    newton = pairwise_quality._newton
    monkeypatch.setattr(pairwise_quality, "_newton", lambda sums, *more: newton(lambda w: counted.append(sums(w)) or counted[-1], *more))
    rng = np.random.default_rng(5)
    width = len(pairwise_quality.FEATURES)
    y = (np.arange(400) % 20 > 0).astype(int)
    x = rng.normal(size=(400, width))
    x[:, 0] += 1.5 * y
    learned = spark.createDataFrame([(i, int(b), v.tolist()) for i, (b, v) in enumerate(zip(y, x, strict=True))], "doc_id long, quality int, features array<double>").repartition(3)
    r = pairwise_quality.learn_ranking_of_all(learned)
    assert np.allclose(r.mean, x.mean(0)) and np.allclose(r.spread, x.std(0))
    assert r.threshold == pytest.approx(np.quantile(r.raw(x), 20 / 400), abs=1e-12)
    assert counted[0][0] == 400 * pairwise_quality.PAIRS_EACH
    plain = pairwise_quality.learn_ranking(x, y)
    assert np.corrcoef(r.weights, plain.weights)[0, 1] > 0.95
    assert not hasattr(pairwise_quality, "MAX_LABELLED")
