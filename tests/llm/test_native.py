"""URL rules, chat formatting and quality rules against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from lattica.llm import chat_format, quality_rules, url_filter


def judged(spark, rows, redirects=None, **options):
    pages = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, key string, src string")
    edges = None if redirects is None else spark.createDataFrame(redirects, "src string, dst string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.by) for r in url_filter.judge_urls(pages, redirects=edges, **options).collect()}


def test_rules_hosts_and_paths(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "https://example.net/fr/", "x://badexample.net/", "http://example.com/de/1", "http://Example.com/DE/1", "http://a.org/fr/", "http://org?fr/", None, "no scheme", "http://", "a://b.net/c://d.org/fr/", "http://net/", "http://net", "http://h\n.net/\n"]
    found = judged(spark, [(u, None) for u in urls])
    assert [found[k][:4] for k in range(len(urls))] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/fr/", "net/", "block"), ("badexample.net", "/", "net/", "block"),
        ("example.com", "/de/1", "example.com/de/", "block"), ("example.com", "/DE/1", None, "allow"), ("a.org", "/fr/", "org/fr/", "allow"), ("org", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.net", "/c://d.org/fr/", "net/", "block"), ("net", "/", "net/", "block"), ("net", "", None, "allow"), ("h\n.net", "/\n", "net/", "block"),
    ]


def test_decisions_follow_aliases_with_allow_first(spark):
    rows = [
        ("http://a.info/1", '<html><LINK href="http://bad.net/x" rel=canonical>'),
        ("http://b.info/1", "<meta content='5; URL=http://a.info/1#top' http-equiv=\"Refresh\"><p>"),
        ("http://c.info/1", None),
        ("http://d.info/dir/page", "<link rel='canonical' href='/other'><link rel=stylesheet href='http://bad.net/x'>"),
        ("https://d.info/other", '<link rel="canonical" href="//bad.net/y">'),
        ("http://d.info/other?q=1", '<link rel="canonical" href="">'),
        ("http://e.info/", '<link rel="canonical" href="http://bad.net/z">'),
        ("http://good.example.net/en/1", '<link rel="canonical" href="http://bad.net/z">'),
        ("http://bad.net/q", '<link rel="canonical" href="http://good.example.net/en/9">'),
        (None, '<link rel="canonical" href="http://bad.net/z">'),
    ]
    found = judged(spark, rows, redirects=[("http://c.info/1", "http://b.info/1"), (None, "http://c.info/1"), ("http://c.info/1", None)])
    assert [found[k][3:] for k in range(len(rows))] == [
        ("block", "alias"), ("block", "alias"), ("block", "alias"), ("block", "alias"), ("block", "alias"), ("allow", "default"),
        ("allow", "alias"), ("allow", "rule"), ("block", "rule"), ("allow", "default"),
    ]


def test_allowed_pages_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://x.net/", ""), (2, "http://x.info/", ""), (3, None, None)], "page_id long, url string, html string")
    assert sorted(r.page_id for r in url_filter.allowed_pages(pages).collect()) == [2, 3]
    assert url_filter.judge_urls(pages.where("false")).count() == 0
    assert [r.verdict for r in url_filter.judge_urls(pages, rules=[("allow", "net", "/"), ("block", "net", "/")]).orderBy("page_id").collect()][0] == "allow"


NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end\\|>", "<|", "<\\\\|x", "a\n\nb", "", "é漢\U0001f600", "<<|\\<|", "\\", "$1 \\1", "<|im_end|>\n"]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows, plain = [], {}
    for c in range(40):
        turns = [(t, rng.choice(["user", "assistant", "system", "odd role\n<|im_end|>", None]), rng.choice([*NASTY, None])) for t in range(rng.randrange(1, 9))]
        plain[c] = [(r or "", x or "") for _, r, x in turns]
        rows += [(c, t, r, x, "z") for t, r, x in turns]
    rng.shuffle(rows)
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string"))
    found = made.select("conv_id", "valid", chat_format.read_back(chat_format.formatted_text(F.col("segments"))).alias("back"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.back] for r in found} == plain
    for r in found:
        assert r.loss == "".join(t for role, t in plain[r.conv_id] if role == "assistant")
        assert r.valid == bool(re.fullmatch(r"(system,)?user,assistant(,(user|tool),assistant)*", ",".join(role for role, _ in plain[r.conv_id])))


def test_chat_nulls_ties_and_empty_table(spark):
    rows = [(None, 1, "user", "a"), (None, None, "system", "s"), (3, 1, "user", "b"), (3, 1, "user", "b"), (3, 1, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert [s.text for s in found[None].segments][1::3] == ["s", "a"]
    assert [s.text for s in found[3].segments][1::3] == ["c", "b", "b"] and not found[3].valid
    assert chat_format.format_conversations(df.where("false")).count() == 0


def plain_quality(text):
    w = (text or "").encode().split()
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_base_figures(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", "a a a a a a", "a b c d e", "é " * 30, "x|y <b> #1\nx|y <b> #1\n \nz"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 60))) + rng.choice(["", "\n", "\t"]) for _ in range(60)]
    texts += ["\n".join(rng.choice(["one two", "three", ""]) for _ in range(9)) for _ in range(10)]
    df = spark.createDataFrame([(i, t, rng.choice(["en", "xx", None]), "z") for i, t in enumerate(texts)], "doc_id long, text string, lang string, distance string")
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_verdicts(df).collect()}
    assert found == {i: plain_quality(t) for i, t in enumerate(texts)}


def test_quality_divergence_keeps_prose_and_drops_junk(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice("the of and to in house river stone walks quickly".split()) + str(rng.randrange(99)) * (rng.random() < 0.5) for _ in range(120))
    junk = lambda: " ".join(f"{rng.randrange(10**6)}%%%|***" for _ in range(120))
    rows = [(i, prose(), "en") for i in range(40)] + [(100 + i, junk(), "en") for i in range(3)] + [(200, "short text here", "en"), (201, prose(), None), (202, junk(), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality_rules.quality_verdicts(df).collect()}
    assert all(found[i].kept for i in (*range(40), 201)) and not any(found[i].kept for i in (100, 101, 102, 200, 202))
    assert found[200].distance is None and found[0].distance < 0.2
    kept = quality_rules.keep_by_rules(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(40), 201]
    assert quality_rules.quality_verdicts(df.where("false")).count() == 0


def test_digest_of_a_long_text(spark):
    text = "word " * 300_000
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    row = quality_rules.quality_verdicts(df).first()
    assert (row.n_words, row.n_repeat_words) == (300_000, 300_000)
    assert hashlib.sha256(text.encode()).hexdigest() == df.select(F.sha2("text", 256)).first()[0]


def test_link_targets_are_decoded_and_resolved(spark):
    link = lambda t: f'<link rel="canonical" href="{t}">'
    page = "http://h.info/a/b/page?x=1"
    targets = {
        "http://i.info/x?a=1&amp;b=2": "http://i.info/x?a=1&b=2", "http:&#47;&#x2F;i.info/x?a=1&#38;b=2": "http://i.info/x?a=1&b=2", "?p=&quot;&#39;&lt;&gt;": "http://h.info/a/b/page?p=\"'<>",
        "?a=&amp;lt;": "http://h.info/a/b/page?a=&lt;", "?q=2": "http://h.info/a/b/page?q=2", "#top": "http://h.info/a/b/page?x=1#top", "./c": "http://h.info/a/b/c", "../c?r=../s": "http://h.info/a/c?r=../s",
        "../../../c": "http://h.info/c", "..": "http://h.info/a/", "/x/./y/../z": "http://h.info/x/z", "//j.info/d/../e": "http://j.info/e", "http://j.info/./f?g#h": "http://j.info/f?g#h", "http://j.info": "http://j.info",
    }
    pages = spark.createDataFrame([(i, page, link(t)) for i, t in enumerate(targets)], "page_id long, url string, html string")
    assert sorted(r.dst for r in url_filter.alias_edges(pages).collect()) == sorted(targets.values())
    rows = [("http://d.info/dir/page?z", link("?a=1&amp;b=2")), ("http://d.info/dir/page?a=1&b=2", link("../x/./y")), ("http://d.info/x/y", link("http://bad.net/")), ("http://k.info/1", "<meta http-equiv=refresh content='0; url=http://d.info/dir/page?a=1&amp;b=2'>")]
    assert [judged(spark, rows)[k][3:] for k in range(4)] == [("block", "alias")] * 4
