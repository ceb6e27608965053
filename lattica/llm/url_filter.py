"""URL rules whose block decisions follow redirects and canonical links, in DataFrame operations only.

A rule names a host and a path. It fits its host and all subdomains where the path
starts with the rule's; the longest rule that fits decides. A page without a rule
takes the decision of its aliases: urls that redirects and canonical links connect,
directly or through others. There an allow rule takes precedence over a block rule,
and an alias group without any rule is allowed.

Edges are read from the pages themselves (``<link rel=canonical>`` and
``<meta http-equiv=refresh>``) and from an optional table of redirects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .cluster import connected_components
from .text import LOWER, UPPER

#: (action, host, path)
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def fold(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return fold(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """What names a page among its aliases: the url without scheme and fragment, host in lower case."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.concat(host_of(url), rest))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as ``struct(action, rule)``, else null.

    Of rules of one length that with the longer host wins, then the greater one, and
    allow goes before block. The rules are a list in the driver's hands, written into the plan.
    """
    fits = []
    for action, name, prefix in rules:
        name = name.lower()
        on_host = (host == F.lit(name)) | host.endswith("." + name)
        rank = F.struct(
            F.lit(len(name) + len(prefix)).alias("length"), F.lit(len(name)).alias("host_length"),
            F.lit(name + prefix).alias("rule"), F.lit(action == "allow").alias("allows"), F.lit(action).alias("action"),
        )
        fits.append(F.when(on_host & path.startswith(prefix), rank))
    best = F.sort_array(F.filter(F.array(*fits), lambda x: x.isNotNull()), asc=False)
    return F.try_element_at(best, F.lit(1))


def _tags(html: Column, name: str) -> Column:
    """The insides of all tags of one name; linear in the length of the text, whatever it holds."""
    parts = F.split(F.coalesce(html, F.lit("")), "<")
    own = F.filter(parts, lambda x: F.lower(F.substring(x, 1, len(name) + 1)).rlike(f"^{name}[\\s/]"))
    return F.transform(own, lambda x: F.substring_index(x, ">", 1))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(found, r"""^["']|["']$""", ""))


#: Character references in link targets; ``&amp;`` comes last, so that nothing is decoded twice.
_REFERENCES = [
    (r"&quot;|&#0*34;|&#[xX]0*22;", '"'), (r"&apos;|&#0*39;|&#[xX]0*27;", "'"), (r"&lt;|&#0*60;|&#[xX]0*3[cC];", "<"), (r"&gt;|&#0*62;|&#[xX]0*3[eE];", ">"),
    (r"&sol;|&#0*47;|&#[xX]0*2[fF];", "/"), (r"&colon;|&#0*58;|&#[xX]0*3[aA];", ":"), (r"&quest;|&#0*63;|&#[xX]0*3[fF];", "?"), (r"&equals;|&#0*61;|&#[xX]0*3[dD];", "="),
    (r"&amp;|&#0*38;|&#[xX]0*26;", "&"),
]


def _decoded(text: Column) -> Column:
    for pattern, char in _REFERENCES:
        text = F.regexp_replace(text, pattern, char)
    return text


def _without_dots(path: Column) -> Column:
    """``path``, which starts with ``/``, without its ``.`` and ``..`` segments; one at the end leaves a ``/``."""
    parts = F.split(path, "/")
    start = F.slice(parts, 1, 1)
    step = lambda out, p: F.when(p == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).when(p == ".", out).otherwise(F.concat(out, F.array(p)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), start, step)
    last = F.element_at(parts, -1)
    whole = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), whole).otherwise(path)


def _absolute(target: Column, url: Column) -> Column:
    """``target`` as read on the page ``url``: absolute, ``//host``, ``/path``, ``?query``, ``#fragment`` or relative to the folder."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    base = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    page = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    way, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    host = F.regexp_extract(target, r"(?s)^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)", 1)
    whole = F.concat(host, _without_dots(F.regexp_extract(target, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)), F.regexp_extract(target, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^?#]*(.*)$", 1))
    return (
        F.when(target == "", F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), whole)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), whole))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^([^#]*)", 1), target))
        .when(target.startswith("?"), F.concat(base, page, target))
        .when(target.startswith("/"), F.concat(base, _without_dots(way), rest))
        .otherwise(F.concat(base, _without_dots(F.concat(folder, way)), rest))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` urls of all canonical links and refresh redirects in ``pages(url, html)``."""
    html = F.col("html").cast("string")
    links = F.transform(F.filter(_tags(html, "link"), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)")), lambda t: _decoded(_attribute(t, "href")))
    refresh = F.filter(_tags(html, "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    redirects = F.transform(refresh, lambda t: F.regexp_extract(_decoded(_attribute(t, "content")), r"""(?is)url\s*=\s*["']?([^"']*)""", 1))
    linked = pages.where(F.lower(html).contains("canonical") | F.lower(html).contains("refresh")).select("url", F.explode(F.concat(links, redirects)).alias("target"))
    return linked.select(F.col("url").alias("src"), _absolute(F.col("target"), F.col("url")).alias("dst"))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """A verdict for every row of ``pages(page_id, url, html)``; other columns are not read.

    ``redirects(src, dst)`` adds edges between urls. Returns page_id, host, path, rule
    (like ``net/``, null if none fits), verdict (allow or block), by (rule, alias or default).
    A null url or one without ``://`` has an empty host and path, no rule and no aliases: allow.
    Null html has no links. Repeated rows have equal verdicts. Empty table: no rows.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    edges = checkpointed(edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    by_key = edges.select(page_key(F.col("src")).alias("src"), page_key(F.col("dst")).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    judged = pages.drop("html").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    parts = connected_components(by_key)
    inherited = None
    if not parts.isEmpty():
        # rules of the urls themselves, pages or not; what lies after ? plays no part in them
        marked = parts.withColumn("url", F.concat(F.lit("x://"), "node"))
        marked = marked.withColumn("own", rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)["action"])
        of_group = marked.groupBy("component").agg(F.when(F.bool_or(F.col("own") == "allow"), "allow").when(F.bool_or(F.col("own") == "block"), "block").alias("group_verdict"))
        inherited = parts.join(of_group.where("group_verdict IS NOT NULL"), "component").select(F.col("node").alias("key"), "group_verdict")
        judged = judged.withColumn("key", page_key(F.col("url"))).join(inherited, "key", "left")
    else:
        judged = judged.withColumn("group_verdict", F.lit(None).cast("string"))
    own = F.col("found.action")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(own, F.col("group_verdict"), F.lit("allow")).alias("verdict"),
        F.when(own.isNotNull(), "rule").when(F.col("group_verdict").isNotNull(), "alias").otherwise("default").alias("by"),
    )


def allowed_pages(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """The rows of ``pages`` whose url isn't blocked; page_id must tell rows apart."""
    blocked = judge_urls(pages, rules, redirects).where("verdict = 'block'").select(F.col("page_id").alias("__blocked"))
    return pages.join(blocked, pages.page_id.eqNullSafe(blocked["__blocked"]), "left_anti")
