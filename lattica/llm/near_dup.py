"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

Texts become sets of word shingles with 64-bit hashes. Documents with equal sets
form a class, and one of each class goes on. One permutation of the hashes fills
``bins`` bins of a signature; an empty bin takes the value of a bin that a fixed
sequence of random choices hits first (optimal densification). Each run of
``rows`` bins is a band, and classes with an equal band share a bucket. A bucket
proposes a star: edges from its centre to its other members, never all pairs.

Every star edge is confirmed on the full sets. The crowd of a class is the total size of its
buckets: in a group of near copies the classes nearest to all others have the largest, so
they are the centres.

1. Each class tries its hub, the most crowded centre of its buckets: one edge a class.
2. Stars with members outside their centre's component get all their edges compared.
3. A link between two members that their centre hasn't joined shows in their differences from it. Each member
   outside the centre's component looks for such partners among those that the triangle inequality of
   the set difference leaves, narrowed by the shingles that no other open class has and by parities of cells, a lower
   bound; then the differences decide exactly. What comes out is not pairs but, for each
   component, the least and the greatest other component that it is linked to. Merge, and repeat until there is none.

So every pair of classes that shares a bucket is linked through others or proven not to be linked, and each round gives
at most one row a component. The time of step 3 can still grow with the square of the number of members that lie
just beyond the threshold from their centre. A pair at similarity 0.85 shares 12 of 32 bands of 6 rows on average,
and none with a probability of 3e-7 (at 0.8: 6e-5).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .cluster import Scratch, connected_components, join_dealt, packed, unpacked

BANDS, ROWS = 32, 6
#: Lanes over which the edges of a centre are dealt, and, at most, the members of a star.
LANES, MOST_LANES = 64, 32
#: Cells of the parity sketch, and bins for the range of differences that a centre's size allows.
PARITY, BINS = 512, 4


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of fewer words: the whole sequence as one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    return np.unique(T.combine(*(words[i : n - k + 1 + i] for i in range(k))))


def _attempts(bins: int, tries: int = 256) -> np.ndarray:
    return np.random.default_rng(97).integers(0, bins, (tries, bins))


def signature(hashes: np.ndarray, bins: int, attempts: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted, non-empty set, densified optimally."""
    place = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    filled, first = np.unique(place, return_index=True)  # sorted hashes: the first in a bin is its least
    filled = filled.astype(np.int64)
    source = np.full(bins, -1)
    source[filled] = first
    if len(filled) == 1:
        source[:] = first[0]
    empty, k = np.flatnonzero(source < 0), 0
    has = source >= 0
    while len(empty):
        if k < len(attempts):
            chosen = attempts[k][empty]
        else:  # the rare rest, by the same rule from a longer sequence
            chosen = (T.mix(empty.astype(np.uint64) * np.uint64(0x9E37) + np.uint64(k)) % np.uint64(bins)).astype(np.int64)
        hit = has[chosen]
        source[empty[hit]] = source[chosen[hit]]
        empty, k = empty[~hit], k + 1
    return hashes[source]


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    grid = sig.reshape(bands, -1)
    return T.combine(np.arange(bands, dtype=np.uint64), *grid.T).view(np.int64)


def set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64)) if len(hashes) else 0


def _sets(batch: pa.RecordBatch, size: int):
    data, offsets = T.utf8(batch.column("text"))
    step = 2048
    for lo in range(0, len(offsets) - 1, step):
        hashes, first = T.words(data, offsets[lo : lo + step + 1])
        for k in range(len(first) - 1):
            yield shingle_hashes(hashes[first[k] : first[k + 1]], size)


def sketches(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, sid, bands)``: set size, id of the set and its band keys (null without words)."""

    def sketch(batches):
        attempts = _attempts(bands * rows)
        for batch in batches:
            sizes, ids, keys = [], [], []
            for s in _sets(batch, shingle):
                sizes.append(len(s))
                ids.append(set_id(s))
                keys.append(band_keys(signature(s, bands * rows, attempts), bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "sid", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(sketch, "doc_id long, n_shingles long, sid long, bands array<long>")


def _full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(sid, shingles, p0 ... p7)``: the sorted set of each text, and of each of its ``PARITY`` cells whether an odd number of hashes falls into it."""
    names = [f"p{k}" for k in range(PARITY // 64)]

    def full(batches):
        for batch in batches:
            part, total = [], 0
            for s in _sets(batch, shingle):
                part.append(s)
                total += len(s)
                if total > 500_000:  # bounded batches, as sets are larger than their texts
                    yield _sets_batch(part, names)
                    part, total = [], 0
            if part:
                yield _sets_batch(part, names)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(full, "sid long, shingles array<long>, " + ", ".join(f"{p} long" for p in names))


def _sets_batch(sets: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    values = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    odd = np.bincount(owner * PARITY + (values % np.uint64(PARITY)).astype(np.int64), minlength=len(sets) * PARITY).astype(np.uint8) & 1
    cells = np.packbits(odd.reshape(len(sets), PARITY), axis=1).view(np.int64)
    shingles = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), shingles, *(pa.array(np.ascontiguousarray(cells[:, k])) for k in range(len(names)))], ["sid", "shingles", *names])


def _pairs_of_sets(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """``edges(a, b)`` with the full sets ``x`` of a and ``y`` of b.

    A ``b`` may have any number of edges: they are dealt over lanes, and its set goes to each lane that needs it.
    """
    dealt = edges.withColumn("lane", F.pmod(F.xxhash64("a"), F.lit(LANES)))
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    right = dealt.select("b", "lane").distinct().hint("merge").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
    return dealt.hint("merge").join(left, "a").join(right.hint("merge"), ["b", "lane"])


def _close(apart, sizes, percent: int):
    """Whether sets of ``sizes`` in total that differ by ``apart`` have 100 * intersection >= percent * union."""
    return 100 * (sizes - apart) >= percent * (sizes + apart)


def _named(rows: DataFrame, labels: DataFrame, node: str, component: str) -> DataFrame:
    """``rows`` with the component of a node; nodes without links are their own."""
    return rows.join(labels.select(F.col("node").alias(node), F.col("component").alias(component)), node, "left").withColumn(component, F.coalesce(component, node))


def _partners(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``(component, low, high)``: the least and the greatest other component that a member of a star is linked to.

    ``stars(a, c, na, nc, own, rest, lanes, extra, gone, p0 ...)`` are members a of the stars of centres c, with their differences from c.
    Of two members in different components one isn't in the centre's; it looks for partners in the bins that its bound allows.
    """
    named = _named(_named(stars, labels, "a", "ca"), labels, "c", "cc").withColumn("outer", F.col("ca") != F.col("cc"))
    # a link to a needs own + |rest - rest of the other| <= reach, as no partner is larger than 100 / percent times a
    named = named.withColumn("width", F.greatest(F.lit(1), F.floor(F.col("nc") * (100 - percent) / (percent * BINS)))).withColumn("reach", F.floor(F.col("na") * (100 - percent) / percent) - F.col("own"))
    fields = F.struct("a", "ca", "na", "own", "rest", "extra", "gone", *(f"p{k}" for k in range(PARITY // 64)))
    bins = F.sequence(F.floor(F.greatest(F.lit(0), F.col("rest") - F.col("reach")) / F.col("width")), F.floor((F.col("rest") + F.col("reach")) / F.col("width")))
    lanes = F.sequence(F.lit(0), F.col("lanes") - 1)
    looking = named.where("outer AND reach >= 0").select("c", F.explode(bins).alias("bin"), lanes.alias("lanes"), fields.alias("x")).select("c", "bin", F.explode("lanes").alias("lane"), "x")
    there = named.select("c", F.floor(F.col("rest") / F.col("width")).alias("bin"), F.pmod(F.xxhash64("a"), F.col("lanes")).cast("int").alias("lane"), "outer", fields.alias("y"))
    x, y = (lambda name: F.col(f"x.{name}")), (lambda name: F.col(f"y.{name}"))
    sizes = x("na") + y("na")
    least = x("own") + y("own") + F.abs(x("rest") - y("rest"))
    odd = sum((F.bit_count(x(f"p{k}").bitwiseXOR(y(f"p{k}"))) for k in range(1, PARITY // 64)), F.bit_count(x("p0").bitwiseXOR(y("p0"))))
    shared = F.size(F.array_intersect("x.extra", "y.extra")) + F.size(F.array_intersect("x.gone", "y.gone"))
    apart = F.size("x.extra") + F.size("x.gone") + F.size("y.extra") + F.size("y.gone") - 2 * shared
    once = ~F.col("outer") | (x("a") < y("a"))
    found = looking.join(there, ["c", "bin", "lane"]).where((x("ca") != y("ca")) & once & _close(least, sizes, percent) & _close(odd, sizes, percent) & _close(apart, sizes, percent))
    return found.groupBy(x("ca").alias("component")).agg(F.min(y("ca")).alias("low"), F.max(y("ca")).alias("high"))


def _merged(scratch: Scratch, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels(node, component)`` after ``edges(src, dst)`` between components."""
    joined = scratch.keep(connected_components(edges))
    of = joined.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    moved = labels.join(of, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    merged = scratch.keep(moved.union(joined.join(labels.select("node"), "node", "left_anti").select("node", "component")))
    scratch.drop(joined, labels)
    return merged


def _linked(scratch: Scratch, sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``(node, component)`` of all linked sets, given ``members(sid, centre, hub)`` of the buckets."""
    first = members.select(F.col("sid").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    sizes = F.size("x") + F.size("y")
    same = F.size(F.array_intersect("x", "y"))
    links = _pairs_of_sets(first, sets).where(_close(sizes - 2 * same, sizes, percent)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = scratch.keep(connected_components(links))

    stars = scratch.keep(members.select(F.col("sid").alias("a"), F.col("centre").alias("c")).where("a <> c").distinct())
    apart = _named(_named(stars, labels, "a", "ca"), labels, "c", "cc").groupBy("c").agg(F.count("*").alias("n"), F.bool_or(F.col("ca") != F.col("cc")).alias("open"))
    apart = scratch.keep(apart.where("open").withColumn("lanes", F.least(F.lit(MOST_LANES), F.ceil(F.col("n") / 256)).cast("int")).select("c", "n", "lanes"))
    total = apart.agg(F.sum("n")).first()[0]
    if not total:
        scratch.drop(stars, apart)
        return labels
    opened = scratch.keep(join_dealt(stars, apart, "c", stars.count()))
    scratch.drop(stars, apart)
    nodes = opened.select(F.col("a").alias("sid")).union(opened.select("c")).distinct()
    shown = scratch.keep(sets.join(nodes.hint("merge"), "sid"))
    once = shown.select("sid", F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("sid").alias("a")).where("n = 1")
    own = once.groupBy("a").agg(F.count("*").alias("own"))
    pairs = _pairs_of_sets(opened.select("a", F.col("c").alias("b"), "lanes"), shown)
    pairs = pairs.select("a", F.col("b").alias("c"), "lanes", F.size("x").alias("na"), F.size("y").alias("nc"), F.array_except("x", "y").alias("extra"), F.array_except("y", "x").alias("gone"))
    pairs = pairs.join(own, "a", "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("rest", F.size("extra") + F.size("gone") - F.col("own"))
    differing = scratch.keep(pairs.join(shown.drop("shingles").withColumnRenamed("sid", "a"), "a"))
    scratch.drop(opened, shown)
    centres = _named(_named(differing.where(_close(F.col("rest") + F.col("own"), F.col("na") + F.col("nc"), percent)), labels, "a", "src"), labels, "c", "dst")
    labels = _merged(scratch, labels, centres.select("src", "dst"))
    while True:
        partners = scratch.keep(_partners(differing, labels, percent))
        if partners.isEmpty():
            scratch.drop(partners, differing)
            return labels
        labels = _merged(scratch, labels, partners.select(F.col("component").alias("src"), F.explode(F.array("low", "high")).alias("dst")))
        scratch.drop(partners)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``; other columns are not read.

    Returns one row per row of ``docs``: doc_id, n_shingles, sid (id of its set),
    component_id (smallest doc_id that links reach, itself included), kept.
    Links: ``100 * intersection >= percent * union`` of the word-shingle sets.
    Null and empty texts and texts without words have an empty set and no links.
    Texts of any length are taken whole; the set of one text must fit a task.
    Repeated rows are linked as equal texts are, and all of them have the same
    values. A null doc_id takes part like any other but is never a component_id,
    unless it is alone. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.keep(sketches(docs, shingle, bands, rows))
    total = sketched.count()
    filled = sketched.where("n_shingles > 0")
    classes = scratch.keep(filled.groupBy("sid").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")))
    reps = classes.select(F.col("sid").alias("_sid"), "rep")
    one = filled.join(reps, (F.col("sid") == F.col("_sid")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("sid", "bands").dropDuplicates(["sid"])
    dealt = scratch.keep(one.select("sid", F.explode("bands").alias("bucket")))
    everything = dealt.count()
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = shared.withColumn("size", F.col("n"))
    own = Window.partitionBy("sid")  # a class has no more rows than there are bands
    ranked = scratch.keep(join_dealt(dealt, sizes, "bucket", everything).withColumn("rank", F.struct(F.sum("size").over(own).alias("crowd"), "sid")))
    scratch.drop(dealt)
    tops = ranked.groupBy("bucket").agg(F.count("*").alias("n"), F.max("rank").alias("top"))
    members = scratch.keep(join_dealt(ranked, tops, "bucket", everything).select("sid", F.col("top.sid").alias("centre"), F.max("top").over(own)["sid"].alias("hub")).distinct())
    scratch.drop(ranked)
    wanted = members.select("sid").distinct()
    ids = wanted.join(classes, "sid").select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(ids.hint("merge"), texts.doc_id.eqNullSafe(ids.rep), "left_semi")  # a broadcast would grow with the data
    sets = scratch.keep(_full_sets(texts, shingle).join(wanted.hint("merge"), "sid", "left_semi").dropDuplicates(["sid"]))
    labels = _linked(scratch, sets, members, percent)
    scratch.drop(sets, members)
    named = _named(classes, labels, "sid", "component")
    least = named.groupBy("component").agg(F.count("*").alias("n"), F.min("rep").alias("component_id"))
    of_class = scratch.keep(join_dealt(named, least, "component", total).select("sid", "n", "component_id"))
    scratch.drop(classes, labels)
    alone = sketched.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).drop("bands")
    found = join_dealt(filled.drop("bands"), of_class, "sid", total).unionByName(alone)
    return found.select("doc_id", "n_shingles", "sid", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component of :func:`near_duplicates`.

    Keeps exactly the columns of ``docs``. Of rows with equal doc_id and text one
    stays. Rows with a null doc_id can't be told apart by it, so all of them stay;
    so do all documents without words.
    """
    found = near_duplicates(docs, **options).where("doc_id IS NOT NULL")
    marks = Scratch(docs.sparkSession).keep(found.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or("kept").alias("__kept"), F.count("*").alias("__n")).where("NOT __kept OR __n > 1"))
    rows, text = packed(docs, "doc_id"), F.col(f"row.c{docs.columns.index('text')}")
    marked = rows.join(marks, F.col("doc_id").cast("long") == F.col("__id"), "left")
    once = marked.where("__id IS NULL").select("row")
    repeated = marked.where("__kept").withColumn("text", text).dropDuplicates(["doc_id", "text"]).select("row")
    return once.unionByName(repeated).select(*unpacked(docs.columns))
