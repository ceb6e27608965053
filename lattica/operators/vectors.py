"""Vectors: exact neighbours of a set of queries, mixing of batches, centroids, kernel and subspace statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio, squared_distance
from ..session import checkpointed
from .embedding import vocabulary
from .quantiles import medians

#: Vectors and queries that meet in one task, at most about, and how many of its queries, and pairs, are compared at once.
TILE_VECTORS, TILE_QUERIES, BLOCK_QUERIES, BLOCK_PAIRS = 65_536, 65_536, 1024, 1 << 20
#: Components of either that meet in one task, at most about: of wide vectors fewer meet.
TILE_VALUES = 1 << 22
#: A group's vectors, and its queries, are dealt into so many tiles, if each of them gets ``PART_VECTORS``, or into more where they don't fit.
PARTS, PART_VECTORS = 12, 8_192


class _Distances:
    """Squared distances of the rows of a tile, all of them roughly by products of matrices, those of chosen pairs exactly.

    Rows are taken from their middle and scaled to lengths of 1 at most, so that the rough ones, times ``scale``, are within ``error[dtype]`` of the true ones.
    A row that isn't finite can be anywhere, and is farther than the others.
    """

    def __init__(self, v: np.ndarray, w: np.ndarray):
        self.v, self.w, width = v, w, v.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            lengths = [np.einsum("ij,ij->i", x, x) for x in (v, w)]
            self.far = [~np.isfinite(x) for x in lengths]
            known = [x[~f] for x, f in zip((v, w), self.far, strict=True)] if any(f.any() for f in self.far) else [v, w]
            self.middle = known[1].mean(0) if len(known[1]) else np.zeros(width)
            self.scale = self._longest(known)
        if not np.isfinite(self.scale):
            self.middle = np.zeros(width)
            self.scale = self._longest(known)
        self.scale = self.scale or 1.0
        smallest = np.finfo(float).smallest_subnormal / self.scale  # of squares that underflow
        rounding = np.finfo(float).eps * max(x[~f].max(initial=0.0) for x, f in zip(lengths, self.far, strict=True)) / self.scale + smallest
        self.error = {t: 8.0 * (width + 8) * (np.finfo(t).eps + rounding) for t in (np.float32, np.float64)}
        self.rows = max(1, TILE_VALUES // 4 // max(1, width))

    def _longest(self, known: list[np.ndarray]) -> float:
        step = 4096
        parts = (x[lo : lo + step] - self.middle for x in known for lo in range(0, len(x), step))
        return max((float(np.einsum("ij,ij->i", x, x).max()) for x in parts), default=0.0)

    def _placed(self, end: int, lo: int, hi: int, dtype) -> tuple[np.ndarray, np.ndarray]:
        x, far = (self.v, self.w)[end][lo:hi], self.far[end][lo:hi]
        with np.errstate(invalid="ignore"):
            x = (x - self.middle) / np.sqrt(self.scale)
        x[far] = 0.0
        ends = np.where(far, np.inf, np.einsum("ij,ij->i", x, x)), np.ones(len(x))
        return np.column_stack([x, *ends] if end else [-2.0 * x, *ends[::-1]]).astype(dtype, copy=False)

    def rough(self, at: tuple[int, int], to: tuple[int, int], dtype) -> np.ndarray:
        """The lengths of both go through the product, too."""
        return self._placed(0, *at, dtype) @ self._placed(1, *to, dtype).T

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sums of squared differences in the order of the components."""
        d2 = np.zeros(len(i))
        with np.errstate(over="ignore", invalid="ignore"):
            for lo in range(0, len(i), self.rows):
                part = self.v[i[lo : lo + self.rows]] - self.w[j[lo : lo + self.rows]]
                part *= part
                for x in np.ascontiguousarray(part.T):
                    d2[lo : lo + self.rows] += x
        return d2


def _kth(i: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``k``th least value of each of ``n`` rows, infinite where there are fewer (or it isn't a number)."""
    order = np.lexsort((value, i))
    first = np.searchsorted(i[order], np.arange(n + 1))
    out, enough = np.full(n, np.inf), np.flatnonzero(np.diff(first) >= k)
    out[enough] = value[order[first[enough] + k - 1]]
    return np.where(np.isnan(out), np.inf, out)


def _nearest_of_tile(v: np.ndarray, w: np.ndarray, vid: np.ndarray, wid: np.ndarray, vkey: np.ndarray, wkey: np.ndarray, k: int):
    """``(row of v, row of w, d2, tie)`` of the ``k`` nearest rows of ``w`` of each row of ``v``, by distance, tie and id; a row itself has distance -1.

    Distances are sums of squared differences in the order of the components. Every pair's is told roughly, in single precision, and exactly where it may be among the ``k`` least. Where single precision
    leaves too many, double precision takes over. However many copies a vector has, and so pairs are near, about ``BLOCK_PAIRS`` are held at once.
    """
    tile, dtype = _Distances(v, w), np.float32
    block = min(BLOCK_QUERIES, max(1, tile.rows))
    columns = max(1, min(BLOCK_PAIRS // block, tile.rows))
    by_id = np.argsort(wid, kind="stable")
    same = [np.searchsorted(wid[by_id], vid, side) for side in ("left", "right")]
    for lo in range(0, len(vid), block):
        hi = min(lo + block, len(vid))
        n, copies = hi - lo, same[1][lo:hi] - same[0][lo:hi]
        own_i = np.repeat(np.arange(n), copies)
        own_j = by_id[np.repeat(same[0][lo:hi] - np.cumsum(copies) + copies, copies) + np.arange(len(own_i))]
        own_i, own_j = own_i[np.argsort(own_j, kind="stable")], np.sort(own_j)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        bound, held = np.full(n, np.inf), []

        def settled(best, held, lo=lo):
            """The ``k`` nearest of those known and those held, exactly."""
            i, j = (np.concatenate([x[e] for x in held]) if held else np.zeros(0, np.int64) for e in (0, 1))
            d2 = tile.exact(i + lo, j)
            tie = (vkey[i + lo] ^ (wkey[j] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            tie = ((tie ^ (tie >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)).view(np.int64)
            own = vid[i + lo] == wid[j]
            new = (i, j, np.where(own, -1.0, d2), np.where(own, np.iinfo(np.int64).min, tie))
            i, j, d2, tie = (np.concatenate(x) for x in zip(best, new, strict=True))
            order = np.lexsort((wid[j], tie, d2, i))
            order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
            return i[order], j[order], d2[order], tie[order]

        for at in range(0, len(wid), columns):
            to = min(at + columns, len(wid))
            own = slice(*np.searchsorted(own_j, (at, to)))
            near = None
            while near is None:
                near = tile.rough((lo, hi), (at, to), dtype)
                near[own_i[own], own_j[own] - at] = -np.inf
                if k <= to - at and not np.isfinite(bound).all():
                    bound = np.minimum(bound, np.partition(near, k - 1, 1)[:, k - 1].astype(float) + tile.error[dtype])
                may = near <= np.nextafter((bound + tile.error[dtype]).astype(dtype), dtype(np.inf))[:, None]
                if dtype is np.float32 and np.count_nonzero(may) > 1000 + may.size // 16 and at + columns < len(wid):
                    best, held, dtype, near, bound = settled(best, held), [], np.float64, None, np.full(n, np.inf)
            i, j = np.divmod(np.flatnonzero(may), to - at)
            held.append((i, j + at, near[i, j].astype(float)))
            many = 4 * n * k
            if sum(len(x[0]) for x in held) > many:
                i, j, rough = (np.concatenate(x) for x in zip(*held, strict=True))
                bound = np.minimum(bound, _kth(i, rough, n, k) + tile.error[dtype])
                keep = rough <= bound[i] + tile.error[dtype]
                held = [(i[keep], j[keep], rough[keep])]
                if np.count_nonzero(keep) > many:
                    best, held = settled(best, held), []
                    bound = np.minimum(bound, _kth(best[0], best[2], n, k) / tile.scale + np.finfo(float).eps)
        i, j, d2, tie = settled(best, held)
        yield i + lo, j, d2, tie


def _nearest_in_groups(vectors: DataFrame, queries: DataFrame, k: int, seed: int | None) -> DataFrame:
    """``(src, dst, d2, rank)``: the ``k`` nearest of ``vectors(id, vector, _g)`` of each of ``queries(id, vector, _g)``, which may lie in several groups ``_g``, in any of its own.

    A group is a grid of tiles: its vectors are dealt into rows of bounded size and its queries into columns, in rows and in components. A tile is one task's, gives ``k``
    rows a query, and these are ranked. There are two tasks for a full tile, whatever a shuffle has, so that what a task holds does not grow. Ties in distance go by a hash of seed and both ids, or by the id where ``seed`` is None.
    """
    vectors, queries = vectors.where("vector IS NOT NULL"), queries.where("vector IS NOT NULL")
    n, m, wide = F.col("_n"), F.col("_m"), F.col("_w") / TILE_VALUES
    columns = F.greatest(F.ceil(m / TILE_QUERIES), F.ceil(m * wide), F.least(F.lit(PARTS).cast("long"), F.ceil(m / PART_VECTORS)))
    parts = F.greatest(F.ceil(n / TILE_VECTORS), F.ceil(n * wide), F.when(columns < PARTS, F.least(F.lit(PARTS).cast("long"), F.ceil(n / PART_VECTORS))).otherwise(1))  # each adds ``k`` rows a query
    sizes = vectors.groupBy("_g").agg(F.count("*").alias("_n"), F.max(F.size("vector")).alias("_w")).join(queries.groupBy("_g").agg(F.count("*").alias("_m")), "_g")
    sizes = sizes.select("_g", n, m, wide.alias("_wide"), parts.alias("_rows"), columns.alias("_columns"))
    sizes = checkpointed(sizes)  # a row for each group
    sent = n * F.col("_columns") + m * F.col("_rows")
    full = F.greatest(F.sum(sent) / PART_VECTORS, F.sum(sent * F.col("_wide")))
    tasks = 2 * max(1, sizes.select(F.ceil(F.least(F.sum(F.col("_rows") * F.col("_columns")), full)).alias("tiles")).first().tiles or 0)
    key = F.lit(0).cast("long") if seed is None else F.xxhash64(F.lit(seed), "id")
    dealt = lambda size: F.pmod(F.xxhash64(F.lit(-1), "id"), F.col(size))
    every = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1))
    own = lambda df, r, c: df.join(F.broadcast(sizes), "_g").select(*(F.col(x).alias(x) for x in ("_g", "id", "vector")), key.alias("key"), r.alias("_r"), c.alias("_c"))
    left, right = own(queries, every("_rows"), dealt("_columns")), own(vectors, dealt("_rows"), every("_columns"))
    schema = f"src {queries.schema['id'].dataType.simpleString()}, dst {vectors.schema['id'].dataType.simpleString()}, d2 double, tie long"

    def best(own: pa.Table, others: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and others.num_rows:
            both = [np.asarray(t["vector"].combine_chunks().flatten(), float).reshape(t.num_rows, -1) for t in (own, others)]
            ids = np.unique(np.concatenate([t["id"].to_numpy() for t in (own, others)]), return_inverse=True)[1]
            keys = [t["key"].to_numpy().view(np.uint64) for t in (own, others)]
            found = list(_nearest_of_tile(both.pop(0), both.pop(), ids[: own.num_rows], ids[own.num_rows :], *keys, k))
        i, j, d2, tie = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        tie = tie if seed is not None else np.where(d2 < 0, np.iinfo(np.int64).min, 0)
        return pa.table([own["id"].take(pa.array(i)), others["id"].take(pa.array(j)), pa.array(d2, pa.float64()), pa.array(tie, pa.int64())], ["src", "dst", "d2", "tie"])

    at = ["_g", "_r", "_c"]
    left, right = (df.repartition(tasks, *at).groupBy(*at) for df in (left, right))
    near = left.cogroup(right).applyInArrow(best, schema)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2", "tie", "dst"))).where(F.col("rank") <= k)
    return checkpointed(ranked.select("src", "dst", F.greatest("d2", F.lit(0.0)).alias("d2"), "rank"))


def vector_knn(vectors: DataFrame, queries: DataFrame, k: int, seed: int = 0, by: str | None = None, ties: str = "hash") -> DataFrame:
    """The ``k`` nearest vectors of each query, itself first: ``(src, dst, d2, rank)``.

    Exact: a stated set of queries goes against all rows (of its own group, with ``by``), in tiles of bounded size. Ties go by a hash that differs
    from query to query, so that they follow neither ids nor storage order, or with ``ties="id"`` by the id. Vectors have one width; rows without one are left out.
    """
    group = (F.col(by) if by else F.lit(0)).alias("_g")
    return _nearest_in_groups(vectors.select("id", "vector", group), queries.select("id", "vector", group), k, None if ties == "id" else seed)


def inverse_simpson(edges: DataFrame, batches: DataFrame) -> DataFrame:
    """``(id, simpson)``: 1 / sum of squared batch shares among each point's neighbours, itself included."""
    n = edges.join(batches.select(F.col("id").alias("dst"), "batch"), "dst").groupBy("src", "batch").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("src"))
    return n.select("src", share.alias("p")).groupBy(F.col("src").alias("id")).agg((1.0 / F.sum(F.col("p") * F.col("p"))).alias("simpson"))


def _perplexity_simpson(distance: np.ndarray, batch: np.ndarray, perplexity: float) -> np.ndarray:
    """Inverse Simpson index of batches of each row of neighbours, under Gaussian weights of the given perplexity, found by bisection.

    Absent neighbours have an infinite distance. ``batch`` holds small numbers.
    """
    d = distance - distance.min(1, keepdims=True)
    n = len(d)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(60):
        p = np.exp(-d * beta[:, None])
        p /= p.sum(1, keepdims=True)
        h = -(p * np.log(np.where(p > 0, p, 1.0))).sum(1)
        flat, near = h > np.log(perplexity), np.abs(h - np.log(perplexity)) < 1e-7
        low, high = np.where(flat & ~near, beta, low), np.where(~flat & ~near, beta, high)
        beta = np.where(near, beta, np.where(np.isinf(high), beta * 2, (low + np.where(np.isinf(high), 0.0, high)) / 2))
    sums = np.zeros((n, int(batch.max()) + 1))
    np.add.at(sums, (np.arange(n)[:, None], batch), p)
    return 1.0 / (sums**2).sum(1)


def ilisi(edges: DataFrame, batches: DataFrame, k: int) -> DataFrame:
    """``(id, ilisi)``: like :func:`inverse_simpson` with weights of perplexity k // 3 (2 at least).

    A neighbourhood is one row with its at most k + 1 distances and batches; many go through one Arrow batch.
    """
    rows = edges.join(batches.select(F.col("id").alias("dst"), F.col("batch").cast("string").alias("batch")), "dst")
    rows = rows.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.sqrt("d2").alias("d"), "batch"))).alias("near"))
    rows = rows.select("id", F.transform("near", lambda x: x["d"]).alias("d"), F.transform("near", lambda x: x["batch"]).alias("batch"))

    def index(frames):
        for frame in frames:
            if not len(frame):
                continue
            sizes, top = frame["d"].map(len).to_numpy(), int(frame["d"].map(len).max())
            distance, batch = np.full((len(frame), top), np.inf), np.zeros((len(frame), top), np.int64)
            filled = np.arange(top) < sizes[:, None]
            distance[filled] = np.concatenate(frame["d"].to_list())
            batch[filled] = np.unique(np.concatenate(frame["batch"].to_list()).astype(str), return_inverse=True)[1]
            yield pd.DataFrame({"id": frame["id"], "ilisi": _perplexity_simpson(distance, batch, max(2, k // 3))})

    return rows.mapInPandas(index, "id long, ilisi double")


def scaled_median(scores: DataFrame, score: str, n_batches: int) -> DataFrame:
    """``(median - 1) / (B - 1)``, from 0 (batches apart) to 1."""
    return medians(scores, [], score).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("median") - 1.0) / (n_batches - 1.0))).alias("scaled"))


def tie_statistics(vectors: DataFrame, k: int) -> DataFrame:
    """Rows, distinct vectors, the largest group of equal ones, share of tied rows, share in groups larger than ``k``."""
    groups = vectors.groupBy("vector").agg(F.count("*").alias("n"))
    n = F.sum("n").cast("double")
    return groups.agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.max("n").alias("largest"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / n).alias("tied_share"), (F.sum(F.when(F.col("n") > k, F.col("n")).otherwise(0)) / n).alias("beyond_k_share"))


def knn_vote(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, label)``: the most frequent label among neighbours other than oneself, ties to the least."""
    n = edges.where("src <> dst").join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label"))).alias("label"))


def balanced_accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean over true labels of the share predicted right."""
    both = truth.join(predicted.withColumnRenamed("label", "guess"), "id")
    return both.groupBy("label").agg(F.avg((F.col("label") == F.col("guess")).cast("double")).alias("recall")).agg(F.avg("recall").alias("balanced_accuracy"), F.count("*").alias("n_classes"))


def centroids(vectors: DataFrame, label: str, width: int) -> DataFrame:
    """``(label, centroid)``: component-wise means."""
    return vectors.groupBy(label).agg(F.array(*(F.avg(F.col("vector")[k]) for k in range(width))).alias("centroid"))


def nearest_centroid(vectors: DataFrame, centres: DataFrame, label: str) -> DataFrame:
    """``(id, label, d2)``: the nearest centre of each vector, ties to the least label. All centres count; Spark broadcasts them where they are few."""
    near = vectors.select("id", "vector").join(centres, F.lit(True)).withColumn("d2", squared_distance(F.col("vector"), F.col("centroid")))
    return near.groupBy("id").agg(F.min(F.struct("d2", label)).alias("b")).select("id", F.col(f"b.{label}").alias(label), F.col("b.d2").alias("d2"))


#: Rows of a tile: two tiles make one matrix of distances, in strips.
TILE_ROWS = 2048
#: Tiles of a stack, at most about; two stacks meet in one task. Few tiles make ``STACKS`` stacks, if there are as many.
STACK_TILES, STACKS = 16, 12


def _plain_kernel_sum(x: np.ndarray, y: np.ndarray, sigma: float) -> float:
    """The sum of ``exp(-L1^2 / (2 sigma^2))`` over all pairs of rows, in double precision, of strips of ``x`` that stay in a processor's cache."""
    total, strip, y = 0.0, 32, np.ascontiguousarray(y.T)
    for lo in range(0, len(x), strip):
        part = x[lo : lo + strip].T
        d, step = np.zeros((part.shape[1], y.shape[1])), np.empty((part.shape[1], y.shape[1]))
        for a, b in zip(part, y, strict=True):
            np.subtract(a[:, None], b[None], out=step)
            np.abs(step, out=step)
            d += step
        total += float(np.exp(-d * d / (2.0 * sigma * sigma)).sum())
    return total


def _precise_from(error: float, sigma: float, most: float = 1e-14) -> float:
    """The least distance from which one known within ``error`` gives its kernel within ``most``."""
    low, high = sigma + error, 40.0 * sigma + error
    for _ in range(60):
        at = (low + high) / 2.0
        off = error * (at + error) / sigma**2 * np.exp(-((at - error) ** 2) / (2.0 * sigma * sigma))
        low, high = (at, high) if off > most else (low, at)
    return high


def _l1_kernel_sum(x: np.ndarray, y: np.ndarray, sigma: float) -> float:
    """The sum of ``exp(-L1^2 / (2 sigma^2))`` over all pairs of rows, each within 1e-14.

    A distance is the sums of both rows, less twice that of the lesser components, in single precision. Pairs so near that its rounding error would show are told again in double precision.
    """
    width, middle = x.shape[1], y.mean(0)
    x, y, before = x - middle, y - middle, max(np.abs(x).sum(1).max(), np.abs(y).sum(1).max())
    sums = [z.sum(1) for z in (x, y)]
    largest = max(np.abs(z).sum(1).max() for z in (x, y))
    error = 4.0 * (width + 8) * (np.finfo(np.float32).eps * largest + np.finfo(float).eps * before)
    if not error < sigma or largest > 1e30:
        return _plain_kernel_sum(x, y, sigma)
    precise, across = _precise_from(error, sigma), max(1, min(8192 // width, len(y)))
    padded = np.zeros((-(-len(y) // across) * across, width), np.float32)
    padded[: len(y)] = y
    wide, lesser, total, strip = padded.reshape(-1, across * width), np.empty_like(padded), 0.0, 64
    for lo in range(0, len(x), strip):
        part = x[lo : lo + strip]
        rows, d = np.tile(part.astype(np.float32), (1, across)), np.empty((len(part), len(padded)), np.float32)
        for row, out in zip(rows, d, strict=True):
            np.minimum(wide, row, out=lesser.reshape(wide.shape))
            np.einsum("ij->i", lesser, out=out)
        d = np.ascontiguousarray(d[:, : len(y)])
        d *= -2.0
        d += sums[0][lo : lo + strip, None].astype(np.float32)
        d += sums[1].astype(np.float32)
        i, j = np.divmod(np.flatnonzero(d.ravel() < precise), len(y))
        if len(i) > d.size // 16:
            total += _plain_kernel_sum(part, y, sigma)
            continue
        d[i, j] = np.inf
        d *= d
        d *= np.float32(-0.5 / (sigma * sigma))
        total += float(np.exp(d, out=d).sum(dtype=float))
        near = np.abs(part[i] - y[j]).sum(1)
        total += float(np.exp(-near * near / (2.0 * sigma * sigma)).sum())
    return total


def _kernel_means(sets: DataFrame, sigma: float) -> DataFrame:
    """``(a, b, m)`` with ``a <= b``: the mean of ``exp(-L1^2 / (2 sigma^2))`` over all pairs of rows of two sets of ``sets(batch, vector)``.

    All pairs are what is asked. Rows are dealt at random into tiles (like rows are spread), once and stored, and tiles into stacks. A pair of stacks, once, is one task's,
    which gives one number for each pair of batches; so a row is sent to as many tasks as there are stacks, not tiles.
    """
    tiles = -(-sets.count() // TILE_ROWS)
    if not tiles:
        return sets.select(F.col("batch").alias("a"), F.col("batch").alias("b"), F.lit(0.0).alias("m"))
    stacks = max(min(tiles, STACKS), -(-tiles // STACK_TILES))
    dealt = sets.withColumn("_t", F.floor(F.rand(7) * tiles)).groupBy("batch", "_t").agg(F.flatten(F.collect_list("vector")).alias("v"), F.count("*").alias("n"))
    numbered = checkpointed(dealt.withColumn("s", F.pmod("_t", F.lit(stacks))).withColumn("t", F.concat_ws(":", F.lpad(F.col("_t").cast("string"), 12, "0"), F.col("batch").cast("string"))).drop("_t"))
    last = F.lit(stacks - 1).cast("long")
    left = numbered.select(F.col("batch").alias("ba"), F.col("v").alias("va"), F.col("n").alias("na"), F.col("t").alias("ta"), F.col("s").alias("i"), F.explode(F.sequence(F.col("s"), last)).alias("j"))
    right = numbered.select(F.col("batch").alias("bb"), F.col("v").alias("vb"), F.col("n").alias("nb"), F.col("t").alias("tb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s"))).alias("i"), F.col("s").alias("j"))

    def add(x: pa.Table, y: pa.Table) -> pa.Table:
        def matrices(t, end):
            return [(b, name, np.asarray(v.values, float).reshape(n, -1)) for b, name, v, n in zip(t[f"b{end}"].to_pylist(), t[f"t{end}"].to_pylist(), t[f"v{end}"], t[f"n{end}"].to_pylist(), strict=True)]

        own, others, found = matrices(x, "a"), matrices(y, "b"), {}
        one = x.num_rows and y.num_rows and x["i"][0].as_py() == x["j"][0].as_py()  # a stack and itself: each pair of tiles once
        for a, ta, v in own:
            for b, tb, w in others:
                if one and ta > tb:
                    continue
                both = 1 if ta == tb or a != b else 2
                sums = found.setdefault((min(a, b), max(a, b)), [0.0, 0])
                sums[0] += both * _l1_kernel_sum(v, w, sigma)
                sums[1] += both * len(v) * len(w)
        keys = [pa.array([k[e] for k in found], x.schema.field("ba").type) for e in (0, 1)]
        return pa.table([*keys, pa.array([s for s, _ in found.values()], pa.float64()), pa.array([c for _, c in found.values()], pa.int64())], ["a", "b", "s", "c"])

    kind = sets.schema["batch"].dataType.simpleString()
    sums = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(add, f"a {kind}, b {kind}, s double, c long")
    return sums.groupBy("a", "b").agg((F.sum("s") / F.sum("c")).alias("m"))


def mmd_l1(a: DataFrame, b: DataFrame, sigma: float = 1.0) -> DataFrame:
    """Maximum mean discrepancy of two sets of vectors, kernel ``exp(-L1^2 / (2 sigma^2))``, diagonal included; null if one is empty.

    A mean over all pairs of rows is what is asked; sets are the samples that the caller states.
    """
    means = _kernel_means(a.select(F.lit(0).alias("batch"), "vector").unionByName(b.select(F.lit(1).alias("batch"), "vector")), sigma)
    part = lambda x, y: F.max(F.when((F.col("a") == x) & (F.col("b") == y), F.col("m")))
    return means.agg((part(0, 0) + part(1, 1) - 2.0 * part(0, 1)).alias("mmd"))


def mmd_between_batches(df: DataFrame, sigma: float = 1.0, most: int = 2000, seed: int = 0) -> DataFrame:
    """``(a, b, mmd)`` for each pair of batches of ``df(id, batch, vector)``, of samples of at most ``most`` rows of each: those of the least hashes of seed and id.

    Every sample meets every other once, so the figures of all pairs share their kernels of one batch.
    """
    order = Window.partitionBy("batch").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), "id")
    sample = df.where(F.col("batch").isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("batch", "vector")
    means = _kernel_means(sample, sigma)
    own = means.where("a = b")
    pairs = means.where("a <> b").withColumnRenamed("m", "ab").join(own.select("a", F.col("m").alias("aa")), "a").join(own.select("b", F.col("m").alias("bb")), "b")
    return pairs.select("a", "b", (F.col("aa") + F.col("bb") - 2.0 * F.col("ab")).alias("mmd"))


def product_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, j, v)``: sums over the rows of the products of all components, less their means, of some array columns, laid end to end, and of a 1 after them.

    A first pass takes the means; in the second each Arrow batch gives one matrix, added up by cell. Rows with a null column are left out; the columns have fixed widths.
    """
    rows = df.select(*columns).dropna()

    def matrix(batch, parts=columns):
        return np.hstack([np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) for c in parts])

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                z = matrix(batch)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([z.mean(0)], pa.list_(pa.float64()))], ["n", "mean"])

    means = rows.mapInArrow(first, "n long, mean array<double>").select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("m")).orderBy("i").collect()  # a row for each component
    centre = np.array([r.m for r in means])

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([matrix(batch) - centre, np.ones((batch.num_rows, 1))])
                i, j = np.indices((z.shape[1], z.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array((z.T @ z).ravel())], ["i", "j", "v"])

    return rows.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def linear_cka(df: DataFrame, x: str, y: str, dx: int, dy: int) -> DataFrame:
    """Linear centred kernel alignment of two array columns of the same rows, of ``dx`` and ``dy`` components, from one pass of product sums."""
    sums = product_sums(df, [x, y])
    ones = sums.where(F.col("j") == dx + dy).select("i", F.col("v").alias("s"))
    n = ones.where(F.col("i") == dx + dy).select(F.col("s").alias("n"))
    cells = sums.where((F.col("i") < dx + dy) & (F.col("j") < dx + dy)).join(ones, "i").join(ones.toDF("j", "t"), "j").join(F.broadcast(n), F.lit(True))  # a row for each pair of components
    c = F.col("v") - F.col("s") * F.col("t") / F.col("n")
    part = lambda rows, cols: F.sum(F.when(rows & cols, c * c).otherwise(0.0))
    in_x = lambda k: F.col(k) < dx
    return cells.agg(ratio(part(in_x("i"), ~in_x("j")), F.sqrt(part(in_x("i"), in_x("j")) * part(~in_x("i"), ~in_x("j")))).alias("cka"))


#: Rows on which the cells of an index are fitted, at most.
INDEX_SAMPLE = 50_000


def cell_index(vectors: DataFrame, cells: int, seed: int = 1) -> DataFrame:
    """``(cell, centroid)`` of an inverted index: k-means on at most ``INDEX_SAMPLE`` rows, those of the least hashes; at most ``cells`` rows."""
    sample = vectors.select("id", "vector").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(INDEX_SAMPLE)
    return vocabulary(sample, "vector", cells, seed).withColumnRenamed("token", "cell")


def approximate_knn(vectors: DataFrame, queries: DataFrame, k: int, *, cells: int = 64, probes: int = 8, seed: int = 1) -> DataFrame:
    """About the ``k`` nearest vectors of each query, itself first: ``(src, dst, d2, rank)``.

    Every row is in the index, under its nearest cell; a query looks into the ``probes`` cells nearest to it, and ranks what it finds exactly. More
    probes find more of the true neighbours; with all cells probed the result is exact. A query finds fewer than ``k`` where its cells hold fewer.
    """
    centres = F.broadcast(cell_index(vectors, cells, seed).agg(F.collect_list(F.struct("cell", "centroid")).alias("centres")))  # ``cells`` rows
    near = F.sort_array(F.transform("centres", lambda c: F.struct(squared_distance(c["centroid"], F.col("vector")).alias("d"), c["cell"].alias("cell"))))
    placed = vectors.select("id", "vector").join(centres, F.lit(True)).select("id", "vector", near[0]["cell"].alias("_g"))
    asked = queries.select("id", "vector").join(centres, F.lit(True)).select("id", "vector", F.explode(F.transform(F.slice(near, 1, probes), lambda c: c["cell"])).alias("_g"))
    return _nearest_in_groups(placed, asked, k, seed)
