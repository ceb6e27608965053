"""Neighbourhood-augmented features, batch correction, and genes of high variance over batches."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..session import Tables
from .spatial import knn_join

# neighbourhood-augmented features


def neighbour_weights(edges: DataFrame, points: DataFrame, order: int) -> DataFrame:
    """``(src, dst, w, re, im)``: weights ``exp(-(d / median d)**2)`` of each point's neighbours, which add up to 1, and their harmonics ``w * exp(i * order * angle)``.

    The angle is that of the neighbour as seen from the point. Where the median distance is 0 all neighbours weigh the same.
    """
    at = points.select("section_id", "id", "x", "y")
    ends = edges.join(at.withColumnsRenamed({"id": "src", "x": "ax", "y": "ay"}), ["section_id", "src"]).join(at.withColumnsRenamed({"id": "dst", "x": "bx", "y": "by"}), ["section_id", "dst"])
    own = Window.partitionBy("section_id", "src")  # k rows
    d = F.sqrt("d2")
    raw = F.coalesce(F.exp(-ratio(F.col("d2"), F.col("_m") * F.col("_m"))), F.lit(1.0))
    weighed = ends.withColumn("_m", F.median(d).over(own)).withColumn("_w", raw).withColumn("w", F.col("_w") / F.sum("_w").over(own))
    angle = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")) * order
    return weighed.select("src", "dst", "w", (F.col("w") * F.cos(angle)).alias("re"), (F.col("w") * F.sin(angle)).alias("im"))


def banksy_features(points: DataFrame, values: DataFrame, k: int = 15, max_m: int = 1, mix: float = 0.2) -> DataFrame:
    """``(id, m, feature, value)``: each point's own features (m = -1), their weighted mean over its ``k`` neighbours (m = 0), and for m = 1 to ``max_m`` the size of the azimuthal gradient over ``k * (m + 1)``.

    ``points(section_id, id, x, y)``, ids unique over all sections; ``values(id, feature, value)``, absent ones 0. The gradient of order m is ``|sum of w * exp(i m angle) * (value - mean)|``, with the mean under the same weights.
    Every feature is standardised over all points (a flat one is 0) and scaled: own ones by ``sqrt(1 - mix)``, those of order m by ``sqrt(mix * 2**-m / sum of 2**-m)``.
    A point without neighbours has 0 before standardising. One neighbour search serves all orders. A point's values travel as one row of arrays, once to each
    point that sees it, with the weights of all orders; sums of single features are made where a point's rows have met. A point's features are in one row.
    """
    tables = Tables(points.sparkSession)
    ids = points.select("id").distinct()
    edges = tables.keep(knn_join(points, points, k * (max_m + 1)))
    names = [c for m in range(1, max_m + 1) for c in (f"re{m}", f"im{m}")]
    columns, parts = ["own", "w0", *names], []
    for m in range(max_m + 1):
        weights = neighbour_weights(edges.where(F.col("rank") <= k * (m + 1)), points, m)
        if m:  # sums of w * exp(i m angle) * (value - mean) are those of values under weights less their sum
            around = Window.partitionBy("src")
            weights = weights.select("src", "dst", *((F.col(c) - F.col("w") * F.sum(c).over(around)).alias(f"{c}{m}") for c in ("re", "im")))
        else:
            weights = weights.select("src", "dst", F.col("w").alias("w0"))
        parts.append(weights)
    parts.append(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("own")))
    links = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    links = links.groupBy("src", "dst").agg(*(F.sum(c).alias(c) for c in columns))  # null where a pair isn't of an order
    entry = F.struct("feature", F.col("value").cast("double").alias("value"))
    rows = values.groupBy(F.col("id").alias("dst")).agg(F.collect_list(entry).alias("_l")).select("dst", F.col("_l.feature").alias("f"), F.col("_l.value").alias("v"))
    every = values.agg(F.collect_set("feature").alias("f"))  # the features' names
    absent = ids.join(F.broadcast(every), F.lit(True)).select(F.col("id").alias("src"), *(F.lit(0.0).alias(c) for c in columns), "f", F.transform("f", lambda _: F.lit(0.0)).alias("v"))
    met = links.join(rows, "dst").select("src", *columns, "f", "v").unionByName(absent).repartition("src")
    seen = met.select("src", *columns, F.explode(F.arrays_zip("f", "v")).alias("e")).groupBy("src", F.col("e.f").alias("feature"))
    sums = seen.agg(*(F.coalesce(F.sum(F.col(c) * F.col("e.v")), F.lit(0.0)).alias(c) for c in columns))
    size = lambda m: F.sqrt(F.col(f"re{m}") * F.col(f"re{m}") + F.col(f"im{m}") * F.col(f"im{m}"))
    orders = {-1: F.col("own"), 0: F.col("w0")} | {m: size(m) for m in range(1, max_m + 1)}
    full = tables.keep(sums.select(F.col("src").alias("id"), "feature", *(c.alias(f"o{m + 1}") for m, c in orders.items())))
    figures = [f(f"o{m + 1}").alias(f"{n}{m + 1}") for m in orders for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))]
    moments = full.groupBy("feature").agg(*figures)
    total = sum(2.0**-m for m in range(max_m + 1))
    scale = {m: math.sqrt(1 - mix) if m < 0 else math.sqrt(mix / total * 2.0**-m) for m in orders}

    def scaled(m: int) -> Column:
        value, mean, sd = (F.col(f"{n}{m + 1}") for n in ("o", "mean", "sd"))
        return F.struct(F.lit(m).alias("m"), (F.when(sd > 1e-12, (value - mean) / sd).otherwise(0.0) * scale[m]).alias("value"))

    out = full.join(moments, "feature").select("id", "feature", F.explode(F.array(*map(scaled, orders))).alias("e"))
    return out.select("id", F.col("e.m").alias("m"), "feature", F.col("e.value").alias("value"))


# batch correction


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def soft_clusters(z: np.ndarray, batch: np.ndarray, centres: np.ndarray, observed: np.ndarray, shares: np.ndarray, theta: float, sigma: float) -> np.ndarray:
    """Shares of the clusters in each row: closeness on the sphere, times ``((expected + 1) / (observed + 1)) ** theta`` of the row's batch in the cluster."""
    distance = 2 * (1 - _unit(z) @ centres.T)
    scores = -distance / sigma
    scores -= scores.max(1, keepdims=True)
    expected = observed.sum(1)[:, None] * shares[None]
    r = np.exp(scores) * (((expected + 1) / (observed + 1)) ** theta).T[batch]
    return r / r.sum(1, keepdims=True)


def ridge_shifts(observed: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    """``(cluster, batch, component)``: how far each batch lies off its cluster, by ridge regression on batch with a free intercept."""
    k, b, d = sums.shape
    out = np.zeros((k, b, d))
    for i in range(k):
        design = np.zeros((b + 1, b + 1))
        design[0, 0], design[0, 1:], design[1:, 0] = observed[i].sum(), observed[i], observed[i]
        design[1:, 1:] = np.diag(observed[i] + ridge)
        if design[0, 0] > 1e-9:
            out[i] = np.linalg.solve(design, np.vstack([sums[i].sum(0), sums[i]]))[1:]
    return out


def _matrix_sums(rows: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """``partial(vectors, started, batches)``, a matrix for each Arrow batch, added up over all rows; the driver gets its ``shape`` only."""

    def sums(batches):
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += partial(*_arrays(batch))
        i, j = np.indices(shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros(shape)
    for r in rows.select("vector", "now", "b").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    return tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for c in ("vector", "now")) + (batch.column("b").to_numpy(),)


def harmonised(vectors: DataFrame, k: int | None = None, *, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 4, passes: int = 4, seed: int = 1, centres: np.ndarray | None = None) -> DataFrame:
    """``vectors(id, batch, vector)`` with ``corrected``: maximum-diversity soft clustering, and ridge correction of each batch in each cluster.

    A round clusters the rows as they are corrected so far, in ``passes`` over them, and then takes off the original vectors what their batch lies off in their clusters. Each pass
    makes one matrix of sums a task (clusters by batches and components), so rows never meet; a cluster's counts by batch go half way to the new ones, as the penalty
    would swing otherwise. ``k`` clusters (by default a thirtieth of the rows, at most 100) start from k-means, or from ``centres``. Vectors have one width; a null batch is a batch of its own; there are few batches,
    as sums of clusters x batches x components come to the driver. Rows with a null vector are left out. One batch: nothing changes. Empty table: no rows.
    """
    tables = Tables(vectors.sparkSession)
    rows = vectors.where("vector IS NOT NULL").select("id", F.coalesce(F.col("batch").cast("string"), F.lit("")).alias("batch"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    counts = sorted((r["batch"], r["n"]) for r in rows.groupBy("batch").agg(F.count("*").alias("n")).collect())
    n = sum(c for _, c in counts)
    if not n:
        return rows.withColumn("corrected", F.col("vector"))
    code = F.create_map(*(F.lit(x) for i, (name, _) in enumerate(counts) for x in (name, i)))
    state = tables.keep(rows.withColumn("b", code[F.col("batch")]).withColumn("now", F.col("vector")))
    shares, width = np.array([c for _, c in counts]) / n, len(state.select("vector").first()[0])
    k = (k or max(1, min(100, n // 30))) if centres is None else len(centres)
    if centres is None:
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        unit = state.select(array_to_vector(F.transform("vector", lambda x: x / F.greatest(norm, F.lit(1e-12)))).alias("features"))
        centres = np.array([list(c) for c in KMeans(k=k, seed=seed, maxIter=20).fit(unit).clusterCenters()])
    centres, k = _unit(np.asarray(centres, float)), len(centres)
    b = len(counts)
    observed = np.outer(np.full(k, n / k), shares)
    for _ in range(rounds):
        for _ in range(passes):

            def partial(vector, now, batch, centres=centres, observed=observed):
                r = soft_clusters(now, batch, centres, observed, shares, theta, sigma)
                return np.hstack([np.stack([r[batch == i].sum(0) for i in range(b)], 1), r.T @ _unit(now)])

            sums = _matrix_sums(state, partial, (k, b + width))
            observed, centres = (observed + sums[:, :b]) / 2, _unit(sums[:, b:])

        def by_batch(vector, now, batch, centres=centres, observed=observed):
            r = soft_clusters(now, batch, centres, observed, shares, theta, sigma)
            return np.hstack([np.stack([r[batch == i].sum(0) for i in range(b)], 1), *(r[batch == i].T @ vector[batch == i] for i in range(b))])

        sums = _matrix_sums(state, by_batch, (k, b + b * width))
        shifts = ridge_shifts(sums[:, :b], sums[:, b:].reshape(k, b, width), ridge)

        def correct(batches, centres=centres, observed=observed, shifts=shifts):
            for batch in batches:
                if batch.num_rows:
                    vector, now, own = _arrays(batch)
                    r = soft_clusters(now, own, centres, observed, shares, theta, sigma)
                    fixed = vector - np.einsum("nk,nkd->nd", r, shifts.transpose(1, 0, 2)[own])
                    new = pa.ListArray.from_arrays(np.arange(0, fixed.size + 1, width, dtype=np.int32), pa.array(fixed.ravel()))
                    yield pa.RecordBatch.from_arrays([new if c == "now" else batch.column(c) for c in batch.schema.names], batch.schema.names)

        state = tables.keep(state.mapInArrow(correct, state.schema))
    return tables.result(state.select("id", "batch", "vector", F.col("now").alias("corrected")))


# genes of high variance over batches

SPAN = 0.3


def local_quadratic(x: np.ndarray, y: np.ndarray, span: float = SPAN) -> np.ndarray:
    """Fitted values at each ``x``: quadratic least squares on the nearest ``span`` of the points, under tricube weights of their distance. Where all of these lie in one place it is the mean there."""
    n = len(x)
    q = min(n, max(3, math.floor(span * n + 1e-9)))
    out, order = np.empty(n), np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    lo = 0
    for i in range(n):
        while lo + q < n and xs[lo + q] - xs[i] < xs[i] - xs[lo]:
            lo += 1
        d = xs[lo : lo + q] - xs[i]
        h = np.abs(d).max()
        if h <= 0:
            out[order[i]] = ys[xs == xs[i]].mean()
            continue
        w = (1 - np.minimum(1, np.abs(d) / h) ** 3) ** 3
        root = np.sqrt(w)
        design = np.stack([np.ones(q), d / h, (d / h) ** 2], 1)
        out[order[i]] = np.linalg.lstsq(design * root[:, None], ys[lo : lo + q] * root, rcond=1e-9)[0][0]
    return out


def seurat_v3(expr: DataFrame, cells: DataFrame, n_top: int, span: float = SPAN) -> DataFrame:
    """``(gene_id, variance, rank, batches, chosen)``: genes by their variance beyond what their mean suggests, from raw counts, over batches.

    ``expr(cell_id, gene_id, value)`` without zeros, ``cells(cell_id, batch)`` with every cell. In each batch log10 variance follows log10 mean by :func:`local_quadratic`; a second pass clips values at
    ``mean + sd * sqrt(n)``, sd from the fit, and ``variance`` is that of the standardised clipped ones, averaged over the batches. A gene counts in a batch in whose first ``n_top`` it is; rank is the median of its places (from 0) there, and
    genes are chosen by rank, then number of batches (more first), then gene. Equal variances go by gene. Flat genes have variance 0. Genes that no batch holds are absent.
    The curve of a batch is fitted in one task, from a row a gene; everything over cells is a combined aggregate.
    """
    tables = Tables(expr.sparkSession)
    sizes = cells.groupBy("batch").agg(F.count("*").cast("double").alias("n"))
    rows = expr.where("value <> 0").join(cells, "cell_id").select("batch", "gene_id", F.col("value").cast("double").alias("v"))
    genes = rows.select("gene_id").distinct()
    held = rows.groupBy("batch", "gene_id").agg(F.count("*").alias("c"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    held = genes.join(sizes, F.lit(True)).join(held, ["batch", "gene_id"], "left").fillna(0, ["c"]).fillna(0.0, ["m", "s"])  # a row for each gene and batch
    mean = F.col("m") * F.col("c") / F.col("n")
    spread = F.col("c") * F.col("s") + F.col("c") * F.col("m") * F.col("m") * (1 - F.col("c") / F.col("n"))  # of the zeros and the others, about the mean of all
    stats = held.select("batch", "gene_id", "n", mean.alias("mean"), F.coalesce(ratio(spread, F.col("n") - 1), F.lit(0.0)).alias("var"))

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("gene_id", kind="stable")
        varies = (frame["var"] > 0).to_numpy()
        curve = np.zeros(len(frame))
        if varies.any():
            curve[varies] = local_quadratic(np.log10(frame["mean"].to_numpy()[varies]), np.log10(frame["var"].to_numpy()[varies]), span)
        return frame.assign(sd=np.sqrt(10.0**curve))

    schema = stats.withColumn("sd", F.lit(0.0)).schema
    fit = tables.keep(stats.groupBy("batch").applyInPandas(fitted, schema))
    top = F.least(F.col("v"), F.col("mean") + F.col("sd") * F.sqrt("n"))
    clipped = rows.join(fit, ["batch", "gene_id"]).groupBy("batch", "gene_id").agg(F.count("*").alias("c"), F.sum((top - F.col("mean")) * (top - F.col("mean"))).alias("ss"))
    full = fit.join(clipped, ["batch", "gene_id"], "left").fillna(0, ["c"]).fillna(0.0, ["ss"])
    norm = ratio(F.col("ss") + (F.col("n") - F.col("c")) * F.col("mean") * F.col("mean"), (F.col("n") - 1) * F.col("sd") * F.col("sd"))
    scored = full.select("batch", "gene_id", F.round(F.when(F.col("var") > 0, F.coalesce(norm, F.lit(0.0))).otherwise(0.0), 12).alias("variance"))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("variance"), "gene_id")) - 1)  # a row for each gene
    inside = F.when(F.col("place") < n_top, F.col("place"))
    per = placed.groupBy("gene_id").agg(F.avg("variance").alias("variance"), F.median(inside).alias("rank"), F.count(inside).alias("batches"))
    first = per.orderBy(F.col("rank").asc_nulls_last(), F.desc("batches"), "gene_id").limit(n_top).select("gene_id", F.lit(True).alias("chosen"))
    return per.join(first, "gene_id", "left").select("gene_id", "variance", "rank", "batches", F.coalesce("chosen", F.lit(False)).alias("chosen"))
