"""How two spaces go together: kernel alignment, canonical correlations, neighbour classifiers, mixing by label."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import squared_distance
from .quantiles import medians
from .vectors import balanced_accuracy, ilisi, knn_vote, linear_cka, product_sums, vector_knn

#: Rows of the sample on which a kernel matrix is made; the pairs of a sample are its square.
KERNEL_ROWS = 2000


def hash_sample(df: DataFrame, id_: str, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows of the least hashes of seed and id: a sampling operator, the same on every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string"))), id_).limit(n)


def rbf_cka(df: DataFrame, x: str, y: str, id_: str = "id", n_sub: int = KERNEL_ROWS, seed: int = 0) -> DataFrame:
    """``cka`` of Gaussian kernels of two array columns, on a sample of ``n_sub`` rows as all its pairs count.

    Each kernel's width comes from the median of the squared distances above 0. Row sums of the kernels, and sums of their products, give
    the centred statistic; no matrix is built. A sample in which a kernel doesn't vary has null.
    """
    sample = hash_sample(df.select(F.col(id_).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")), "id", n_sub, seed)
    packed = F.broadcast(sample.agg(F.collect_list(F.struct("x", "y")).alias("all")))  # n_sub rows
    pairs = sample.join(packed, F.lit(True)).select("id", "x", "y", F.explode("all").alias("o"))
    d2 = pairs.select("id", squared_distance(F.col("x"), F.col("o.x")).alias("dx"), squared_distance(F.col("y"), F.col("o.y")).alias("dy"))
    medians = d2.agg(F.median(F.when(F.col("dx") > 0, F.col("dx"))).alias("mx"), F.median(F.when(F.col("dy") > 0, F.col("dy"))).alias("my"))
    k, m = F.exp(-F.col("dx") / (F.coalesce("mx", F.lit(1.0)) + 1e-12)), F.exp(-F.col("dy") / (F.coalesce("my", F.lit(1.0)) + 1e-12))
    kernels = d2.join(F.broadcast(medians), F.lit(True)).select("id", k.alias("k"), m.alias("m"))
    rows = kernels.groupBy("id").agg(F.sum("k").alias("k"), F.sum("m").alias("m"), F.sum(F.col("k") * F.col("m")).alias("km"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    n = F.count("*").cast("double")

    def centred(a: str, b: str, ab: str):
        return F.sum(ab) - 2.0 / n * F.sum(F.col(a) * F.col(b)) + F.sum(a) * F.sum(b) / (n * n)

    h = rows.agg(centred("k", "m", "km").alias("km"), centred("k", "k", "kk").alias("kk"), centred("m", "m", "mm").alias("mm"))
    return h.select(F.when(F.col("kk") * F.col("mm") > 0, F.col("km") / F.sqrt(F.col("kk") * F.col("mm"))).alias("cka"))


def canonical_correlation(df: DataFrame, x: str, y: str, k: int = 10) -> float:
    """Mean of the ``k`` largest canonical correlations of two array columns of fixed widths; NaN without variation.

    The rows go into one matrix of sums of products; only its small decompositions run on the driver.
    """
    cells = product_sums(df, [x, y]).collect()  # a row for each pair of components
    if not cells:
        return float("nan")
    m = np.zeros((max(r.i for r in cells) + 1,) * 2)
    for r in cells:
        m[r.i, r.j] = r.v
    n = m[-1, -1]
    first = df.select(F.size(x)).where(F.col(x).isNotNull()).first()[0]
    c = m[:-1, :-1] - np.outer(m[:-1, -1], m[-1, :-1]) / n

    def whitener(s: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(s)
        keep = values > values.max() * 1e-12 if values.max() > 0 else np.zeros(len(values), bool)
        return vectors[:, keep] / np.sqrt(values[keep])

    wx, wy = whitener(c[:first, :first]), whitener(c[first:, first:])
    if not wx.shape[1] or not wy.shape[1]:
        return float("nan")
    found = np.linalg.svd(wx.T @ c[:first, first:] @ wy, compute_uv=False)
    return float(np.clip(found[:k], 0.0, 1.0).mean())


def neighbour_classifier(df: DataFrame, vector: str, label: str, *, k: int = 15, n_sub: int | None = None, least: int = 4, seed: int = 0) -> DataFrame:
    """``(balanced_accuracy, n_classes)`` of a vote of ``k`` neighbours, trained on one half of the rows and tried on the other.

    Rows without label go; with ``n_sub`` only a sample of so many rows by hash counts, else all; classes of fewer than ``least`` rows go. Halves are by a second hash.
    Components are scaled by the training half's means and deviations. Fewer than two classes or 50 rows: no row.
    """
    named = df.where(F.col(label).isNotNull() & ~F.trim(F.col(label).cast("string")).isin("", "nan", "None"))
    rows = named.select("id", F.col(vector).alias("vector"), F.col(label).cast("string").alias("label"))
    if n_sub is not None:
        rows = hash_sample(rows, "id", n_sub, seed)
    frequent = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("label")
    rows = rows.join(F.broadcast(frequent), "label", "left_semi").withColumn("half", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + 1), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % 2)
    train = rows.where("half = 0")
    parts = train.select(F.posexplode("vector").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("j", "mu", "sd"))).alias("p"))  # a row for each component
    stats = parts.select(F.transform("p", lambda p: p["mu"]).alias("mu"), F.transform("p", lambda p: p["sd"]).alias("sd"))
    scaled = rows.join(F.broadcast(stats), F.lit(True)).withColumn("vector", F.transform("vector", lambda v, j: (v - F.col("mu")[j]) / (F.col("sd")[j] + 1e-8))).drop("mu", "sd")
    edges = vector_knn(scaled.where("half = 0"), scaled.where("half = 1"), k, ties="id")
    out = balanced_accuracy(knn_vote(edges, scaled.select("id", "label")), scaled.where("half = 1").select("id", "label"))
    enough = rows.agg(F.count("*").alias("n"), F.count_distinct("label").alias("c")).where("n >= 50 AND c >= 2").select(F.lit(True).alias("_ok"))
    return out.join(F.broadcast(enough), F.lit(True)).drop("_ok")


def label_mixing(df: DataFrame, queries: DataFrame, k: int = 90, least: int = 10, ties: str = "hash") -> DataFrame:
    """``(label, n_cells, n_batches, n_queries, score)``: mixing of batches among the neighbours within each label.

    ``df(id, vector, label, batch)``. Labels with fewer than ``least`` rows or two batches aren't scored. Of each row of ``queries`` its
    ``min(k, n - 1)`` nearest of the same label and itself count; ``score`` is the median of their index, scaled to 0 ... 1. ``ties`` as in :func:`vector_knn`.
    """
    sizes = df.groupBy("label").agg(F.count("*").alias("n_cells"), F.count_distinct("batch").alias("n_batches")).where((F.col("n_cells") >= least) & (F.col("n_batches") >= 2))
    own = df.join(sizes.select("label"), "label", "left_semi")
    edges = vector_knn(own, own.join(queries.select("id"), "id", "left_semi"), k + 1, by="label", ties=ties)
    scores = ilisi(edges, own, k).join(own.select("id", "label"), "id")
    per = medians(scores, ["label"], "ilisi").withColumnsRenamed({"median": "m", "n": "n_queries"})
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("m") - 1.0) / (F.col("n_batches") - 1.0)))
    return per.join(sizes, "label").select("label", "n_cells", "n_batches", "n_queries", scaled.alias("score"))


def label_mixing_summary(per_label: DataFrame) -> DataFrame:
    """Mean over cells, plain mean over labels, and the number of labels."""
    weighted = F.sum(F.col("score") * F.col("n_cells")) / F.sum("n_cells")
    return per_label.agg(weighted.alias("cell_weighted"), F.avg("score").alias("plain"), F.count("*").alias("n_labels"))


def coupling_bundle(df: DataFrame, x: str, y: str, label: str, widths: tuple[int, int], n_sub: int = KERNEL_ROWS) -> DataFrame:
    """``(measure, value)``: linear and kernel alignment, canonical correlation, and what neighbours in either space tell of the label."""
    spark = df.sparkSession
    out = linear_cka(df, x, y, *widths).select(F.lit("linear_cka").alias("measure"), F.col("cka").alias("value"))
    out = out.unionByName(rbf_cka(df, x, y, n_sub=n_sub).select(F.lit("rbf_cka").alias("measure"), F.col("cka").alias("value")))
    out = out.unionByName(spark.createDataFrame([("mean_canonical_correlation", canonical_correlation(df, x, y))], "measure string, value double"))
    for name, column in ((f"{label}_from_{x}", x), (f"{label}_from_{y}", y)):
        out = out.unionByName(neighbour_classifier(df, column, label).select(F.lit(name).alias("measure"), F.col("balanced_accuracy").alias("value")))
    return out
