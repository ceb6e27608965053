"""Normalised expression, its principal components, and vocabularies of profiles."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio


def log_normalised(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """``log1p(value * target / total)`` of each cell; absent values stay absent, as log1p(0) is 0."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.log1p(F.coalesce(ratio(F.col("value") * target, total), F.lit(0.0))))


def size_factors(expr: DataFrame, target: float = 1e4) -> DataFrame:
    """``(cell_id, factor)``: ``target / total``, 1 for cells without counts."""
    return expr.groupBy("cell_id").agg(F.sum("value").alias("t")).select("cell_id", F.coalesce(ratio(F.lit(target), F.col("t")), F.lit(1.0)).alias("factor"))


def dense_profiles(expr: DataFrame, genes: list) -> DataFrame:
    """``(cell_id, vector)`` over a declared list of genes, in its order."""
    wide = expr.groupBy("cell_id").pivot("gene_id", genes).agg(F.sum("value"))
    return wide.select("cell_id", F.array(*(F.coalesce(F.col(f"`{g}`").cast("double"), F.lit(0.0)) for g in genes)).alias("vector"))


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """``vectors`` with ``pc``: the first ``k`` components, fitted on the rows without NaN; rows with NaN have none."""
    valid = ~F.exists("vector", lambda x: F.isnan(x))
    rows = vectors.withColumn("_v", F.when(valid, array_to_vector("vector")))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(rows.where("_v IS NOT NULL"))
    done = model.transform(rows.where("_v IS NOT NULL")).withColumn("pc", vector_to_array("_pc")).drop("_pc")
    rest = rows.where("_v IS NULL").withColumn("pc", F.lit(None).cast("array<double>"))
    return done.unionByName(rest).drop("_v")


def vocabulary(vectors: DataFrame, column: str, k: int, seed: int = 1) -> DataFrame:
    """``(token, centroid)`` of ``k`` clusters: a codebook for :func:`lattica.operators.vectors.nearest_centroid`."""
    rows = vectors.select(array_to_vector(column).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(centres, "token int, centroid array<double>")


def chunk_contexts(ids: DataFrame, chunks: int, seed: int) -> DataFrame:
    """``(id, chunk)``: rows dealt by hash order into chunks of equal size; a chunk's context are the other chunks."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary"))
    return ids.select("id", F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.lit(chunks)).alias("chunk"))


def square_crop(points: DataFrame, section: int, x: float, y: float, side: float) -> DataFrame:
    """The points of a section in a square around a centre, from its lower corner outwards."""
    half = side / 2
    inside = points.where((F.col("section_id") == section) & F.col("x").between(x - half, x + half) & F.col("y").between(y - half, y + half))
    d = (F.col("x") - (x - half)) * (F.col("x") - (x - half)) + (F.col("y") - (y - half)) * (F.col("y") - (y - half))
    return inside.withColumn("place", F.row_number().over(Window.partitionBy("section_id").orderBy(d, "id")))


def diagonal_order(points: DataFrame, seed: int = 0) -> DataFrame:
    """``points`` of each section with ``place``: a cell at the lower left corner first, then a weighted draw without replacement by distance from it.

    The draw orders by ``-ln(u) / distance``, with u from a hash of seed and id; equal places go last by id. A crop is bounded by its square.
    """
    own = Window.partitionBy("section_id")
    corner = (F.col("x") - F.min("x").over(own)) * (F.col("x") - F.min("x").over(own)) + (F.col("y") - F.min("y").over(own)) * (F.col("y") - F.min("y").over(own))
    first = points.withColumn("_f", F.row_number().over(own.orderBy(corner, "id")))
    fx, fy = F.max(F.when(F.col("_f") == 1, F.col("x"))).over(own), F.max(F.when(F.col("_f") == 1, F.col("y"))).over(own)
    far = F.sqrt((F.col("x") - fx) * (F.col("x") - fx) + (F.col("y") - fy) * (F.col("y") - fy))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)
    key = F.when(F.col("_f") == 1, -1.0).otherwise(ratio(-F.ln(u), far))
    return first.withColumn("_k", key).withColumn("place", F.row_number().over(own.orderBy(F.col("_k").asc_nulls_last(), "id"))).select(*points.columns, "place")


def attention_pairs(lengths: DataFrame) -> DataFrame:
    """``(id, row, col)``: what attends to what in a sequence of ``n`` content and ``n`` target places; ``lengths(id, n)``.

    Content place j sees the content up to itself; target place n + i sees the content up to i and the targets up to itself.
    """
    rows = lengths.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    upto = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("i"))))
    seen = F.array(F.struct(F.col("i").alias("row"), F.col("c").alias("col")), F.struct((F.col("n") + F.col("i")).alias("row"), F.col("c").alias("col")), F.struct((F.col("n") + F.col("i")).alias("row"), (F.col("n") + F.col("c")).alias("col")))
    return upto.select("id", F.explode(seen).alias("p")).select("id", F.col("p.row").alias("row"), F.col("p.col").alias("col"))


def leave_chunk_out(values: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(id, feature, predicted)``: each row's features from the mean of all chunks but its own; ``values(id, feature, value)``, ``chunks(id, chunk)``.

    Sums by chunk and feature suffice: no row is joined with the others.
    """
    per = values.join(chunks, "id").groupBy("chunk", "feature").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    all_ = per.groupBy("feature").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    left = per.join(all_, "feature").select("chunk", "feature", ratio(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("predicted"))
    return values.select("id", "feature").join(chunks, "id").join(left, ["chunk", "feature"]).select("id", "feature", "predicted")


def technology_scaled(expr: DataFrame, means: DataFrame) -> DataFrame:
    """Values divided by their gene's mean of the technology; NaN and null count as 0, means are rounded half up and 0 becomes 1."""
    v = F.when(F.isnan("value"), 0.0).otherwise(F.coalesce("value", F.lit(0.0)))
    m = F.floor(F.coalesce(F.nanvl("mean", F.lit(0.0)), F.lit(0.0)) + 0.5)
    return expr.join(means, "gene_id", "left").select("cell_id", "gene_id", (v / F.when(m == 0, 1.0).otherwise(m)).alias("value"))


def neighbour_components(sums: DataFrame, genes: list, k: int) -> DataFrame:
    """``(id, pc)``: components of the log-normalised neighbour sums ``(id, gene_id, value)`` over a declared list of genes."""
    rows = log_normalised(sums.withColumnRenamed("id", "cell_id"))
    return principal_components(dense_profiles(rows, genes).withColumnRenamed("cell_id", "id"), k).select("id", "pc")
