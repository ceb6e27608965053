"""Principal components of standardised sparse values, without a dense table.

Standardising and centring would fill every gap. Here a value is stored as its difference from what an absent one becomes: with ``z0`` the standardised and clipped zero of a gene, a row is ``z0`` plus
a sparse ``d``, and centred it is ``d`` less the mean of ``d``. So nothing but the entries is stored or shuffled. Components come from a randomised range finder with subspace iteration: each round
is one pass over the rows, ``X'(XQ)``, from bounded dense blocks inside the tasks, and gives genes x components; only matrices of that size meet on the driver. Genes are the columns: a panel or a transcriptome.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..session import Tables

#: Numbers of a dense block inside a task.
BLOCK = 4_000_000
OVERSAMPLE, ROUNDS = 10, 6


def standardised_entries(expr: DataFrame, cells: DataFrame, most: float | None = 10.0) -> tuple[DataFrame, DataFrame]:
    """``(cell_id, gene_id, d)`` and ``(gene_id, z0)``: entries of ``expr(cell_id, gene_id, value)`` as differences from their gene's standardised zero.

    Mean and deviation (``n - 1``; 1 where it is 0) are over all ``cells(cell_id)``, absent entries being 0; standardised values are clipped at ``-most`` and ``most``. Several entries of one cell and gene add up; entries of other
    cells, nulls and NaN are left out.
    """
    n = F.lit(float(cells.select("cell_id").distinct().count()))
    v = F.col("value").cast("double")
    rows = expr.where(v.isNotNull() & ~F.isnan(v)).join(cells.select("cell_id").distinct(), "cell_id", "left_semi").groupBy("cell_id", "gene_id").agg(F.sum(v).alias("value"))
    stats = rows.groupBy("gene_id").agg(F.count("*").cast("double").alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("s"))
    mean, spread = F.col("m") * F.col("c") / n, F.col("c") * F.col("s") + F.col("c") * F.col("m") * F.col("m") * (1 - F.col("c") / n)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(ratio(spread, n - 1), F.lit(0.0))))
    scales = stats.select("gene_id", mean.alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))

    def clipped(z):
        return z if most is None else F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), z))

    scales = scales.withColumn("z0", clipped(-F.col("mean") / F.col("sd")))
    entries = rows.join(scales, "gene_id").select("cell_id", "gene_id", (clipped((F.col("value") - F.col("mean")) / F.col("sd")) - F.col("z0")).alias("d"))
    return entries, scales.select("gene_id", "z0")


def _blocks(batch: pa.RecordBatch, genes: int):
    """Rows of a batch as dense blocks: the first row's place, and the block."""
    offsets, at = np.asarray(batch.column("idx").offsets), np.asarray(batch.column("idx").values)
    d, step = np.asarray(batch.column("d").values), max(1, BLOCK // max(1, genes))
    for lo in range(0, batch.num_rows, step):
        hi = min(batch.num_rows, lo + step)
        block, part = np.zeros((hi - lo, genes)), slice(int(offsets[lo]), int(offsets[hi]))
        block[np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), at[part]] = d[part]
        yield lo, block


def sparse_components(expr: DataFrame, cells: DataFrame, k: int, *, most: float | None = 10.0, oversample: int = OVERSAMPLE, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """``(cell_id, pc)``: the first ``k`` principal components of standardised ``expr(cell_id, gene_id, value)`` for every one of ``cells(cell_id)``.

    Values are as in :func:`standardised_entries`; a cell without entries is a row of zeros before standardising. Fewer components come out where there are fewer genes. Signs: the largest loading of each is positive.
    ``rounds`` passes make the space exact to where the spectrum falls; tests state the angles. No genes: empty arrays. Empty table: no rows.
    """
    tables = Tables(expr.sparkSession)
    entries, scales = standardised_entries(expr, cells, most)
    entries = tables.keep(entries)
    sums = {r["gene_id"]: r["s"] for r in entries.groupBy("gene_id").agg(F.sum("d").alias("s")).collect()}  # a row for each gene
    names = sorted(sums)
    every = cells.select("cell_id").distinct()
    n, genes = every.count(), len(names)
    if not genes:
        return tables.result(every.withColumn("pc", F.array().cast("array<double>")))
    place = F.broadcast(expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], f"gene_id {dict(entries.dtypes)['gene_id']}, i int"))  # genes
    lists = entries.join(place, "gene_id").groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("i", "d"))).alias("e"))
    rows = tables.keep(every.join(lists, "cell_id", "left").select("cell_id", F.coalesce(F.transform("e", lambda x: x["i"]), F.array().cast("array<int>")).alias("idx"), F.coalesce(F.transform("e", lambda x: x["d"]), F.array().cast("array<double>")).alias("d")))
    centre, width = np.array([sums[g] for g in names]) / n, min(genes, k + oversample)

    def product(q: np.ndarray) -> np.ndarray:
        """``X'(XQ)`` of the centred rows."""
        shift = centre @ q

        def partial(batches):
            total, ones = np.zeros((genes, q.shape[1])), np.zeros(q.shape[1])
            for batch in batches:
                for _, block in _blocks(batch, genes):
                    y = block @ q - shift
                    total += block.T @ y
                    ones += y.sum(0)
            total -= np.outer(centre, ones)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(genes), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

        parts = rows.select("idx", "d").mapInArrow(partial, "i int, v array<double>").groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(q.shape[1])))
        out = np.zeros((genes, q.shape[1]))
        for r in parts.collect():  # genes x components
            out[r[0]] = r[1:]
        return out

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(genes, width)))[0]
    for _ in range(rounds):
        z = product(q)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        best = q @ turn[:, ::-1][:, :k]
        q = np.linalg.qr(z)[0]
    loadings = best * np.sign(best[np.abs(best).argmax(0), np.arange(best.shape[1])])

    def project(batches):
        for batch in batches:
            for lo, block in _blocks(batch, genes):
                scores = block @ loadings - centre @ loadings
                yield pa.RecordBatch.from_arrays([batch.column("cell_id").slice(lo, len(block)), pa.array(list(scores), pa.list_(pa.float64()))], ["cell_id", "pc"])

    return tables.result(rows.mapInArrow(project, f"cell_id {dict(rows.dtypes)['cell_id']}, pc array<double>"))
