"""Choosing rows: boxes and splits of sections, masks, vocabularies, reference panels, checks before use."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered

#: Bits of the hash by which the rows of a mask are counted first; one row of a count each.
_MASK_BITS = 16


def region_boxes(points: DataFrame, regions: dict[int, dict[str, float]]) -> DataFrame:
    """``(section_id, x_min, x_max, y_min, y_max)`` of the declared regions.

    A region names bounds by absolute keys (``x_min``), or by shares of its section's range (``x_min_pct``); an absolute
    key wins, and a bound without a key is the section's own. Sections without points give no box.
    """
    box = points.groupBy("section_id").agg(*(f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))))
    sides = ("x_min", "x_max", "y_min", "y_max")
    spec = [(section, *(region.get(s) for s in sides), *(region.get(f"{s}_pct") for s in sides)) for section, region in regions.items()]
    schema = "section_id int, " + ", ".join(f"a_{s} double" for s in sides) + ", " + ", ".join(f"p_{s} double" for s in sides)
    spec = F.broadcast(points.sparkSession.createDataFrame(spec, schema))  # as many rows as there are declared regions

    def side(s: str) -> Column:
        low, high = F.col(f"{s[0]}_min"), F.col(f"{s[0]}_max")
        return F.coalesce(F.col(f"a_{s}"), low + (high - low) * F.col(f"p_{s}"), F.col(s)).alias(s)

    return box.join(spec, "section_id").select("section_id", *(side(s) for s in sides))


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``points`` with ``held_out``: inside a box of their section, bounds included. Sections without a box hold none out."""
    marked = points.join(boxes, "section_id", "left")
    inside = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    return marked.withColumn("held_out", F.coalesce(inside, F.lit(False))).select(*points.columns, "held_out")


def regional_split(points: DataFrame, x_share: float = 0.6, y_share: float = 0.5) -> DataFrame:
    """train up to ``x_share`` of the section's width; beyond it test below ``y_share`` of its height, else val."""
    box = points.groupBy("section_id").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    x_at, y_at = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * x_share, F.col("_y0") + (F.col("_y1") - F.col("_y0")) * y_share
    split = F.when(F.col("x") <= x_at, "train").when(F.col("y") < y_at, "test").otherwise("val")
    return points.join(box, "section_id").withColumn("data_split", split).select(*points.columns, "data_split")


def scattered_mask(df: DataFrame, id_: str, share: float, seed: int = 0) -> DataFrame:
    """``df`` with ``masked``: exactly ``floor(share * n)`` rows, those of the least hashes of seed and id.

    The rows are counted by the first bits of the hash; only the rows of one such group, a 65,536th of all, are ranked.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string"))), 1, 12), 16, 10).cast("long")
    rows = df.withColumn("_h", h).withColumn("_g", F.shiftright("_h", 48 - _MASK_BITS))
    groups = rows.groupBy("_g").agg(F.count("*").alias("n")).orderBy("_g").collect()  # at most 2**_MASK_BITS rows
    left, below = int(share * sum(g.n for g in groups)), -1
    for g in groups:
        if g.n > left:
            break
        left, below = left - g.n, g._g
    last = rows.where(F.col("_g") == below + 1).select("_h", id_).withColumn("_r", F.row_number().over(Window.orderBy("_h", id_))).where(F.col("_r") <= left).select(id_, F.lit(True).alias("_in"))
    edge = rows.join(last, id_, "left")
    return edge.withColumn("masked", (F.col("_g") <= below) | F.coalesce("_in", F.lit(False))).select(*df.columns, "masked")


def roi_mask(points: DataFrame, box: tuple[float, float, float, float], label: str, value: str) -> Column:
    """Inside the open box (x low, x high, y low, y high) and of the label."""
    xl, xh, yl, yh = box
    inside = (F.col("x") > xl) & (F.col("x") < xh) & (F.col("y") > yl) & (F.col("y") < yh)
    return F.coalesce(inside & (F.col(label) == value), F.lit(False))


def in_vocabulary(expr: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows of ``expr(cell_id, gene_id, value)`` whose gene is in the vocabulary; cells left without a value other than 0 go."""
    known = expr.join(vocabulary.select("gene_id").distinct(), "gene_id", "left_semi")
    return known.where("value <> 0").select("cell_id", "gene_id", "value")


def aligned_to_reference(expr: DataFrame, reference: DataFrame) -> DataFrame:
    """``(cell_id, place, gene_id, value)``: every cell over every gene of ``reference(place, gene_id)``, absent ones 0.

    No gene in common is an error. The reference is a gene panel: a bounded table.
    """
    if expr.join(reference, "gene_id", "left_semi").isEmpty():
        raise ValueError("no gene of the table is in the reference")
    values = expr.join(reference.select("gene_id"), "gene_id", "left_semi").groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value"))
    grid = expr.select("cell_id").distinct().join(F.broadcast(reference.select("place", "gene_id")), F.lit(True))
    return grid.join(values, ["cell_id", "gene_id"], "left").select("cell_id", "place", "gene_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def nan_policy(df: DataFrame, vector: str, most: float = 0.02, fill: bool = False) -> DataFrame:
    """Refuses a table of which more than ``most`` of the rows hold a NaN or null component; else keeps or fills them.

    Filled components take the mean of their finite values.
    """
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    n, n_bad = df.agg(F.count("*"), F.count_if(bad)).first()
    if n and n_bad > most * n:
        raise ValueError(f"{n_bad} of {n} rows hold missing components")
    if not fill or not n_bad:
        return df
    parts = df.select(F.posexplode(vector).alias("k", "v")).where(~F.isnan("v") & F.col("v").isNotNull())
    means = dict(parts.groupBy("k").agg(F.avg("v")).collect())  # one row a component
    known = F.create_map(*(F.lit(x) for kv in means.items() for x in kv)) if means else F.lit(None)
    return df.withColumn(vector, F.transform(vector, lambda v, k: F.when(v.isNull() | F.isnan(v), F.coalesce(known[k], F.lit(0.0))).otherwise(v)))


def looks_like_counts(df: DataFrame, value: str, by: list[str], tolerance: float = 1e-6) -> DataFrame:
    """``counts`` for each of ``by``: all values finite, not negative and whole."""
    v = F.col(value).cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")) & (F.abs(v - F.round(v)) <= tolerance)
    return df.groupBy(*by).agg(F.bool_and(good).alias("counts"))


def variants_like(df: DataFrame, variant: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose variant fits one of the globs ``include`` and none of ``exclude``; names with a leading ``_`` are skipped."""
    def fits(globs: list[str]) -> Column:
        hit = F.lit(False)
        for g in globs:
            hit = hit | F.col(variant).rlike("^" + fnmatch.translate(g))
        return hit

    keep = ~F.col(variant).startswith("_")
    if include:
        keep = keep & fits(include)
    if exclude:
        keep = keep & ~fits(exclude)
    return df.where(keep)


def split_views(df: DataFrame, split: str, wanted: list[str]) -> DataFrame:
    """``df`` once for each wanted split, as ``view``: ``all`` is every row; without the column only ``all`` gives rows."""
    views = F.array(*(F.lit(w) for w in wanted))
    fits = (lambda w: (w == "all") | (F.col(split) == w)) if split in df.columns else (lambda w: w == "all")
    return df.withColumn("view", F.explode(F.filter(views, fits)))


def perturbed(expr: DataFrame, groups: DataFrame, masked: str, pool: str, mode: str = "mean", seed: int = 0) -> DataFrame:
    """``expr(cell_id, gene_id, value)`` with the cells of one group given the expression of another.

    ``mode``: the pool's ``mean`` or ``median`` of each gene (absent values count as 0), or ``replacement`` by one
    cell of the pool, drawn for each cell by hash. ``groups(cell_id, label)``.
    """
    target, source = groups.where(F.col("label") == masked).select("cell_id"), groups.where(F.col("label") == pool).select("cell_id")
    kept = expr.join(target, "cell_id", "left_anti").select("cell_id", "gene_id", F.col("value").cast("double").alias("value"))
    own = expr.join(source, "cell_id")
    n = source.count()
    if mode == "replacement":
        def at(c):
            return F.pmod(F.xxhash64(F.lit(seed), c), F.lit(max(n, 1)))

        ranked = numbered(source, "cell_id").select(F.col("cell_id").alias("donor"), "_n")
        drawn = target.withColumn("_n", at(F.col("cell_id"))).join(ranked, "_n").select("cell_id", "donor")
        given = drawn.join(own.withColumnRenamed("cell_id", "donor"), "donor").select("cell_id", "gene_id", F.col("value").cast("double").alias("value"))
        return kept.unionByName(given)
    per = own.groupBy("gene_id")
    if mode == "mean":
        profile = per.agg((F.sum("value") / F.lit(n)).alias("value"))
    elif mode == "median":
        # of n values, those absent are 0 and come first, as counts are not negative
        ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy("gene_id").orderBy("value")) + F.lit(n) - F.count("*").over(Window.partitionBy("gene_id")))
        middle = ranked.where((F.col("_r") == (n + 1) // 2) | (F.col("_r") == n // 2 + 1))
        profile = middle.groupBy("gene_id").agg((F.sum(F.col("value") * F.when(F.lit(n % 2 == 1), 2.0).otherwise(1.0)) / 2.0).alias("value"))
    else:
        raise ValueError(mode)
    given = target.join(F.broadcast(profile.where("value <> 0")), F.lit(True)).select("cell_id", "gene_id", "value")  # a row for each gene of the panel
    return kept.unionByName(given)


def select_metric(niche: DataFrame, batchint: DataFrame, selector: str) -> DataFrame:
    """``(variant, value)`` of ``niche|split|code_key|label_key|column`` or ``batchint|emb_key|metric``; null and NaN values go."""
    kind, *parts = selector.split("|")
    if kind == "niche" and len(parts) == 4:
        split, code, label, column = parts
        found = niche.where((F.col("split") == split) & (F.col("code_key") == code) & (F.col("label_key") == label)).select("variant", F.col(column).cast("double").alias("value"))
    elif kind == "batchint" and len(parts) == 2:
        emb, metric = parts
        found = batchint.where((F.col("emb_key") == emb) & (F.col("metric") == metric)).select("variant", F.col("score").cast("double").alias("value"))
    else:
        raise ValueError(f"unknown selector {selector!r}")
    return found.where("value IS NOT NULL AND NOT isnan(value)")
