"""Neighbourhood joins within sections: exact k nearest neighbours, radius graphs, and what is gathered over them.

Points are ``(section_id, id, x, y)``. Sections never mix. Ties in distance go by id. The joins know a point by section and id; what is
gathered over edges by id alone (means, regression, hops) needs ids that are unique over all sections.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ratio
from ..session import checkpointed
from .quantiles import medians

#: A first cell holds at most so many times k targets, unless they lie in one place.
MAX_FILL = 64


def _distance(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def section_grid(points: DataFrame, k: int, fill: float = 1.0) -> DataFrame:
    """Per section the origin, a cell side that holds about ``fill * k`` points on average, and the side of its box."""
    box = points.groupBy("section_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    side = F.sqrt(F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), wide * wide * 1e-6) * fill * k / F.col("n"))
    return box.select("section_id", "x0", "y0", F.when(side > 0, side).otherwise(1.0).alias("side"), wide.alias("wide"))


def _ring(df: DataFrame) -> DataFrame:
    """A row for each of the nine cells around a point's own."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    return df.withColumn("_s", F.explode(steps)).withColumn("gx", F.col("gx") + F.col("_s.a")).withColumn("gy", F.col("gy") + F.col("_s.b")).drop("_s")


def _in_cells(points: DataFrame, grid: DataFrame, factor: float) -> DataFrame:
    side = F.col("side") * factor
    return points.join(grid, "section_id").withColumn("gx", F.floor((F.col("x") - F.col("x0")) / side)).withColumn("gy", F.floor((F.col("y") - F.col("y0")) / side)).withColumn("reach", side).drop("x0", "y0", "side")


def _first_factor(targets: DataFrame, grid: DataFrame, k: int) -> tuple[float | None, float]:
    """The widest section in cells of factor 1 (None without targets), and how far below the mean density's side the search
    starts: so that no cell holds more than ``MAX_FILL * k`` targets, as far as that helps."""
    factor, before = 1.0, None
    while True:
        cells = _in_cells(targets, grid, factor).groupBy("section_id", "gx", "gy").agg(F.count("*").alias("n"), F.max(F.col("wide") / F.col("reach")).alias("wide"))
        fullest, wide = cells.agg(F.max("n"), F.max("wide") * factor).first()
        if fullest is None or fullest <= MAX_FILL * k or fullest == before:  # many points in one place don't come apart
            return wide, factor
        before, factor = fullest, factor / 4


def _within_reach(near: DataFrame, own: list[str], k: int, gap, span) -> DataFrame:
    """Rows of ``near``, by ``own`` the cells of ``n`` targets each seen from one place, but those that lie wholly farther than cells enough for ``k`` targets do at their farthest.

    ``gap`` and ``span`` give the least and the greatest distance in the direction ``x`` or ``y``, in sides of a lowest cell.
    """
    by = Window.partitionBy(*own)
    near = near.withColumns({"_least": gap("x") * gap("x") + gap("y") * gap("y"), "_most": span("x") * span("x") + span("y") * span("y")})
    # more than k, as a point may be among the targets itself; where there are fewer, all stay
    near = near.withColumn("_enough", F.sum("n").over(by.orderBy("_most").rangeBetween(Window.unboundedPreceding, 0)) > k)
    near = near.withColumn("_bound", F.coalesce(F.min(F.when(F.col("_enough"), F.col("_most"))).over(by), F.lit(float("inf"))))
    return near.where(F.col("_least") <= F.col("_bound") * (1 + 1e-6) + 1e-6)  # more than rounding takes


def _near_cells(left: DataFrame, cells: DataFrame, grid: DataFrame, factor: float, depth: int, k: int) -> DataFrame:
    """``(section_id, qx, qy, gx, gy)``: for each cell ``(qx, qy)`` with points of ``left`` the ``cells(section_id, gx, gy, n)`` of targets in which one of the ``k`` nearest of any point of it can lie.

    Cells of side ``factor`` are the lowest of a pyramid of ``depth`` more levels, each four times as wide as the one below. Each query cell goes down from the top: a cell is left out that lies wholly farther
    than cells enough for ``k`` targets do at their farthest. So only rims are looked at, however wide an empty area around the query cell is.
    """
    near = _in_cells(left, grid, factor).select("section_id", F.col("gx").alias("qx"), F.col("gy").alias("qy")).distinct()
    for level in range(depth, -1, -1):
        wide = 4**level
        at = cells.groupBy("section_id", F.floor(F.col("gx") / wide).alias("gx"), F.floor(F.col("gy") / wide).alias("gy")).agg(F.sum("n").alias("n"))
        if level == depth:
            near = near.join(at, "section_id")
        else:
            steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(4)))
            below = near.withColumn("_s", F.explode(steps)).select("section_id", "qx", "qy", (F.col("gx") * 4 + F.col("_s.i")).alias("gx"), (F.col("gy") * 4 + F.col("_s.j")).alias("gy"))
            near = below.join(at, ["section_id", "gx", "gy"])
        gap = lambda d, wide=wide: F.greatest(F.lit(0.0), F.col(f"g{d}") * wide - F.col(f"q{d}") - 1.0, F.col(f"q{d}") - (F.col(f"g{d}") + 1.0) * wide)
        span = lambda d, wide=wide: F.greatest((F.col(f"g{d}") + 1.0) * wide - F.col(f"q{d}"), F.col(f"q{d}") + 1.0 - F.col(f"g{d}") * wide)
        near = _within_reach(near, ["section_id", "qx", "qy"], k, gap, span).select("section_id", "qx", "qy", "gx", "gy")
    return near


def _cells_of_points(left: DataFrame, cells: DataFrame, grid: DataFrame, factor: float, depth: int, k: int) -> DataFrame:
    """``left(section_id, src, x, y)`` with each cell ``(gx, gy)`` in which one of a point's own ``k`` nearest targets can lie: of the :func:`_near_cells` of its cell those that are within reach of the point itself.

    Rows are few beside the pairs that come of them, so they are dealt by cell into as many tasks as a shuffle has.
    """
    found = _near_cells(left, cells, grid, factor, depth, k).join(cells, ["section_id", "gx", "gy"])
    side = F.col("side") * factor
    placed = left.join(grid, "section_id").withColumns({"px": (F.col("x") - F.col("x0")) / side, "py": (F.col("y") - F.col("y0")) / side}).withColumns({"qx": F.floor("px"), "qy": F.floor("py")})
    near = placed.select("section_id", "src", "x", "y", "px", "py", "qx", "qy").join(found, ["section_id", "qx", "qy"])
    gap = lambda d: F.greatest(F.lit(0.0), F.col(f"g{d}") - F.col(f"p{d}"), F.col(f"p{d}") - F.col(f"g{d}") - 1.0)
    span = lambda d: F.greatest(F.col(f"g{d}") + 1.0 - F.col(f"p{d}"), F.col(f"p{d}") - F.col(f"g{d}"))
    near = _within_reach(near, ["section_id", "src"], k, gap, span).select("section_id", "src", "x", "y", "gx", "gy")
    return near.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "section_id", "gx", "gy")


def knn_join(queries: DataFrame, targets: DataFrame, k: int, *, exclude_self: bool = True, fill: float = 2.0) -> DataFrame:
    """The ``k`` nearest targets of each query in its section: ``(section_id, src, dst, d2, rank)``.

    Exact; a point is known by section and id, so ids may repeat across sections. A grid brings each query the targets of its
    own and the eight cells around; all targets within one side are among them, so a query is settled once its k-th distance
    is at most the side. The others go on with cells of four times the side, up to that of the mean density. The first cells are so small
    that the densest is not overfull: points of a clump settle there, and only the few outside of it see larger cells. Those that lie in holes or far out are left; they
    get the first cells again, but those that :func:`_cells_of_points` finds for them. Queries with
    fewer than ``k`` targets in their section have all of these. Checkpoints cut the lineage between rounds.
    """
    grid = checkpointed(section_grid(targets, k, fill))
    wide, first = _first_factor(targets, grid, k)
    if wide is None:
        return _no_edges(queries)
    me = ["section_id", "src"]
    left, out, factor = queries.select("section_id", F.col("id").alias("src"), "x", "y"), None, first
    aims = targets.select("section_id", F.col("id").alias("dst"), "x", "y")

    def nearest(q: DataFrame, factor: float) -> DataFrame:
        pairs = q.withColumnsRenamed({"x": "qx", "y": "qy"}).join(_in_cells(aims, grid, factor).drop("reach", "wide"), ["section_id", "gx", "gy"])
        pairs = (pairs.where("src <> dst") if exclude_self else pairs).withColumn("d2", _distance("qx", "qy", "x", "y"))
        return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*me).orderBy("d2", "dst"))).where(F.col("rank") <= k)

    while factor <= 1.0:
        near = nearest(_ring(_in_cells(left, grid, factor)), factor)
        settled = (F.count("*").over(Window.partitionBy(*me)) >= k) & (F.max("d2").over(Window.partitionBy(*me)) <= F.col("reach") * F.col("reach"))
        near = checkpointed(near.withColumn("settled", settled).where("settled").select("section_id", "src", "dst", "d2", "rank"))
        out = near if out is None else out.unionByName(near)
        left = checkpointed(left.join(near.select(*me).distinct(), me, "left_anti"))
        if left.isEmpty():
            return out
        factor *= 4.0
    cells = checkpointed(_in_cells(aims, grid, first).groupBy("section_id", "gx", "gy").agg(F.count("*").alias("n")))
    depth = max(0, math.ceil(math.log(max(wide / first, 1.0), 4)) - 1)  # four cells a side on top
    rest = nearest(_cells_of_points(left, cells, grid, first, depth, k), first)
    return out.unionByName(checkpointed(rest.select("section_id", "src", "dst", "d2", "rank")))


def _no_edges(queries: DataFrame) -> DataFrame:
    return queries.select("section_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).where("false")


def radius_join(points: DataFrame, radius: float, self_loop: bool = False) -> DataFrame:
    """All pairs of one section within ``radius``: ``(section_id, src, dst, d2)``, each in both directions."""
    cell = lambda c: F.floor(F.col(c) / radius)
    a = _ring(points.select("section_id", F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("gx"), cell("y").alias("gy")))
    b = points.select("section_id", F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("gx"), cell("y").alias("gy"))
    pairs = a.join(b, ["section_id", "gx", "gy"]).withColumn("d2", _distance("ax", "ay", "bx", "by")).where(F.col("d2") <= radius * radius)
    return (pairs if self_loop else pairs.where("src <> dst")).select("section_id", "src", "dst", "d2")


def with_self_loops(edges: DataFrame, points: DataFrame) -> DataFrame:
    """A self edge of rank 0 on top of each point's neighbours."""
    loops = points.select("section_id", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank"))
    return edges.select("section_id", "src", "dst", "d2", "rank").unionByName(loops)


def degrees(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Neighbours of each point, 0 included."""
    counted = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return points.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbour_aggregate(edges: DataFrame, expr: DataFrame, how: str = "mean", transposed: bool = False) -> DataFrame:
    """``(id, gene_id, value)``: mean or sum of the neighbours' values; absent values count as 0.

    Transposed: each point receives from those that list it.
    """
    me, other = ("dst", "src") if transposed else ("src", "dst")
    sums = edges.join(expr.withColumnRenamed("id", other), other).groupBy(F.col(me).alias("id"), "gene_id").agg(F.sum("value").alias("value"))
    if how == "sum":
        return sums
    degree = edges.groupBy(F.col(me).alias("id")).agg(F.count("*").alias("degree"))
    return sums.join(degree, "id").select("id", "gene_id", (F.col("value") / F.col("degree")).alias("value"))


def knn_regress(edges: DataFrame, values: DataFrame, weighting: str = "uniform") -> DataFrame:
    """``(id, feature, predicted)`` from neighbours' ``values(id, feature, value)``.

    Weights: uniform, ``distance`` (1 / (d + 1e-8)) or ``gaussian`` with the median neighbour distance as bandwidth.
    """
    d = F.sqrt("d2")
    if weighting == "uniform":
        weighted = edges.withColumn("w", F.lit(1.0))
    elif weighting == "distance":
        weighted = edges.withColumn("w", 1.0 / (d + 1e-8))
    elif weighting == "gaussian":
        width = medians(edges.select(d.alias("d")), [], "d").first()["median"] or 1.0
        weighted = edges.withColumn("w", F.exp(-F.col("d2") / (2.0 * width * width)))
    else:
        raise ValueError(weighting)
    joined = weighted.join(values.withColumnRenamed("id", "dst"), "dst")
    return joined.groupBy(F.col("src").alias("id"), "feature").agg(F.coalesce(ratio(F.sum(F.col("w") * F.col("value")), F.sum("w")), F.lit(0.0)).alias("predicted"))


def read_depth(edges: DataFrame, depth: DataFrame, points: DataFrame) -> DataFrame:
    """Mean depth of each point's neighbours; without any, the mean of all."""
    near = edges.join(depth.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.avg("depth").alias("depth"))
    overall = depth.agg(F.avg("depth")).first()[0]
    return points.select("id").join(near, "id", "left").select("id", F.coalesce("depth", F.lit(overall)).alias("depth"))


def code_composition(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """``(id, code, share)``: codes of each point's neighbours."""
    n = edges.join(codes.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "code").agg(F.count("*").alias("n"))
    return n.select("id", "code", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("share"))


def near_kind(edges: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """Points that aren't of ``kind`` themselves but have a neighbour that is."""
    of_kind = kinds.where(F.col("kind") == kind).select("id")
    near = edges.join(of_kind.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return near.join(of_kind, "id", "left_anti")


def hop_means(edges: DataFrame, values: DataFrame, hops: int) -> DataFrame:
    """``(id, hop, feature, value)``: values themselves, then means over neighbours, over theirs, and so on."""
    current, out = values, values.select("id", F.lit(0).alias("hop"), "feature", "value")
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    for hop in range(1, hops + 1):
        sums = edges.join(current.withColumnRenamed("id", "dst"), "dst").groupBy("src", "feature").agg(F.sum("value").alias("value"))
        current = sums.join(degree, "src").select(F.col("src").alias("id"), "feature", (F.col("value") / F.col("degree")).alias("value"))
        out = out.unionByName(current.select("id", F.lit(hop).alias("hop"), "feature", "value"))
    return out


def morans_i(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Moran's I of each feature with unit weights: ``(feature, moran)``; values must be dense over the points."""
    mean = values.groupBy("feature").agg(F.avg("value").alias("mean"))
    dev = values.join(mean, "feature").select("id", "feature", (F.col("value") - F.col("mean")).alias("z"))
    own = dev.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("ss"))
    pairs = edges.join(dev.select(F.col("id").alias("src"), "feature", F.col("z").alias("a")), "src").join(dev.select(F.col("id").alias("dst"), "feature", F.col("z").alias("b")), ["dst", "feature"])
    across = pairs.groupBy("feature").agg(F.count("*").alias("w"), F.sum(F.col("a") * F.col("b")).alias("cross"))
    return own.join(across, "feature").select("feature", ratio(F.col("n") * F.col("cross"), F.col("w") * F.col("ss")).alias("moran"))


def holdout_split(points: DataFrame, regions: dict[int, tuple[float, float, float, float]]) -> DataFrame:
    """``data_split`` by boxes given as shares of a section's range (x low, x high, y low, y high), bounds included.

    Sections without a box are all train. The boxes are a declared, small mapping.
    """
    box = points.groupBy("section_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inside = F.lit(False)
    for section, (xl, xh, yl, yh) in regions.items():
        at = lambda low, high, share: F.col(low) + (F.col(high) - F.col(low)) * share
        hit = (F.col("section_id") == section) & F.col("x").between(at("x0", "x1", xl), at("x0", "x1", xh)) & F.col("y").between(at("y0", "y1", yl), at("y0", "y1", yh))
        inside = inside | hit
    return points.join(box, "section_id").withColumn("data_split", F.when(inside, "test").otherwise("train")).drop("x0", "x1", "y0", "y1")


def _with_section(points: DataFrame, *values: Column) -> DataFrame:
    """``points`` with figures of their sections: one combined aggregate, a row for each section, joined back."""
    return points.join(points.groupBy("section_id").agg(*values), "section_id")


def zscore_by_train(points: DataFrame) -> DataFrame:
    """Coordinates less the mean, by the deviation (ddof 0, 1 if tiny) of the section's train rows, or of all if there are none."""
    train = F.col("data_split") == "train"
    figures = []
    for c in ("x", "y"):
        only = F.when(train, F.col(c))
        figures += [F.coalesce(F.avg(only), F.avg(c)).alias(f"_m{c}"), F.coalesce(F.stddev_pop(only), F.stddev_pop(c)).alias(f"_s{c}")]
    out = _with_section(points, *figures)
    return out.select(*points.columns, *(((F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") <= 1e-8, 1.0).otherwise(F.col(f"_s{c}"))).alias(f"z{c}") for c in ("x", "y")))


def rotate_unit(points: DataFrame, degrees_: float, flip_x: bool = False) -> DataFrame:
    """Coordinates centred on the section's mean, turned, and divided by the box's diagonal if it isn't 0."""
    c, s = F.cos(F.radians(F.lit(degrees_))), F.sin(F.radians(F.lit(degrees_)))
    centred = _with_section(points, F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    x, y = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    turned = centred.select(*points.columns, ((-x if flip_x else x) * c - y * s).alias("rx"), ((-x if flip_x else x) * s + y * c).alias("ry"))
    dx, dy = F.max("rx") - F.min("rx"), F.max("ry") - F.min("ry")
    sized = _with_section(turned, F.sqrt(dx * dx + dy * dy).alias("_diagonal"))
    by = F.when(F.col("_diagonal") > 0, F.col("_diagonal")).otherwise(1.0)
    return sized.select(*points.columns, (F.col("rx") / by).alias("rx"), (F.col("ry") / by).alias("ry"))


def normalise_by_spacing(points: DataFrame, nearest: DataFrame) -> DataFrame:
    """Coordinates centred on the section's mean and divided by its median nearest-neighbour distance (1 if 0)."""
    spacing = medians(nearest.where("rank = 1").select("section_id", F.sqrt("d2").alias("spacing")), ["section_id"], "spacing").select("section_id", F.col("median").alias("spacing"))
    centred = _with_section(points.select("section_id", "id", "x", "y"), F.avg("x").alias("_mx"), F.avg("y").alias("_my")).join(spacing, "section_id", "left")
    by = F.coalesce(F.when(F.col("spacing") > 0, F.col("spacing")).otherwise(1.0), F.lit(1.0))
    return centred.select("section_id", "id", ((F.col("x") - F.col("_mx")) / by).alias("x"), ((F.col("y") - F.col("_my")) / by).alias("y"))


def section_scale(points: DataFrame, nearest: DataFrame, target: float, radius: float, declared: dict[int, float] | None = None) -> DataFrame:
    """``(section_id, factor, mean_degree)``: what brings a section's coordinates to scale, and its mean number of neighbours within ``radius`` then.

    A declared factor wins; else ``target`` over the median nearest-neighbour distance; 1 where that is 0.
    """
    spacing = medians(nearest.where("rank = 1").select("section_id", F.sqrt("d2").alias("spacing")), ["section_id"], "spacing").select("section_id", F.col("median").alias("spacing"))
    own = F.lit(None).cast("double")
    for section, factor in (declared or {}).items():
        own = F.when(F.col("section_id") == section, float(factor)).otherwise(own)
    factors = points.select("section_id").distinct().join(spacing, "section_id", "left").select("section_id", F.coalesce(own, F.when(F.col("spacing") > 0, F.lit(target) / F.col("spacing")), F.lit(1.0)).alias("factor"))
    scaled = points.join(factors, "section_id").select("section_id", "id", (F.col("x") * F.col("factor")).alias("x"), (F.col("y") * F.col("factor")).alias("y"))
    edges = radius_join(scaled, radius).groupBy("section_id").agg(F.count("*").alias("e"))
    n = points.groupBy("section_id").agg(F.count("*").alias("n"))
    return factors.join(n, "section_id").join(edges, "section_id", "left").select("section_id", "factor", (F.coalesce("e", F.lit(0)) / F.col("n")).alias("mean_degree"))


def fill_from_boundary(context: DataFrame, holes: DataFrame, k: int, steps: int = 12, schedule: str = "cosine") -> DataFrame:
    """``(section_id, id, value, step)`` for all ``holes(section_id, id, x, y)``, filled from the edge inwards.

    In each step the holes left take the mean of their ``k`` nearest points of the ``context(section_id, id, x, y, value)``; those nearest to it are
    committed, so many that the schedule's share (cosine, or linear) remains open, and join the context. The last step commits all.
    Ids must tell the points of a section apart, holes included. A section's holes are ranked in one task. Sections without context stay empty.
    """
    todo, known, out = checkpointed(holes.select("section_id", "id", "x", "y")), context.select("section_id", "id", "x", "y", "value"), None
    totals = checkpointed(todo.groupBy("section_id").agg(F.count("*").alias("total")))
    for step in range(1, steps + 1):
        edges = knn_join(todo, known, k)
        near = edges.join(known.select("section_id", F.col("id").alias("dst"), "value"), ["section_id", "dst"])
        guess = near.groupBy("section_id", F.col("src").alias("id")).agg(F.avg("value").alias("value"), F.min("d2").alias("far"))
        remain = (math.cos(0.5 * math.pi * step / steps) if schedule == "cosine" else 1.0 - step / steps) if step < steps else 0.0
        own = Window.partitionBy("section_id")
        ranked = guess.join(totals, "section_id").withColumn("place", F.row_number().over(own.orderBy("far", "id"))).withColumn("open", F.count("*").over(own))
        taken = ranked.where(F.col("place") <= F.col("open") - F.floor(F.lit(remain) * F.col("total"))).select("section_id", "id", "value", F.lit(step).alias("step"))
        taken = checkpointed(taken)
        out = taken if out is None else out.unionByName(taken)
        if step < steps:
            known = checkpointed(known.unionByName(taken.join(todo, ["section_id", "id"]).select(known.columns)))
            todo = checkpointed(todo.join(taken, ["section_id", "id"], "left_anti"))
            if todo.isEmpty():
                break
    return out


def with_neighbour_layer(edges: DataFrame, expr: DataFrame, layers: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """``layers`` with the neighbour sums of ``expr`` under ``name``, made only if absent."""
    return layers if name in layers else layers | {name: neighbour_aggregate(edges, expr, "sum")}
