"""What jobs here ask of the cluster: tables in its shared folder, bounded broadcasts, components."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: A key with more than this share of the rows is frequent; there are at most so many keys, and these may be broadcast.
FREQUENT_KEYS = 1000
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession):
    """Within it, a query's shuffle files go when the query ends; what it wrote stays."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


_OPEN: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratches of the step that runs", default=None)


class Scratch:
    """Tables of one call in the shared folder. A step that has been read for the last time is dropped.

    Unlike a checkpoint, a table here is removed by its own path and not when some garbage is collected,
    and the shuffle files behind it go as soon as it is written. Those that a result still reads stay, unless
    the call ran inside :func:`scratch_dropped`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._n, self._paths = spark, f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}", 0, {}
        if (made := _OPEN.get()) is not None:
            made.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a stored table."""
        self._n += 1
        path = f"{self.folder}/{self._n}"
        with _shuffles_freed(self.spark):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes tables that :meth:`keep` returned; nothing may be read from them any more."""
        for table in tables:
            if table is not None and id(table) in self._paths:
                path, _ = self._paths.pop(id(table))
                self.spark.range(0).write.mode("overwrite").parquet(path)

    def drop_all(self) -> None:
        """Removes all that is left, in one step."""
        if self._paths:
            self._paths.clear()
            self.spark.range(0).write.mode("overwrite").parquet(self.folder)


@contextlib.contextmanager
def scratch_dropped():
    """Within it, operators may leave tables that their results read; all of them go at its end, so what is wanted of the results must be stored by then."""
    made: list[Scratch] = []
    token = _OPEN.set(made)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for scratch in made:
            scratch.drop_all()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which stays."""
    return Scratch(df.sparkSession).keep(df)


def small_or_plain(df: DataFrame, max_rows: int) -> DataFrame:
    """``df``, marked for broadcast only if it has at most ``max_rows`` rows (one count).

    Beyond it the same join is shuffled. The rows must have a bounded width.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_dealt(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed(key, n, ...)``, one row a key, where ``n`` is the number of rows with it and ``total`` that of all.

    Frequent keys, of which there are fewer than ``FREQUENT_KEYS``, are broadcast, so that their rows stay where they are.
    """
    bound = max(100, total // FREQUENT_KEYS)
    often, seldom = F.broadcast(keyed.where(F.col("n") > bound).drop("n")), keyed.where(F.col("n") <= bound).drop("n")
    return rows.join(often, key).unionByName(rows.join(often.select(key), key, "left_anti").join(seldom, key))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Component of each node of an undirected graph, by large-star and small-star steps.

    ``edges(src, dst)`` may repeat, point either way and hold loops; null ends are
    left out. Returns ``(node, component)`` with the smallest node as component.
    In each step the least neighbour of every node comes from a combined aggregate; hubs with more than a
    ``1 / FREQUENT_KEYS`` share of the edges get it by broadcast, so no task holds all edges of a hub.
    The graph shrinks to stars in a logarithmic number of rounds, each stored. No edges: no rows.
    """
    scratch = Scratch(edges.sparkSession)
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    current = scratch.keep(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(max_rounds):
        # each row points from a larger to a smaller node; stars: no node has two ways down, or one way down and one into it
        ends = current.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(current.select("dst", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        n, unsettled = nodes.agg(F.sum("out"), F.count(F.when(F.expr("out > 1 OR out = 1 AND into = 1"), 1))).first()
        if not unsettled:
            roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
        both = current.union(current.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"), F.count("*").alias("n"))
        large = join_dealt(both, least, "src", 2 * n).where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).distinct()
        large = scratch.keep(large)
        scratch.drop(current)
        smallest = large.groupBy("src").agg(F.min("dst").alias("least"), F.count("*").alias("n"))
        joined = join_dealt(large, smallest, "src", n)
        small = joined.select("src", F.col("least").alias("dst")).union(joined.select(F.col("dst").alias("src"), F.col("least").alias("dst"))).where("src <> dst").distinct()
        current = scratch.keep(small)
        scratch.drop(large)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def packed(docs: DataFrame, *needed: str, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` as one column ``row`` and the columns needed, so that no other name can clash."""
    names = [c for c in docs.columns if c not in without]
    return docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names))).alias("row"), *(F.col(f"`{c}`") for c in needed))


def unpacked(names: list[str]) -> list:
    """The columns of a packed row under their names."""
    return [F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)]
