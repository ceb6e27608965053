"""Scans that refuse bad input, probes, and the moves of tables: subsets, replacement, splitting, collation, manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException


def scan_columns(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """Only the named columns; a missing one is an error that names it."""
    table = spark.read.parquet(path)
    missing = [c for c in columns if c not in table.columns]
    if missing:
        raise KeyError(f"{path} lacks {missing}; it has {table.columns}")
    return table.select(*(F.col(f"`{c}`") for c in columns))


def scan_embedding(spark: SparkSession, path: str, vector: str, batch: str, n_batches: int | None = None) -> DataFrame:
    """``(vector, batch)`` and the other columns, checked: fractional numbers, all finite, of one width, every batch named, as many as stated.

    One pass over the two columns counts what is wrong; the error says how much.
    """
    table = spark.read.parquet(path)
    kind = table.schema[vector].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.FloatType | T.DoubleType):
        raise TypeError(f"{vector} is {kind.simpleString()}: no vector of fractional numbers (code indices are not an embedding)")
    bad = F.col(vector).isNull() | F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    found = table.agg(F.count_if(bad).alias("bad"), F.count_if(F.col(batch).isNull()).alias("unnamed"), F.count_distinct(batch).alias("batches"), F.count_distinct(F.size(vector)).alias("widths")).first()
    if found.bad or found.unnamed or found.widths > 1:
        raise ValueError(f"{found.bad} vectors with missing components, {found.unnamed} rows without {batch}, {found.widths} widths")
    if n_batches is not None and found.batches != n_batches:
        raise ValueError(f"{found.batches} batches; {n_batches} were stated")
    return table


def probe(spark: SparkSession, path: str, columns: dict[str, str]) -> str | None:
    """What is wrong with a table as its schema says, or None; no row is read and nothing is raised."""
    try:
        have = dict(spark.read.parquet(path).dtypes)
    except AnalysisException as e:
        return f"{path}: {str(e).splitlines()[0][:200]}"
    wrong = [f"{c} is {have.get(c, 'absent')}, not {t}" for c, t in columns.items() if not have.get(c, "absent").startswith(t)]
    return f"{path}: {'; '.join(wrong)}" if wrong else None


def listed_sections(spark: SparkSession, paths: dict[str, str], needed: tuple[str, ...] = ("x", "y")) -> dict[str, DataFrame]:
    """The tables that have coordinates, by name; the others are left out."""
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    return {name: t for name, t in tables.items() if all(c in t.columns for c in needed)}


def restamped(cells: DataFrame, sections: list[int], prefix: str = "s") -> DataFrame:
    """The listed sections in the order given, renumbered 0, 1, ..., with ids that name the new section."""
    spec = cells.sparkSession.createDataFrame([(s, k) for k, s in enumerate(sections)], "section_id int, _new int")
    kept = cells.withColumn("section_id", F.col("section_id").cast("int")).join(F.broadcast(spec), "section_id")
    return kept.withColumn("section_id", F.col("_new")).withColumn("id", F.concat(F.lit(prefix), F.col("_new").cast("string"), F.lit("_"), F.col("id").cast("string"))).drop("_new").select(cells.columns)


LOG = "_log"  # a name that Spark's own readers pass over


def _log_folder(spark: SparkSession, root: str):
    """The file system of ``root``, the folder of its commit log, and what makes a path."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = make(f"{root}/{LOG}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder, make


def _put_if_absent(spark: SparkSession, root: str, version: int, entry: dict) -> bool:
    """Adds an entry to the log, unless there is one of that version."""
    fs, folder, make = _log_folder(spark, root)
    fs.mkdirs(folder)
    try:
        out = fs.create(make(folder, f"{version:06d}.json"), False)
    except Exception as e:
        if fs.exists(make(folder, f"{version:06d}.json")):
            return False
        raise e
    try:
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
    finally:
        out.close()
    return True


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """The committed versions of a table and the folder of each, from the log alone: one small file a version, no data file is listed or read."""
    fs, folder, _ = _log_folder(spark, root)
    if not fs.exists(folder) or not fs.listStatus(folder):
        return {}
    lines = spark.read.text(f"{root}/{LOG}/*.json").select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int").alias("v"), "value").collect()
    found = {}
    for r in lines:
        try:
            found[r.v] = json.loads(r.value)["folder"]
        except ValueError:
            continue  # its writer died before the entry was whole; that number stays unused
    return dict(sorted(found.items()))


def supersede(df: DataFrame, root: str, version: int) -> str:
    """Writes ``df`` as a new version beside the old ones, which stay; returns its path.

    The rows go to a folder of their own, and only then an entry in the commit log makes them a version: the log takes one entry a version, whoever comes first, so of two writers
    one is refused. Nothing is moved or overwritten, so a reader of the old version goes on undisturbed. A write that dies half-way has no entry, and no reader sees it; the version can be written again.
    """
    if version in versions(df.sparkSession, root):
        raise FileExistsError(f"{root} has version {version}")
    path = f"{root}/v={version:06d}"
    fs, _, make = _log_folder(df.sparkSession, root)
    if fs.exists(make(path)):  # of a writer that died, or of one that is at work
        path = f"{path}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if not _put_if_absent(df.sparkSession, root, version, {"version": version, "folder": path[len(root) + 1 :]}):
        raise FileExistsError(f"{root} has version {version}; these rows lie in {path}")
    return path


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of the highest committed version under ``root``, or of the one given. The log is read first; then that version's files alone."""
    found = versions(spark, root)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"{root} has no version {'' if version is None else version}".rstrip())
    return spark.read.parquet(f"{root}/{found[max(found) if version is None else version]}")


def sanitised(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns and types of ``schema``; absent columns are null, and values that don't fit are an error of the cast."""
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def collated(parts: list[DataFrame], aliases: dict[str, str] | None = None) -> DataFrame:
    """Outputs of prediction batches as one table; aliased columns take one name, columns that a part lacks are null."""
    if not parts:
        raise ValueError("no parts")
    renamed = []
    for part in parts:
        for old, new in (aliases or {}).items():
            if old in part.columns and new not in part.columns:
                part = part.withColumnRenamed(old, new)
        renamed.append(part)
    out = renamed[0]
    for part in renamed[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def split_by_sample(df: DataFrame, batch: str, samples: dict[str, int], renames: dict[str, str], path: str) -> None:
    """One partition for each sample of a declared map of batch keys to section ids, columns renamed; rows of other batches go."""
    spec = df.sparkSession.createDataFrame(list(samples.items()), f"`{batch}` string, section_id int")
    rows = df.withColumn(batch, F.col(batch).cast("string")).join(F.broadcast(spec), batch)
    for old, new in renames.items():
        rows = rows.withColumnRenamed(old, new)
    rows.repartition("section_id").write.mode("errorifexists").partitionBy("section_id").parquet(path)


def gene_set(expr: DataFrame, genes: list[str]) -> tuple[DataFrame, str]:
    """The rows of the listed genes that are there, unchanged, and a JSON manifest: genes kept in their order, absent ones, cells and rows."""
    spec = expr.sparkSession.createDataFrame([(g,) for g in genes], "gene_id string")
    kept = expr.withColumn("gene_id", F.col("gene_id").cast("string")).join(F.broadcast(spec.distinct()), "gene_id", "left_semi")
    there = {r.gene_id for r in kept.select("gene_id").distinct().collect()}  # at most as many as listed
    n = kept.agg(F.count("*").alias("rows"), F.count_distinct("cell_id").alias("cells")).first()
    return kept, json.dumps({"genes": [g for g in genes if g in there], "absent": [g for g in genes if g not in there], "n_rows": n.rows, "n_cells": n.cells})


def seed_index(runs: DataFrame, stamps: DataFrame) -> DataFrame:
    """``(seed, run, status)``: index rows that name a run folder, else the run of the seed's stamp; the status is reported, not filtered."""
    joined = runs.select("seed", F.nullif("run_dir", F.lit("")).alias("run_dir"), "status").join(stamps.select("seed", F.col("run").alias("_stamp")), "seed", "full")
    return joined.select("seed", F.coalesce("run_dir", "_stamp").alias("run"), F.coalesce("status", F.lit("unlisted")).alias("status"))


def printed_table(spark: SparkSession, text: str) -> DataFrame:
    """``(row, column, value)`` of a table printed with blanks between its cells: a header line, then a name and as many values a line.

    A line of another length is an error. ``-`` is null.
    """
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(s for s in text.splitlines() if s.strip())], "k int, line string")
    cells = lines.select("k", F.split(F.trim("line"), r"\s+").alias("c"))
    head = F.broadcast(cells.where("k = 0").select(F.col("c").alias("h")))
    fits = F.assert_true(F.size("c") == F.size("h") + 1, F.concat(F.lit("a line of another length: "), F.array_join("c", " ")))
    body = cells.where("k > 0").join(head, F.lit(True)).withColumn("_ok", fits).where("_ok IS NULL")
    return body.select(F.col("c")[0].alias("row"), F.explode(F.arrays_zip(F.col("h").alias("column"), F.slice("c", 2, F.size("h")).alias("v"))).alias("z")).select("row", F.col("z.column").alias("column"), F.expr("try_cast(nullif(z.v, '-') AS double)").alias("value"))


def scoring_seed(rows: DataFrame, given: int | None = None) -> tuple[int | None, str | None]:
    """The seed to score under, and a warning: the one given, else the only one of the table, else the lowest of several."""
    if given is not None:
        return given, None
    low, n = rows.agg(F.min("seed"), F.count_distinct("seed")).first()
    return low, f"{n} seeds; the lowest is taken" if n > 1 else None
