"""Row-level harmonisation: filters, id mapping, labels, splits and subsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered


def whole_counts(df: DataFrame, value: str) -> DataFrame:
    """``value`` as int; a value that isn't whole stops the job."""
    v = F.col(value)
    return df.withColumn(value, F.when(v % 1 != 0, F.raise_error(F.lit(f"{value} holds values that aren't whole"))).otherwise(v).cast("int"))


def concat_sections(sections: list[tuple[int, DataFrame]], held_out: tuple[str, ...] = (), name: str = "section") -> DataFrame:
    """Outer union of sections in order; ids get the suffix ``-<i>``; sections whose name holds a token are left out."""
    out = None
    for i, (number, df) in enumerate(sections):
        if any(token in f"{name}{number}" for token in held_out):
            continue
        part = df.withColumn("section_id", F.lit(number)).withColumn("cell_id", F.concat(F.col("cell_id").cast("string"), F.lit(f"-{i}")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def min_genes(expr: DataFrame, least: int = 10) -> DataFrame:
    """The rows of cells that express at least so many genes."""
    rich = expr.where("value > 0").groupBy("cell_id").agg(F.count_distinct("gene_id").alias("n")).where(F.col("n") >= least)
    return expr.join(rich.select("cell_id"), "cell_id", "left_semi")


def control_mask(name: Column, prefixes: list[str], case_sensitive: bool = False) -> Column:
    """Whether a name starts with one of the prefixes."""
    if case_sensitive:
        out = F.lit(False)
        for p in prefixes:
            out = out | name.startswith(p)
        return out
    return name.rlike("(?i)^(" + "|".join(prefixes) + ")")


def rare_to_null(df: DataFrame, column: str, least: int) -> DataFrame:
    """Values of fewer than ``least`` rows become null. Counts are combined and joined, so that a frequent value isn't gathered."""
    n = df.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(n, column, "left").withColumn(column, F.when(F.col("_n").isNotNull(), F.col(column))).drop("_n")


def scorable_groups(df: DataFrame, label: str, batch: str, min_cells: int = 10, min_batches: int = 2) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), F.count_distinct(batch).alias("n_batches")).where((F.col("n") >= min_cells) & (F.col("n_batches") >= min_batches))


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")


def mapping_chain(df: DataFrame, key: str, tables: list[DataFrame], default: Column) -> DataFrame:
    """``mapped``: the first hit of ``key`` in a chain of tables ``(key, id)``, else ``default``; first duplicates win."""
    out, hits = df, []
    for i, table in enumerate(tables):
        one = table.groupBy("key").agg(F.min("id").alias(f"_id{i}")).withColumnRenamed("key", key)
        out = out.join(one, key, "left")
        hits.append(F.col(f"_id{i}"))
    return out.withColumn("mapped", F.coalesce(*hits, default)).drop(*(f"_id{i}" for i in range(len(tables))))


def collapse_genes(expr: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts summed over the genes that map to one: ``mapping(gene_id, symbol)``; unmapped genes go."""
    return expr.join(mapping, "gene_id").groupBy("cell_id", "symbol").agg(F.sum("value").alias("value"))


def shared_genes(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that both sides have, sorted."""
    return a.select(column).intersect(b.select(column)).orderBy(column)


def hash_subsample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows whatever their order: those with the least MD5 of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key).limit(n)


def canonical_label(label: Column, synonyms: dict[str, str], rules: list[tuple[str, str]]) -> Column:
    """A label's canonical form: an exact synonym of its bare letters and digits, else the first substring rule, else sentence case."""
    bare = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    out = F.concat(F.upper(F.substring(F.trim(label), 1, 1)), F.lower(F.substr(F.trim(label), F.lit(2))))
    for part, name in reversed(rules):
        out = F.when(bare.contains(part), name).otherwise(out)
    for exact, name in synonyms.items():
        out = F.when(bare == exact, name).otherwise(out)
    return out


def most_frequent(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, ties to the least."""
    n = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b")).select(by, F.col("b.v").alias(value), (-F.col("b.n")).alias("n"))


def role_of(name: Column, markers: list[tuple[str, str]], default: str) -> Column:
    """The role of the first marker that the name holds, whatever its case."""
    out = F.lit(default)
    for marker, role in reversed(markers):
        out = F.when(F.lower(name).contains(marker), role).otherwise(out)
    return out


def override_metadata(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win; a differing old one is kept as ``original_<key>`` beside."""
    both = old.withColumnRenamed("value", "_old").join(new.withColumnRenamed("value", "_new"), key, "full")
    merged = both.select(key, F.coalesce("_new", "_old").alias("value"))
    kept = both.where("_new IS NOT NULL AND _old IS NOT NULL AND _new <> _old").select(F.concat(F.lit("original_"), F.col(key)).alias(key), F.col("_old").alias("value"))
    return merged.unionByName(kept)


def dense_token(df: DataFrame, value: str, out: str) -> DataFrame:
    """Dense ids from 0 of distinct values in their order; the values, not the rows, are ranked."""
    distinct = df.select(value).distinct().where(F.col(value).isNotNull())
    return df.join(numbered(distinct, value, out).withColumn(out, F.col(out).cast("int")), value, "left")


def count_diagnosis(expr: DataFrame, labels: DataFrame) -> DataFrame:
    """Whether values are whole and not negative, the library sizes, and the share of missing labels."""
    sizes = expr.groupBy("cell_id").agg(F.sum("value").alias("size")).agg(F.min("size").alias("size_min"), F.median("size").alias("size_median"), F.max("size").alias("size_max"))
    flags = expr.agg(F.bool_and(F.col("value") % 1 == 0).alias("whole"), F.bool_and(F.col("value") >= 0).alias("nonnegative"))
    missing = labels.agg((F.count_if(F.col("label").isNull()) / F.count("*")).alias("missing_share"))
    return flags.join(sizes, F.lit(True)).join(missing, F.lit(True)).withColumn("warn", F.col("missing_share") > 0.2)


def annotated(rows: DataFrame, annotation: DataFrame, key: str) -> DataFrame:
    """Every row with the annotation of its key, null without one; columns of the rows win over those of the same name, and a key annotated twice is an error."""
    if not annotation.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{key} is annotated more than once")
    new = [c for c in annotation.columns if c != key and c not in rows.columns]
    return rows.join(annotation.select(key, *new), key, "left").select(*rows.columns, *new)


def gene_map(genes: DataFrame, kinds: tuple[str, ...] = ("protein_coding", "miRNA")) -> DataFrame:
    """``(name, gene_id)`` of ``genes(position, name, gene_id, biotype)``: of the kinds wanted, the last of each name."""
    return genes.where(F.col("biotype").isin(*kinds) & F.col("name").isNotNull()).groupBy("name").agg(F.max_by("gene_id", "position").alias("gene_id"))


def program_union(sources: list[DataFrame]) -> DataFrame:
    """``(program, role, gene_id)`` of all sources; a gene that several give counts once."""
    out = sources[0].select("program", "role", "gene_id")
    for more in sources[1:]:
        out = out.unionByName(more.select("program", "role", "gene_id"))
    return out.distinct()
