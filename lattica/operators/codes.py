"""Code columns and labels: views of code stacks, composite codes, coalesced labels, printed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered


def first_valid(*labels: Column) -> Column:
    """The first label of a row that is no stand-in for a missing one."""
    missing = ("", "nan", "NaN", "None", "NA", "null")
    return F.coalesce(*(F.when(~F.trim(c.cast("string")).isin(*missing), c.cast("string")) for c in labels))


def donor_of(label: Column, pattern: str) -> Column:
    """The first group of ``pattern`` in a section's label, else the label itself."""
    return F.coalesce(F.nullif(F.regexp_extract(label, pattern, 1), F.lit("")), label)


def code_views(df: DataFrame, id_: str, codes: str, levels: int) -> DataFrame:
    """``(id, view, code)``: one level gives ``level_0``; more also give ``composite``, a number for each distinct stack.

    Numbers follow the stacks' order; the distinct stacks are numbered by ranges.
    """
    single = df.select(F.col(id_).alias("id"), F.lit("level_0").alias("view"), F.col(codes)[0].cast("long").alias("code"))
    if levels == 1:
        return single
    stack = F.slice(codes, 1, levels)
    numbers = numbered(df.select(stack.alias("_stack")).distinct(), "_stack")
    composite = df.select(F.col(id_).alias("id"), stack.alias("_stack")).join(numbers, "_stack").select("id", F.lit("composite").alias("view"), F.col("_n").cast("long").alias("code"))
    return single.unionByName(composite)


def composite_code(df: DataFrame, first: str, second: str) -> DataFrame:
    """``composite``: ``first * (max(second) + 1) + second``, with the largest second code that occurs."""
    radix = df.agg((F.max(second) + 1).alias("_radix"))
    return df.join(F.broadcast(radix), F.lit(True)).withColumn("composite", F.col(first) * F.col("_radix") + F.col(second)).drop("_radix")  # one row


def decay_of(variant: Column, prefix: str, reference: str, default: float) -> Column:
    """The number in ``<prefix>-0p9`` as 0.9; variants that start with ``reference`` have ``default``; else null."""
    text = F.regexp_extract(variant, rf"{prefix}-(\d+(?:p\d+)?)", 1)
    own = F.when(text != "", F.regexp_replace(text, "p", ".").try_cast("double"))
    return F.coalesce(own, F.when(variant.startswith(reference), F.lit(default)))


def cell_text(mean: Column, half: Column, marks: Column | None = None) -> Column:
    """``0.123±0.004``, and the marks of significance unless these are ``ns``; empty without a mean."""
    text = F.format_string("%.3f±%.3f", mean, F.coalesce(half, F.lit(0.0)))
    if marks is not None:
        text = F.concat(text, F.when(F.coalesce(marks, F.lit("ns")) == "ns", "").otherwise(marks))
    return F.when(mean.isNull() | F.isnan(mean), "").otherwise(text)


def display_text(metric: Column, mean: Column) -> Column:
    """As reports print it: MMD in thousandths with two places, RT_s in whole minutes, others with three; not finite: empty."""
    finite = mean.isNotNull() & ~F.isnan(mean) & (F.abs(mean) < float("inf"))
    text = F.when(metric == "MMD", F.format_string("%.2f", mean * 1e3)).when(metric == "RT_s", F.format_string("%.0f", mean / 60.0)).otherwise(F.format_string("%.3f", mean))
    return F.when(finite, text).otherwise("")


def level_number(level: Column) -> Column:
    """``L0``, ``level_0`` and ``0`` as 0; other text: null."""
    return F.nullif(F.regexp_extract(level.cast("string"), r"^(?:L|level_)?(\d+)$", 1), F.lit("")).try_cast("int")


def section_text(section: Column) -> Column:
    """A section's id as text, whole numbers without their ``.0``."""
    return F.regexp_replace(section.cast("string"), r"\.0$", "")


def nominal_size(level: Column, given: int | None, sizes: dict[str, int]) -> Column:
    """The codebook's size: what the caller gives, else the metadata's for the level, else null."""
    known = F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)) if sizes else None
    return F.coalesce(F.lit(given).cast("int"), known[level] if known is not None else F.lit(None).cast("int"))


def code_stack(df: DataFrame, id_: str, cell: list[str], niche: list[str]) -> DataFrame:
    """``(id, place, name, code)``: cell levels, then niche levels, named ``cell.L0`` and so on.

    ``cell`` and ``niche`` list candidate columns; the first that is there is read, a plain number as a stack of one.
    """
    def found(candidates: list[str]) -> Column:
        for c in candidates:
            if c in df.columns:
                return F.col(c) if dict(df.dtypes)[c].startswith("array") else F.array(F.col(c))
        raise KeyError(f"none of {candidates} is there")

    def named(kind: str, stack: Column) -> Column:
        return F.transform(stack, lambda c, k: F.struct(F.concat(F.lit(f"{kind}.L"), k.cast("string")).alias("name"), c.cast("long").alias("code")))

    rows = df.select(F.col(id_).alias("id"), F.posexplode(F.concat(named("cell", found(cell)), named("niche", found(niche)))).alias("place", "c"))
    return rows.select("id", "place", F.col("c.name").alias("name"), F.col("c.code").alias("code"))


def code_sizes(stack: DataFrame) -> DataFrame:
    """``(name, size)``: the largest code of each level and 1."""
    return stack.groupBy("name").agg((F.max("code") + 1).alias("size"))


def usage_rows(stack: DataFrame, names: list[str]) -> DataFrame:
    """Usage of each level of a run by name, and of all together as ``joint`` where there are several."""
    per = [stack.where(F.col("name") == n).select(F.lit(n).alias("level"), F.col("code").cast("string").alias("code")) for n in names]
    if len(names) > 1:
        joint = stack.where(F.col("name").isin(*names)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("c"))  # one row a level
        per.append(joint.select(F.lit("joint").alias("level"), F.array_join(F.transform("c", lambda x: x["code"].cast("string")), "_").alias("code")))
    rows = per[0]
    for more in per[1:]:
        rows = rows.unionByName(more)
    n = rows.groupBy("level", "code").agg(F.count("*").alias("n"))
    total = n.groupBy("level").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return n.join(F.broadcast(total), "level").groupBy("level").agg(F.count("*").alias("used"), F.first("total").alias("n"), F.exp(-F.sum(p * F.log(p))).alias("perplexity"), F.max(p).alias("top_share"))


def labels_present(df: DataFrame, candidates: list[str], every: bool) -> list[str]:
    """The candidate columns that hold a label at all, in order: every one of them, or the first only."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        return []
    held = df.agg(*(F.bool_or(first_valid(F.col(c)).isNotNull()).alias(c) for c in there)).first()
    found = [c for c in there if held[c]]
    return found if every else found[:1]
