"""Tables of the annotated-matrix model, and column resolution by candidate names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = T.StructType([
    T.StructField("section_id", T.IntegerType()), T.StructField("cell_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    T.StructField("data_split", T.StringType()), T.StructField("label", T.StringType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("emb", T.ArrayType(T.DoubleType())),
])
EXPR = T.StructType([T.StructField("cell_id", T.LongType()), T.StructField("gene_id", T.LongType()), T.StructField("value", T.DoubleType())])
EDGES = T.StructType([T.StructField("section_id", T.IntegerType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())])
METRIC_LONG = T.StructType([T.StructField("variant", T.StringType()), T.StructField("seed", T.IntegerType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])


def resolve_column(df: DataFrame, candidates: Iterable[str], required: bool = True) -> str | None:
    """The first candidate that is a column of ``df``; the rule for alternative layouts of one field."""
    candidates = list(candidates)
    found = next((c for c in candidates if c in df.columns), None)
    if found is None and required:
        raise KeyError(f"none of {candidates} is among {df.columns}")
    return found


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The projection on exactly these columns; a missing one is an error at plan time."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}")
    return df.select(*columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of ``schema``; absent columns are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
