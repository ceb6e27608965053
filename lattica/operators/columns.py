"""Which columns of a table hold batches and which hold labels, by name and number of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: parts of names that hint at a batch or at a label, and the bounds of distinct values
BATCH_HINTS = ("batch", "section", "sample", "donor", "slide", "assay", "library", "fov_batch")
LABEL_HINTS = ("cell_type", "celltype", "cell_class", "subclass", "annotation", "niche", "region", "domain", "cluster", "leiden", "tissue", "molecular", "label")
LEAST_CLASSES, MOST_BATCHES, MOST_CLASSES = 2, 50, 500

#: Relative deviation of the sketches, and how many of these an estimate may be off.
DEVIATION, SURE = 0.02, 5


def distinct_counts(df: DataFrame, names: list[str], bounds: tuple[int, ...]) -> dict[str, int]:
    """Distinct values, null and NaN left out, of each column: by mergeable sketches in one pass over all, and exactly where the estimate lies so near one of ``bounds`` that it could be on the other side."""
    if not names:
        return {}
    kinds = dict(df.dtypes)
    value = {c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in names}
    about = df.agg(*(F.approx_count_distinct(value[c], DEVIATION).alias(f"c{i}") for i, c in enumerate(names))).first()
    found = dict(zip(names, about, strict=True))
    near = [c for c in names if any(abs(found[c] - b) <= 1 + SURE * DEVIATION * b for b in bounds)]
    if near:
        found |= dict(zip(near, df.agg(*(F.count_distinct(value[c]).alias(f"c{i}") for i, c in enumerate(near))).first(), strict=True))
    return found


def column_roles(df: DataFrame, labels: list[str] | None = None) -> dict[str, str]:
    """``batch`` or ``label`` for the columns that are one: a batch has a batch's name and 2 to 50 values, a label a label's name and 2 to 500, and isn't a batch.

    ``labels``, if given, are the labels instead. Columns of arrays, maps and structs are neither. An empty table has neither.
    """
    plain = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
    hinted = lambda c, hints: any(h in c.lower() for h in hints)
    counts = distinct_counts(df, [c for c in plain if hinted(c, (*BATCH_HINTS, *(() if labels is not None else LABEL_HINTS)))], (LEAST_CLASSES, MOST_BATCHES, MOST_CLASSES))
    out = {c: "batch" for c in counts if hinted(c, BATCH_HINTS) and LEAST_CLASSES <= counts[c] <= MOST_BATCHES}
    if labels is not None:
        return out | {c: "label" for c in labels}
    return out | {c: "label" for c in counts if c not in out and hinted(c, LABEL_HINTS) and LEAST_CLASSES <= counts[c] <= MOST_CLASSES}
