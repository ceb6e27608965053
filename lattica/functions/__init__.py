"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` in doubles, null where ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def x_log_x(p: Column) -> Column:
    """``p * ln p`` with its limit 0 at 0."""
    return F.when(p > 0, p * F.ln(p)).otherwise(0.0)


def pairs_of(n: Column) -> Column:
    """Unordered pairs among ``n``."""
    n = n.cast("double")
    return n * (n - 1) / 2.0


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of doubles."""
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def missing_label(label: Column) -> Column:
    """A label with NaN, ``nan`` and ``None`` as null."""
    text = label.cast("string")
    return F.when(text.isin("nan", "NaN", "None"), F.lit(None)).otherwise(text)


def sanitised(name: Column) -> Column:
    """A name safe for files: runs of other characters become ``_``, which the ends lose; ``sample`` if nothing is left."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^_+|_+$", ""), F.lit("")), F.lit("sample"))


def mixed_radix(codes: Column, sizes: list[int]) -> Column:
    """One number of a stack of codes with nominal sizes: ``(c0 * K1 + c1) * K2 + ...``."""
    out = codes[0].cast("long")
    for level, size in enumerate(sizes[1:], 1):
        out = out * size + codes[level]
    return out


def clamped_codes(codes: Column, sizes: list[int], known: Column) -> Column:
    """Each code within its size; the size itself (an id of its own) where the row isn't known."""
    parts = [F.when(known, F.greatest(F.lit(0), F.least(codes[k], F.lit(size - 1)))).otherwise(size) for k, size in enumerate(sizes)]
    return F.array(*parts)


def position_encoding(x: Column, y: Column, dim: int = 16) -> Column:
    """2-D sinusoidal code: for x, then y, sines and cosines at ``dim / 4`` falling frequencies."""
    if dim % 4:
        raise ValueError("dim must be a multiple of 4")
    n = dim // 4
    parts = []
    for axis in (x, y):
        for f in (F.sin, F.cos):
            parts += [f(axis * float(10000.0 ** (-k / n))) for k in range(n)]
    return F.array(*parts)


def runtime_text(seconds: Column) -> Column:
    """Seconds, minutes or hours with one decimal; n/a for missing and negative ones."""
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "n/a")
        .when(seconds < 60, F.format_string("%.1f s", seconds))
        .when(seconds < 3600, F.format_string("%.1f min", seconds / 60.0))
        .otherwise(F.format_string("%.1f h", seconds / 3600.0))
    )


def printed_value(text: Column) -> tuple[Column, Column]:
    """``0.413***`` as its number and its stars."""
    number = F.regexp_extract(text, r"^\s*(-?[0-9.]+)", 1)
    return F.nullif(number, F.lit("")).try_cast("double"), F.regexp_extract(text, r"(\*+|ns)\s*$", 1)


def stars(p: Column) -> Column:
    """Significance marks; n/a where the test has no answer."""
    return F.when(p.isNull() | F.isnan(p), "n/a").when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").otherwise("ns")
