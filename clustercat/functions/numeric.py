"""Missing values, casts, and the cell a value falls into."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def clean(c: Column) -> Column:
    """NaN to NULL, so that comparisons drop it and aggregates skip it."""
    return F.nanvl(c, F.lit(None))


def clean_floats(df: DataFrame) -> DataFrame:
    """Apply :func:`clean` to every floating-point column."""
    return df.select(
        [
            clean(F.col(f"`{name}`")).alias(name) if kind in ("double", "float") else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def coerce(c: Column) -> Column:
    """To double; text that is no number becomes NULL."""
    return clean(c.try_cast("double"))


def strict(c: Column) -> Column:
    """To double; text that is no number is an error."""
    return clean(c.cast("double"))


def finite(c: Column) -> Column:
    """True for values that are neither missing nor infinite."""
    return clean(c).isNotNull() & (F.abs(c) < F.lit(INFINITY))


def bin_edge(lo: Column, hi: Column, bins: int, i: Column) -> Column:
    """Edge ``i`` of ``bins`` equal bins; the last edge is ``hi`` itself."""
    return F.when(i == bins, hi).otherwise(lo + i * ((hi - lo) / bins))


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of ``x``: bins are half open, the last one is closed.

    The quotient may land one bin off at an edge, so it is checked against the
    edges themselves.
    """
    i = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return (
        F.when(x < bin_edge(lo, hi, bins, i), i - 1)
        .when((i < bins - 1) & (x >= bin_edge(lo, hi, bins, i + 1)), i + 1)
        .otherwise(i)
    )


def hex_rows(gridsize: int) -> int:
    """Rows of a hexagonal grid with ``gridsize`` columns."""
    return int(gridsize / math.sqrt(3))


def hex_lattice(u: Column, v: Column) -> Column:
    """1 if the whole-number lattice point is nearest to (u, v), 2 for the offset one."""
    d1 = F.pow(u - F.rint(u), 2) + 3.0 * F.pow(v - F.rint(v), 2)
    d2 = F.pow(u - F.floor(u) - 0.5, 2) + 3.0 * F.pow(v - F.floor(v) - 0.5, 2)
    return F.when(d1 < d2, 1).otherwise(2)
