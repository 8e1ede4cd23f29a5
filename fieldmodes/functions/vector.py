"""Row-vector column expressions.

All of these are built from Spark SQL higher-order functions
(``aggregate``, ``transform``, ``zip_with``), so they run in the JVM next
to the scan; no Python is involved.  A row vector is ``ARRAY<DOUBLE>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _per_element(v: ColumnOrName, scalar: ColumnOrName) -> Column:
    """The row scalar repeated to the row's length.

    A per-row scalar must not be referenced inside a lambda: the optimizer
    may inline its defining expression (e.g. the row mean, itself an
    ``aggregate`` over the row) there, re-evaluating it for every element,
    O(m^2) per row.  As an argument of ``array_repeat`` it is evaluated once
    per row; the lambdas then read it element-wise through ``zip_with``.
    """
    return F.array_repeat(_c(scalar), F.size(_c(v)))


def vsum(v: ColumnOrName) -> Column:
    """Sum of the elements of each row vector (D1 numerator)."""
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x)


def vsumsq(v: ColumnOrName) -> Column:
    """Sum of squares of a row vector (D10 per row)."""
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x * x)


def vmean(v: ColumnOrName) -> Column:
    """Row mean = sum / number of columns (M1)."""
    return vsum(v) / F.size(_c(v))


def vstd_samp(v: ColumnOrName, mean: ColumnOrName | None = None) -> Column:
    """Sample standard deviation (n-1), two-pass around ``mean`` (M2).

    A one-element vector gives NULL, as ``stddev_samp`` does.
    """
    m = vmean(v) if mean is None else _c(mean)
    dev2 = F.zip_with(_c(v), _per_element(v, m), lambda x, mu: (x - mu) * (x - mu))
    ss = F.aggregate(dev2, F.lit(0.0), lambda a, x: a + x)
    n = F.size(_c(v))
    return F.when(n > 1, F.sqrt(ss / (n - 1)))


def vshift(v: ColumnOrName, by: ColumnOrName) -> Column:
    """x - by for every element."""
    return F.zip_with(_c(v), _per_element(v, by), lambda x, b: x - b)


def vscale(v: ColumnOrName, by: ColumnOrName) -> Column:
    """x * by for every element."""
    return F.zip_with(_c(v), _per_element(v, by), lambda x, b: x * b)


def vaffine(v: ColumnOrName, shift: ColumnOrName, div: ColumnOrName) -> Column:
    """(x - shift) / div for every element."""
    sd = F.arrays_zip(_per_element(v, shift).alias("s"), _per_element(v, div).alias("d"))
    return F.zip_with(_c(v), sd, lambda x, p: (x - p["s"]) / p["d"])






def lat_weight(lat_deg: ColumnOrName) -> Column:
    """Area weight of a latitude: abs(cos(latitude)) (E5)."""
    return F.abs(F.cos(F.radians(_c(lat_deg))))


def vfill_null(v: ColumnOrName, fill: ColumnOrName) -> Column:
    """NULL cells replaced by a per-row value (evaluated once per row)."""
    return F.zip_with(_c(v), _per_element(v, fill), lambda x, f: F.coalesce(x, f))
