"""Row preprocessing before factorization.

Every method is one narrow projection over the wide rows; the only
shuffle is the optional weights lookup join (C9).  The result keeps the
statistics as columns of the rows themselves (never collected):

    row_id BIGINT, vector ARRAY<DOUBLE>, mean DOUBLE, std DOUBLE, weight DOUBLE
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.functions.packed import is_sparse
from fieldmodes.functions.vector import vaffine, vmean, vscale, vshift, vstd_samp
from fieldmodes.operators.stats import STD_TOL

# Reference method names (fixed values) and short aliases.
CENTER = "centerOverAllObservations"
STANDARDIZE = "standardizeEach"
COSLAT_CENTER = "cosLat+centerOverAllObservations"
_ALIASES = {"center": CENTER, "standardize": STANDARDIZE, "coslat": COSLAT_CENTER,
            CENTER: CENTER, STANDARDIZE: STANDARDIZE, COSLAT_CENTER: COSLAT_CENTER, "none": "none"}


@dataclass
class Preprocessed:
    """Preprocessed matrix plus what was done to it."""
    rows: DataFrame      # row_id, vector, mean, std, weight
    method: str

    @property
    def mat(self) -> DataFrame:
        return self.rows.select("row_id", "vector")

    @property
    def row_stats(self) -> DataFrame:
        return self.rows.select("row_id", "mean", "std")


def center_rows(mat: DataFrame) -> DataFrame:
    """x - row mean (E1); a sparse row keeps its entries, and its mean also leaves what lies between them."""
    if is_sparse(mat):
        v = F.col("vector")
        mean = (F.aggregate(v["val"], F.lit(0.0), lambda a, x: a + x) + v["fill"] * (v["size"] - F.size(v["val"]))) / v["size"]
        m = mat.select("row_id", "vector", mean.alias("mean"))
        moved = F.struct(v["size"].alias("size"), (v["fill"] - F.col("mean")).alias("fill"), v["pos"].alias("pos"), vshift("vector.val", "mean").alias("val"))
        return m.select("row_id", moved.alias("vector"), "mean")
    m = mat.select("row_id", "vector", vmean("vector").alias("mean"))
    return m.select("row_id", vshift("vector", "mean").alias("vector"), "mean")


def standardize_rows(mat: DataFrame, tol: float = STD_TOL) -> DataFrame:
    """(x - mean) / std, low-std rows repaired to std 1.

    Narrow: the stats come from the row itself, no join.
    """
    m = mat.select("row_id", "vector", vmean("vector").alias("mean"))
    m = m.withColumn("std", F.coalesce(vstd_samp("vector", "mean"), F.lit(0.0)))
    m = m.withColumn("low_std", F.col("std") < F.lit(tol))
    m = m.withColumn("std", F.when(F.col("low_std"), F.lit(1.0)).otherwise(F.col("std")))
    return m.select("row_id", vaffine("vector", "mean", "std").alias("vector"), "mean", "std", "low_std")


def attach_weights(mat: DataFrame, weights: DataFrame) -> DataFrame:
    """Left-join per-row weights; a row without weight gets 0."""
    w = weights.select(F.col("row_id").cast("long").alias("row_id"), F.col("weight").cast("double").alias("weight"))
    return mat.join(w, "row_id", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def weight_rows(mat: DataFrame, weights: DataFrame) -> DataFrame:
    """x * weight (E3); rows without a weight become 0."""
    j = attach_weights(mat, weights)
    return j.select("row_id", vscale("vector", "weight").alias("vector"), "weight")


def preprocess(mat: DataFrame, method: str, weights: DataFrame | None = None,
               tol: float = STD_TOL) -> Preprocessed:
    """Dispatch on the reference's method names."""
    if method not in _ALIASES:
        raise ValueError(f"unknown preprocess method {method!r}; expected one of {sorted(set(_ALIASES))}")
    name = _ALIASES[method]
    if name == "none":
        rows = mat.select("row_id", "vector", F.lit(None).cast("double").alias("mean"),
                          F.lit(None).cast("double").alias("std"), F.lit(None).cast("double").alias("weight"))
    elif name == CENTER:
        c = center_rows(mat)
        rows = c.select("row_id", "vector", "mean", F.lit(None).cast("double").alias("std"),
                        F.lit(None).cast("double").alias("weight"))
    elif name == STANDARDIZE:
        s = standardize_rows(mat, tol)
        rows = s.select("row_id", "vector", "mean", "std", F.lit(None).cast("double").alias("weight"))
    else:
        if weights is None:
            raise ValueError("cosLat preprocessing needs a weights table (row_id, weight)")
        c = attach_weights(center_rows(mat), weights)
        # M5: centered row and its mean are both multiplied by the weight.
        rows = c.select("row_id", vscale("vector", "weight").alias("vector"),
                        (F.col("mean") * F.col("weight")).alias("mean"),
                        F.lit(None).cast("double").alias("std"), "weight")
    return Preprocessed(rows=rows, method=name)
