"""Row statistics and matrix summaries.

All per-row work is a projection over the wide rows (no shuffle); the
matrix-wide numbers are single global aggregates with map-side partials.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.functions.packed import is_packed, is_sparse, merge_blocks
from fieldmodes.functions.vector import vmean, vstd_samp, vsumsq

TASK_BYTES = 8 << 20  # of a persisted matrix that one task scans in a pass
STD_TOL = 1e-4  # M3: rows with std below this are repaired to 1.0


def row_means(mat: DataFrame) -> DataFrame:
    """``(row_id, mean)`` with mean = sum / numCols."""
    return mat.select("row_id", vmean("vector").alias("mean"))


def row_mean_std(mat: DataFrame, tol: float = STD_TOL) -> DataFrame:
    """``(row_id, mean, std, low_std, std_used)``.

    std is the sample (n-1) deviation, two-pass; a one-column row has no
    sample std (NULL) and is treated as 0, so it is flagged and repaired.
    """
    m = mat.select("row_id", "vector", vmean("vector").alias("mean"))
    m = m.select("row_id", "mean", F.coalesce(vstd_samp("vector", "mean"), F.lit(0.0)).alias("std"))
    low = F.col("std") < F.lit(tol)
    return m.select("row_id", "mean", "std", low.alias("low_std"),
                    F.when(low, F.lit(1.0)).otherwise(F.col("std")).alias("std_used"))


def low_std_rows(mat: DataFrame, tol: float = STD_TOL) -> DataFrame:
    """Rows whose std is below ``tol`` (the reference's report, D3)."""
    return row_mean_std(mat, tol).where("low_std").select("row_id", "std")


def matrix_dims(mat: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_cols, min_cols`` (D4); n_cols != min_cols is ragged."""
    rows, size = F.count(F.lit(1)), F.size("vector")
    if is_packed(mat):
        rows, size = F.coalesce(F.sum("n"), F.lit(0)).cast("long"), F.col("m")
    elif is_sparse(mat):
        size = F.col("vector.size")
    return mat.agg(rows.alias("n_rows"), F.max(size).cast("int").alias("n_cols"), F.min(size).cast("int").alias("min_cols"))


def dims(mat: DataFrame) -> tuple[int, int]:
    """(n_rows, n_cols) on the driver; raises if rows are ragged."""
    r = matrix_dims(mat).first()
    if r["n_rows"] == 0:
        return 0, 0
    if r["n_cols"] != r["min_cols"]:
        raise ValueError(f"ragged matrix: row lengths {r['min_cols']}..{r['n_cols']}")
    return int(r["n_rows"]), int(r["n_cols"])


def frobenius2(mat: DataFrame) -> DataFrame:
    """One row: squared Frobenius norm = total variance numerator."""
    return mat.agg(F.sum(vsumsq("vector")).alias("frobenius2"))


def col_means(mat: DataFrame) -> DataFrame:
    """``(col_pos, mean)`` of every column.

    Exploded cells are summed map-side per task (partial aggregate), so the
    shuffle carries at most one partial per column per task.
    """
    cells = mat.select(F.posexplode("vector").alias("col_pos", "value"))
    return cells.groupBy(F.col("col_pos").cast("int").alias("col_pos")).agg(F.avg("value").alias("mean"))


def materialize(mat: DataFrame) -> DataFrame:
    """Persist and force a matrix that several passes will scan."""
    return materialize_dims(mat)[0]


def materialize_dims(mat: DataFrame) -> tuple[DataFrame, int, int]:
    """Persist a matrix and measure it in the same job: (mat, n_rows, n_cols).

    A matrix in many small partitions (one per shuffle partition of the plan that made it, however few its rows) is
    kept in as few as hold TASK_BYTES each: a pass costs a Python task per partition."""
    mat = mat.persist(StorageLevel.MEMORY_AND_DISK)
    n, m = dims(mat)
    size = mat.agg(F.sum(F.length("pos") + F.length("val") + F.length("turn") + 20 * F.col("n"))).first()[0] or 0 if is_packed(mat) else 8 * n * m
    parts = max(1, -(-size // TASK_BYTES))
    if 2 * parts < mat.rdd.getNumPartitions():
        few = mat.coalesce(parts)
        few = (merge_blocks(few) if is_packed(mat) else few).persist(StorageLevel.MEMORY_AND_DISK)
        few.count()
        mat.unpersist()
        mat = few
    return mat, n, m
