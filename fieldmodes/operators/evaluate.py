"""Quality of a decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.functions.blocks import list_column_to_matrix
from fieldmodes.operators.products import arrow_batch_guard


def sse(mat: DataFrame, u: DataFrame, s: np.ndarray, v: np.ndarray) -> DataFrame:
    """sum_i ||a_i - (U diag(s) V^T)_i||^2 with U distributed.

    U is joined to the rows on row_id (both sides shuffled on the key);
    V diag(s) is broadcast; the residual is one GEMM per Arrow batch and
    partial sums are combined by a global aggregate."""
    w = np.asarray(v, dtype=np.float64) * np.asarray(s, dtype=np.float64)[None, :]
    arrow_batch_guard(mat.sparkSession)
    bc = mat.sparkSession.sparkContext.broadcast(w)
    m, k = w.shape
    j = mat.select("row_id", "vector").join(u.select("row_id", F.col("vector").alias("uvec")), "row_id", "left")

    def per_batch(batches):
        wv = bc.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = list_column_to_matrix(batch.column("vector"), m)
            uc = batch.column("uvec")
            if uc.null_count:  # a row without U is reconstructed as 0
                uu = np.zeros((batch.num_rows, k))
                valid = ~np.asarray(uc.is_null())
                uu[valid] = list_column_to_matrix(uc.filter(pa.array(valid)), k)
            else:
                uu = list_column_to_matrix(uc, k)
            r = x - uu @ wv.T
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sum(r * r))])], names=["sse"])

    return j.mapInArrow(per_batch, "sse double").agg(F.sum("sse").alias("sse"))


def sse_projection(mat: DataFrame, v: np.ndarray) -> DataFrame:
    """SSE of the projection onto span(V): ||A - A V V^T||^2, no join."""
    v = np.asarray(v, dtype=np.float64)
    arrow_batch_guard(mat.sparkSession)
    bc = mat.sparkSession.sparkContext.broadcast(v)
    m = v.shape[0]

    def per_batch(batches):
        vv = bc.value
        for batch in batches:
            if batch.num_rows:
                x = list_column_to_matrix(batch.column("vector"), m)
                r = x - (x @ vv) @ vv.T
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sum(r * r))])], names=["sse"])

    return mat.select("vector").mapInArrow(per_batch, "sse double").agg(F.sum("sse").alias("sse"))


def compare_projected(mat: DataFrame, a, b) -> dict:
    """D8 and F10 in one scan of A, for factors whose U is A V diag(1/s), as the solvers here return it.

    Each batch computes both U in place, their raw and sign-aligned differences
    and both residuals ||A - U diag(s) V^T||^2; a task sends four sums.  No U
    table, no join, no shuffle of A.  Same keys as ``compare_factors``, plus ``sse_a``, ``sse_b``."""
    k = min(a.n_computed, b.n_computed)
    small, sign = _compare_small(a, b, k)
    va, vb = np.asarray(a.v[:, :k], dtype=np.float64), np.asarray(b.v[:, :k], dtype=np.float64)
    inv = [np.divide(1.0, s, out=np.zeros(k), where=s > 0) for s in (np.asarray(a.s[:k], dtype=np.float64), np.asarray(b.s[:k], dtype=np.float64))]
    arrow_batch_guard(mat.sparkSession)
    bc = mat.sparkSession.sparkContext.broadcast((va, vb))
    m = va.shape[0]

    def per_task(batches):
        wa, wb = bc.value
        total = np.zeros(4)
        for batch in batches:
            if batch.num_rows:
                x = list_column_to_matrix(batch.column("vector"), m)
                pa_, pb_ = x @ wa, x @ wb
                ua, ub = pa_ * inv[0], pb_ * inv[1]
                ra, rb = x - pa_ @ wa.T, x - pb_ @ wb.T
                total += [np.sum((ua - ub) ** 2), np.sum((ua - ub * sign) ** 2), np.sum(ra * ra), np.sum(rb * rb)]
        yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total.tolist()], names=["raw", "aligned", "sse_a", "sse_b"])

    d = mat.select("vector").mapInArrow(per_task, "raw double, aligned double, sse_a double, sse_b double").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("raw", "aligned", "sse_a", "sse_b")]).first()
    bc.unpersist()
    return {"u_frobenius_diff": float(np.sqrt(d["raw"])), "u_frobenius_diff_aligned": float(np.sqrt(d["aligned"])),
            "sse_a": d["sse_a"], "sse_b": d["sse_b"], **small}


def _compare_small(a, b, k: int) -> tuple[dict, np.ndarray]:
    """The part of a comparison that needs S and V only, and the sign of each component of ``b``."""
    sa, sb = np.asarray(a.s[:k]), np.asarray(b.s[:k])
    va, vb = np.asarray(a.v[:, :k]), np.asarray(b.v[:, :k])
    sign = np.sign(np.sum(va * vb, axis=0))
    sign[sign == 0] = 1.0
    return {
        "v_frobenius_diff": float(np.linalg.norm(va - vb)),
        "s_l2_diff": float(np.linalg.norm(sa - sb)),
        "v_frobenius_diff_aligned": float(np.linalg.norm(va - vb * sign[None, :])),
        "subspace_cosines_min": float(np.min(np.linalg.svd(va.T @ vb, compute_uv=False))) if k else 1.0,
        "k": k,
    }, sign


def compare_factors(a, b) -> dict:
    """||U1-U2||_F, ||V1-V2||_F, ||S1-S2||_2 plus sign-invariant versions.

    U tables are compared by a full outer join on (row_id, component), so
    neither is collected; V and S are small."""
    k = min(a.n_computed, b.n_computed)
    ua = a.u_long().where(F.col("component") < k).withColumnRenamed("value", "a")
    ub = b.u_long().where(F.col("component") < k).withColumnRenamed("value", "b")
    small, sign = _compare_small(a, b, k)
    signs = F.array(*[F.lit(float(x)) for x in sign])
    j = ua.join(ub, ["row_id", "component"], "full").fillna(0.0, ["a", "b"])
    d = j.agg(F.sum((F.col("a") - F.col("b")) ** 2).alias("raw"),
              F.sum((F.col("a") - F.col("b") * signs[F.col("component")]) ** 2).alias("aligned")).first()
    return {"u_frobenius_diff": float(np.sqrt(d["raw"] or 0.0)), "u_frobenius_diff_aligned": float(np.sqrt(d["aligned"] or 0.0)), **small}
