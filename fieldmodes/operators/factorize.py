"""Truncated SVD / EOFs of a distributed row matrix.

A is n x m (n locations as rows, m times as columns, n >> m).  Both
methods find the top right singular vectors V (m x k, small, driver) with
passes over A, then refine sigma by a TSQR of A V (Rayleigh-Ritz) and
leave U = A V diag(1/sigma) as a *lazy distributed* DataFrame.

exact       block Krylov iteration on 1/n A^T A to a tolerance, the same at
            every width; ``product`` says whether each step is a distributed
            pass or a product with the Gram formed in one pass.
            ``solver='mllib'``: ``IndexedRowMatrix.computeSVD`` instead.  MLlib
            solves fields below 100 columns on the driver.
randomized  Gaussian start, q rounds of ``1/n A^T A Y`` + QR (one pass each),
            then Rayleigh-Ritz (fixes the reference's zero product and
            arbitrary truncation, defects 1-2).
Passes over A: exact one per step + 1, randomized q + 1 (plus the U output when written).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmodes.functions.blocks import sign_fix, sym_eig_desc
from fieldmodes.functions.packed import is_sparse, pack
from fieldmodes.operators.products import cov_multiply, gram, right_multiply, tsqr_r
from fieldmodes.operators.stats import dims, materialize_dims

RANK_TOL = 1e-9  # components with sigma <= RANK_TOL * sigma_1 are dropped
# Reference defaults (fixed values): oversampling 5, 10 power rounds.
OVERSAMPLE = 5
POWER_ITERS = 10


@dataclass
class EOFResult:
    """U (distributed), S, V (small) of a truncated SVD A ~ U diag(S) V^T."""
    u: DataFrame | None           # row_id, vector[k]  (lazy)
    s: np.ndarray                 # k singular values of A, descending
    v: np.ndarray                 # m x k right vectors (temporal EOFs)
    n_rows: int
    n_cols: int
    k_requested: int
    method: str
    converged: bool | None = None  # None: a method of a fixed number of rounds
    iterations: int = 0            # products with A^T A
    residual: float | None = None  # max ||C v - lambda v|| / lambda_1 of the returned vectors
    info: dict = field(default_factory=dict)

    @property
    def n_computed(self) -> int:
        return int(len(self.s))

    @property
    def eigenvalues(self) -> np.ndarray:
        """Eigenvalues of the covariance operator 1/n A^T A (M6)."""
        return self.s ** 2 / max(self.n_rows, 1)

    def s_df(self, spark: SparkSession) -> DataFrame:
        rows = [(int(i), float(s), float(e)) for i, (s, e) in enumerate(zip(self.s, self.eigenvalues))]
        return spark.createDataFrame(rows, "component int, sigma double, eigenvalue double")

    def v_df(self, spark: SparkSession) -> DataFrame:
        rows = [(int(j), int(c), float(self.v[j, c])) for j in range(self.v.shape[0]) for c in range(self.v.shape[1])]
        return spark.createDataFrame(rows, "col_pos int, component int, value double")

    def u_long(self) -> DataFrame:
        return self.u.select("row_id", F.posexplode("vector").alias("component", "value")).select(
            "row_id", F.col("component").cast("int"), "value")


def _check_k(k: int, m: int, method: str):
    if k < 1:
        raise ValueError("k must be >= 1")
    if method == "exact" and k >= m:
        # M8: the Krylov method of the reference needs k < number of columns.
        raise ValueError(f"exact EOFs need k < number of columns (k={k}, columns={m})")
    if k > m:
        raise ValueError(f"k={k} exceeds the number of columns {m}")


def _finish(mat: DataFrame, basis: np.ndarray, k: int, n: int, m: int, method: str, **info) -> EOFResult:
    """Rayleigh-Ritz on span(basis): TSQR of A basis, SVD of the small R,
    rank cut, sign rule, and the lazy U = A V / sigma (F3, F9, B9, M11)."""
    l = basis.shape[1]
    r = tsqr_r(mat, l, rhs=basis)
    _, sig, wt = np.linalg.svd(r)
    v = basis @ wt.T
    keep = min(k, int(np.sum(sig > RANK_TOL * sig[0])) if sig.size and sig[0] > 0 else 0)
    sig, v = sig[:keep], v[:, :keep]
    v = v * sign_fix(v)[None, :] if keep else v
    u = right_multiply(mat, v / sig[None, :]) if keep else None
    return EOFResult(u=u, s=sig, v=v, n_rows=n, n_cols=m, k_requested=k, method=method, **info)


def start_block(m: int, k: int, seed: int | None = 0, start: np.ndarray | None = None) -> np.ndarray:
    """The first block of ``krylov_eigs``: k + OVERSAMPLE orthonormal columns, the leading ones spanning ``start``.

    If two such blocks span the whole space, it is one block that does: one product in place of two."""
    b = k + OVERSAMPLE
    b = m if m <= 2 * b else b
    y = gaussian_start(m, b, seed)
    if start is not None:
        y[:, :start.shape[1]] = start[:, :b]
    return np.linalg.qr(y)[0]


def krylov_eigs(apply, m: int, k: int, tol: float, max_iter: int, seed: int | None = 0,
                start: np.ndarray | None = None, max_blocks: int = 8):
    """Top-k eigenpairs of a symmetric operator by block Krylov iteration with Rayleigh-Ritz.

    ``apply(y)`` multiplies an m x b block.  After each product the Ritz pairs
    and their exact residuals come from the stored products; past ``max_blocks``
    blocks the basis restarts from the leading Ritz vectors.  Driver memory:
    2 x max_blocks blocks as ``start_block`` makes them.
    Returns (vectors, values, products, residual, converged)."""
    y = start_block(m, k, seed, start)
    b = y.shape[1]
    q, cq = np.zeros((m, 0)), np.zeros((m, 0))
    done = 0
    while True:
        w = apply(y)
        done += 1
        q, cq = np.hstack([q, y]), np.hstack([cq, w])
        lam, s = sym_eig_desc(q.T @ cq)
        lam_k, v = lam[:k], q @ s[:, :k]
        scale = max(abs(lam[0]), np.finfo(float).tiny)
        res = float(np.max(np.linalg.norm(cq @ s[:, :k] - v * lam_k, axis=0)) / scale)
        if res <= tol or done >= max_iter:
            return v, lam_k, done, res, res <= tol
        for _ in range(2):  # twice is enough
            w = w - q @ (q.T @ w)
        y, r = np.linalg.qr(w)
        y = y[:, np.abs(np.diag(r)) > 1e-12 * scale]
        if q.shape[1] + y.shape[1] > m or not y.shape[1]:  # the basis spans all there is
            return v, lam_k, done, res, res <= max(tol, 1e-8)
        y = np.linalg.qr(y - q @ (q.T @ y))[0]
        if q.shape[1] + y.shape[1] > max_blocks * b:
            keep = s[:, :2 * b]
            q, cq = q @ keep, cq @ keep


def eof_exact(mat: DataFrame, k: int, tol: float = 1e-10, max_iter: int = 300, product: str = "distributed",
              solver: str = "krylov", n_rows: int | None = None, n_cols: int | None = None,
              seed: int | None = 0) -> EOFResult:
    """Exact top-k EOFs (F1, F7), iterated until every residual is below ``tol`` x lambda_1.

    ``mat`` should be persisted by the caller.  If ``max_iter`` products do not
    suffice, the result says ``converged=False`` and a warning is raised."""
    if n_rows is None or n_cols is None:
        n_rows, n_cols = dims(mat)
    _check_k(k, n_cols, "exact")
    if solver == "mllib":
        basis = _mllib_right_vectors(mat, k, n_rows, n_cols)
        cv = cov_multiply(mat, basis, n_rows)
        lam = np.sum(basis * cv, axis=0)
        res = float(np.max(np.linalg.norm(cv - basis * lam, axis=0)) / max(lam.max(initial=0.0), np.finfo(float).tiny))
        done, ok = 1, res <= max(tol, 1e-8)
    elif solver == "krylov":
        basis, _, done, res, ok = krylov_eigs(_product(mat, product, n_rows, n_cols), n_cols, k, tol, max_iter, seed)
    else:
        raise ValueError("solver must be 'krylov' or 'mllib'")
    if not ok:
        warnings.warn(f"exact EOFs not converged: residual {res:.2e} > {tol:.2e} after {done} products", stacklevel=2)
    return _finish(mat, basis, k, n_rows, n_cols, "exact", iterations=done, residual=res, converged=ok, info={"product": product, "solver": solver})


def _product(mat: DataFrame, product: str, n_rows: int, n_cols: int):
    """y -> 1/n A^T A y: a pass over A each time, or the Gram of one pass."""
    if product == "distributed":
        return lambda y: cov_multiply(mat, y, n_rows)
    if product == "gram":
        cov = gram(mat, n_cols, n_rows) / max(n_rows, 1)
        return lambda y: cov @ y
    raise ValueError("product must be 'distributed' or 'gram'")


def _mllib_right_vectors(mat: DataFrame, k: int, n: int, m: int) -> np.ndarray:
    """Top-k right singular vectors via MLlib (its own tolerance; the caller checks the residual)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix
    from pyspark.mllib.util import MLUtils

    df = mat.select(F.col("row_id").alias("index"), array_to_vector("vector").alias("vector"))
    df = MLUtils.convertVectorColumnsFromML(df, "vector")
    irm = IndexedRowMatrix(df, numRows=n, numCols=m)
    svd = irm.computeSVD(k, computeU=False, rCond=RANK_TOL)
    return np.asarray(svd.V.toArray())


def gaussian_start(m: int, l: int, seed: int | None) -> np.ndarray:
    """m x l standard normal block (F8); seeded (fixes M13)."""
    return np.random.default_rng(seed).standard_normal((m, l))


def eof_randomized(mat: DataFrame, k: int, oversample: int = OVERSAMPLE, power_iters: int = POWER_ITERS,
                   seed: int | None = 0, n_rows: int | None = None, n_cols: int | None = None,
                   product: str = "distributed") -> EOFResult:
    """Randomized top-k EOFs (F2): q rounds of 1/n A^T A Y + QR, then Rayleigh-Ritz.

    product  'distributed': one pass over A per round, at every width;
             'gram': one pass forms A^T A, the rounds run on the m x m Gram.
    """
    if n_rows is None or n_cols is None:
        n_rows, n_cols = dims(mat)
    _check_k(k, n_cols, "randomized")
    y = np.linalg.qr(gaussian_start(n_cols, min(k + oversample, n_cols), seed))[0]
    apply = _product(mat, product, n_rows, n_cols)
    for _ in range(power_iters):
        y = np.linalg.qr(apply(y))[0]
    return _finish(mat, y, k, n_rows, n_cols, "randomized", iterations=power_iters, info={"product": product})


def to_eofs(u: DataFrame, fat: np.ndarray) -> EOFResult:
    """Low-rank factor pair (U_lr distributed, fat k x m) -> EOFs.

    SVD of the small fat factor; U = U_lr Us stays distributed.
    """
    us, s, vt = np.linalg.svd(np.asarray(fat, dtype=np.float64), full_matrices=False)
    v = vt.T
    sg = sign_fix(v)
    v, us = v * sg[None, :], us * sg[None, :]
    return EOFResult(u=right_multiply(u, us), s=s, v=v, n_rows=-1, n_cols=v.shape[0],
                     k_requested=len(s), method="factor")


def compute_eofs(mat: DataFrame, k: int, method: str = "exact", **kw) -> EOFResult | dict:
    """Method dispatch (F4): 'exact', 'randomized' or 'both'."""
    if method == "exact":
        return eof_exact(mat, k, **{a: b for a, b in kw.items() if a in ("tol", "max_iter", "product", "solver", "seed", "n_rows", "n_cols")})
    if method == "randomized":
        return eof_randomized(mat, k, **{a: b for a, b in kw.items()
                                         if a in ("oversample", "power_iters", "seed", "n_rows", "n_cols", "product")})
    if method == "both":
        n, m = kw.get("n_rows"), kw.get("n_cols")
        if n is None or m is None:
            n, m = dims(mat)
        kw.update(n_rows=n, n_cols=m)
        return {"exact": compute_eofs(mat, k, "exact", **kw),
                "inexact": compute_eofs(mat, k, "randomized", **kw)}
    raise ValueError(f"unknown method {method!r}; expected 'exact', 'randomized' or 'both'")


def top_eigenpairs(mat: DataFrame, k: int, **kw) -> tuple[np.ndarray, np.ndarray]:
    """Top-k eigenpairs of 1/n A^T A, descending."""
    r = eof_exact(mat, k, **kw)
    return r.eigenvalues, r.v


def project_spatial(mat: DataFrame, v: np.ndarray, s: np.ndarray) -> DataFrame:
    """Spatial patterns from temporal ones: U = A V / sigma."""
    s = np.asarray(s, dtype=np.float64)
    return right_multiply(mat, np.asarray(v) / s[None, :])


def describe_eofs(res: EOFResult, spark: SparkSession, total_ss: float | None = None) -> DataFrame:
    """Shape report (F12) plus eigenvalue and explained-variance share."""
    rows = []
    for i, s in enumerate(res.s):
        ev = float(s * s / total_ss) if total_ss else None
        rows.append((i, float(s), float(s * s / max(res.n_rows, 1)), ev, res.n_rows, res.n_cols, res.n_computed))
    return spark.createDataFrame(rows, "component int, sigma double, eigenvalue double, explained double, "
                                       "u_rows bigint, v_rows bigint, n_computed int")


def run_eofs(mat: DataFrame, k: int, method: str = "exact", persist: bool = True, **kw):
    """Persist the matrix once, then factorize (the reference's cache + count).  Sparse rows are persisted packed."""
    if persist:
        mat, n, m = materialize_dims(pack(mat) if is_sparse(mat) else mat.select("row_id", "vector"))
        kw.setdefault("n_rows", n)
        kw.setdefault("n_cols", m)
    return compute_eofs(mat, k, method, **kw), mat
