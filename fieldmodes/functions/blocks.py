"""Arrow <-> NumPy block helpers used inside Spark tasks, plus the small
dense kernels that run on the driver for m x r / r x r matrices only.

Inside a task an Arrow batch of row vectors becomes one 2-D float64 block,
so the per-row work is a single BLAS call per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class AlignmentError(ValueError):
    """A row vector is NULL, holds NULL cells, or has the wrong length (M9)."""


def list_column_to_matrix(arr, width: int | None = None) -> np.ndarray:
    """Convert an Arrow list<double> column to an (n, m) float64 array.

    Fails loudly on NULL rows, NULL cells or ragged lengths: no GEMM may
    run on misaligned data.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, width or 0))
    if arr.null_count:
        raise AlignmentError("NULL row vector in matrix block")
    offs = arr.offsets.to_numpy()
    lens = np.diff(offs)
    m = int(lens[0])
    if (lens != m).any():
        raise AlignmentError(f"ragged row vectors: lengths {lens.min()}..{lens.max()}")
    if width is not None and m != width:
        raise AlignmentError(f"row vector length {m} != expected {width}")
    flat = arr.flatten()
    if flat.null_count:
        raise AlignmentError("NULL cell inside a row vector")
    x = flat.to_numpy(zero_copy_only=False)
    return np.asarray(x, dtype=np.float64).reshape(n, m)


def matrix_to_list_array(y: np.ndarray) -> pa.Array:
    """(n, k) float64 array -> Arrow list<double> column."""
    y = np.ascontiguousarray(y, dtype=np.float64)
    n, k = y.shape
    offs = pa.array(np.arange(0, n * k + 1, k, dtype=np.int32))
    return pa.ListArray.from_arrays(offs, pa.array(y.reshape(-1)))


def split_rows(acc: np.ndarray, block_rows: int):
    """Yield (block_id, flat block) pieces of an (m, r) partial, row blocks."""
    m = acc.shape[0]
    for b, start in enumerate(range(0, m, block_rows)):
        yield b, acc[start:start + block_rows].reshape(-1)


def assemble_blocks(rows, m: int, r: int, block_rows: int) -> np.ndarray:
    """Rebuild an (m, r) matrix from collected (block_id, data) rows."""
    out = np.zeros((m, r))
    for b, data in rows:
        start = b * block_rows
        blk = np.asarray(data, dtype=np.float64).reshape(-1, r)
        out[start:start + blk.shape[0]] = blk
    return out


def sign_fix(v: np.ndarray) -> np.ndarray:
    """Per column sign (+1/-1) making the largest-|.| entry positive."""
    if v.size == 0:
        return np.ones(v.shape[1] if v.ndim == 2 else 0)
    idx = np.argmax(np.abs(v), axis=0)
    s = np.sign(v[idx, np.arange(v.shape[1])])
    s[s == 0] = 1.0
    return s


def sym_eig_desc(g: np.ndarray):
    """Eigenpairs of a small symmetric matrix, eigenvalues descending."""
    w, vecs = np.linalg.eigh((g + g.T) / 2.0)
    order = np.argsort(-w, kind="stable")
    return w[order], vecs[:, order]


def qr_r(x: np.ndarray) -> np.ndarray:
    """R factor of a thin QR with a non-negative diagonal (unique form)."""
    if x.shape[0] == 0:
        return np.zeros((0, x.shape[1]))
    r = np.linalg.qr(x, mode="r")
    d = np.sign(np.diag(r))
    d[d == 0] = 1.0
    return d[:, None] * r


def stack_r(rs, k: int) -> np.ndarray:
    """Combine partial R factors (each at most k x k) into one R (TSQR step)."""
    blocks = [np.asarray(r, dtype=np.float64).reshape(-1, k) for r in rs]
    blocks = [b for b in blocks if b.shape[0]]
    if not blocks:
        return np.zeros((k, k))
    r = qr_r(np.vstack(blocks))
    if r.shape[0] < k:  # fewer rows than columns overall
        r = np.vstack([r, np.zeros((k - r.shape[0], k))])
    return r
