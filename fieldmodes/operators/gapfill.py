"""DINEOF gap filling (E7): infer missing cells by iterated truncated EOF
reconstruction (Beckers & Rixen 2003).

Round 0 fills each missing cell with its row mean.  Each round computes the
top-k temporal EOFs V of the row-centered current field (one solver at every
width, started from the last V) and replaces only the missing cells by the
rank-k reconstruction mean + (x - mean) V V^T, until the RMS change of the
filled cells drops below ``tol``.

Rows are packed into blocks (values and gaps as bytes) where they lie, and the blocks dealt evenly to few partitions.
A row's filling follows from the V of the rounds so far, so a pass works it out where the row lies and a round writes
nothing: the pass that gives its change also gives the first product of the next round (with ``product='gram'`` the
Gram), which is the only one of a field that ``start_block`` spans.  Every SAVE_EVERY plain
rounds the blocks as filled by then, in the shared folder, take the place of those before, which bounds what a pass repeats.

``accelerate=True`` reaches the same fixed points in fewer rounds.  Given V, a row's
mean and coefficients are solved for at once (least squares on its observed
cells, where the plain rounds lead); what is left to iterate is V alone, an
m x k matrix on the driver, and Anderson mixing of its last ``WINDOW`` rounds
takes the place of the plain step.

More EOFs than the field holds have no finite fixed point: the filled cells
run away.  ``dineof_select`` chooses their number as the method's authors do,
by cells set aside.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.functions.blocks import AlignmentError, matrix_to_list_array, sym_eig_desc
from fieldmodes.operators.factorize import krylov_eigs, start_block
from fieldmodes.operators.products import GRAM_MAX_COLS, _sum_partials, arrow_batch_guard
from fieldmodes.operators.stats import TASK_BYTES
from fieldmodes.session import delete_path, scratch_path


def _with_gaps(arr: pa.Array, m: int) -> np.ndarray:
    """list<double> column -> (n, m) array, NULL cells as NaN."""
    if arr.null_count:
        raise AlignmentError("NULL row vector in matrix block")
    if len(arr) and (pc.list_value_length(arr).to_numpy() != m).any():
        raise AlignmentError(f"row vectors are not all of length {m}")
    return pc.fill_null(arr.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), m)


SAVE_EVERY = 16            # plain rounds that a pass works out again
BLOCK_BYTES = 1 << 20      # of a block's values
_BLOCK = "n int, ids binary, x binary, gap binary"


def _pack(mat: DataFrame, m: int) -> DataFrame:
    """Blocks of rows (row ids, values with each gap at its row's mean, gaps); rows without an id are left out."""
    step = max(1, BLOCK_BYTES // (8 * max(m, 1)))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                x = _with_gaps(b.column("vector"), m)
                gap = np.isnan(x)
                seen = np.maximum((~gap).sum(axis=1, keepdims=True), 1)
                x = np.where(gap, np.where(gap, 0.0, x).sum(axis=1, keepdims=True) / seen, x)
                yield _block(np.asarray(b.column("row_id"), dtype=np.int64), x, gap)
    return mat.where(F.col("row_id").isNotNull()).select("row_id", "vector").mapInArrow(run, _BLOCK)


def _block(ids: np.ndarray, x: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, x, gap))], names=["n", "ids", "x", "gap"])


def _blocks(batch: pa.RecordBatch, m: int):
    for r in range(batch.num_rows):
        ids, x, gap = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("ids", np.int64), ("x", np.float64), ("gap", np.bool_)))
        yield ids, x.reshape(-1, m), gap.reshape(-1, m)


def _merged(blocks: DataFrame) -> DataFrame:
    """Small blocks of the same task joined to blocks of up to BLOCK_BYTES."""
    def joined(parts):
        return pa.RecordBatch.from_arrays([pa.array([sum(p["n"] for p in parts)], pa.int32()),
                                           *(pa.array([b"".join(p[c] for p in parts)], pa.binary()) for c in ("ids", "x", "gap"))], names=["n", "ids", "x", "gap"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                block = batch.slice(r, 1).to_pylist()[0]
                if parts and held + len(block["x"]) > BLOCK_BYTES:
                    yield joined(parts)
                    parts, held = [], 0
                parts.append(block)
                held += len(block["x"])
        if parts:
            yield joined(parts)
    return blocks.mapInArrow(run, _BLOCK)


def _round(x: np.ndarray, gap: np.ndarray, v: np.ndarray, accelerate: bool) -> np.ndarray:
    """The field after a round with these EOFs."""
    if accelerate:
        mu, coef = _solve_rows(x, gap, v)
    else:
        mu = x.mean(axis=1, keepdims=True)
        coef = (x - mu) @ v
    return np.where(gap, mu + coef @ v.T, x)


WINDOW = 5  # rounds that Anderson mixing looks back on


def _solve_rows(x: np.ndarray, gap: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, coefficients) of every row by least squares on its observed cells, the smallest coefficients if several fit."""
    seen = (~gap).astype(float)
    n = np.maximum(seen.sum(axis=1), 1.0)[:, None]
    values = np.where(gap, 0.0, x)
    v_mean, x_mean = seen @ v / n, values.sum(axis=1, keepdims=True) / n
    k = v.shape[1]
    normal = (seen @ (v[:, :, None] * v[:, None, :]).reshape(len(v), k * k)).reshape(-1, k, k) - n[:, :, None] * v_mean[:, :, None] * v_mean[:, None, :]
    right = values @ v - n * x_mean * v_mean
    coef = (np.linalg.pinv(normal, rcond=1e-12, hermitian=True) @ right[:, :, None])[:, :, 0]
    return x_mean - (v_mean * coef).sum(axis=1, keepdims=True), coef


def _turned(v: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The basis of the same space that lies closest to ``to``."""
    a, _, b = np.linalg.svd(v.T @ to)
    return v @ (a @ b)


class _Mixing:
    """Anderson mixing of V: the combination of the last rounds whose changes cancel best."""

    def __init__(self):
        self.images, self.changes = [], []

    def next(self, v: np.ndarray, image: np.ndarray) -> np.ndarray:
        image = _turned(image, v)
        self.images, self.changes = [*self.images, image.ravel()][-WINDOW:], [*self.changes, (image - v).ravel()][-WINDOW:]
        if len(self.changes) == 1:
            return image
        weight = np.linalg.lstsq(np.diff(self.changes, axis=0).T, self.changes[-1], rcond=1e-10)[0]
        mixed = (image.ravel() - np.diff(self.images, axis=0).T @ weight).reshape(v.shape)
        return _turned(np.linalg.qr(mixed)[0], mixed)


def dineof_select(mat: DataFrame, k_max: int, n_cols: int, share: float = 0.03, seed: int = 0, tol: float = 1e-3, **how) -> tuple[int, list[dict]]:
    """The number of EOFs (1..``k_max``) that fills cells set aside best, and the errors on the way.

    A share of the observed cells (by a hash of row, place and ``seed``) is hidden; 1, 2, ... EOFs fill them until the
    RMS error rises or the filling does not converge.  ``tol`` is a share of the field's standard deviation.
    Returns (k, [{k, rms, converged, iterations}])."""
    cell = lambda x, j: F.pmod(F.xxhash64("row_id", j, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    there = lambda x: x.isNotNull() & ~F.isnan(x)
    hidden = mat.select("row_id", F.transform("vector", lambda x, j: F.when(~cell(x, j), x)).alias("vector"))
    truth = mat.select("row_id", F.transform("vector", lambda x, j: F.when(cell(x, j) & there(x), x)).alias("truth"))
    spread = mat.select(F.explode("vector").alias("x")).where(there(F.col("x"))).agg(F.stddev_pop("x")).first()[0] or 1.0
    tried: list[dict] = []
    for k in range(1, min(k_max, n_cols) + 1):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # it is in the result
            filled, info = dineof_fill(hidden, k, n_cols, tol=tol * spread, seed=seed, **how)
        error = (filled.join(truth, "row_id").select(F.explode(F.zip_with("vector", "truth", lambda a, b: (a - b) * (a - b))).alias("e"))
                 .agg(F.sqrt(F.avg("e"))).first()[0])
        tried.append({"k": k, "rms": error, "converged": info["converged"], "iterations": info["iterations"]})
        if error is None or not info["converged"] or (len(tried) > 1 and error >= tried[-2]["rms"]):
            break
    good = [t for t in tried if t["converged"] and t["rms"] is not None]
    return (min(good, key=lambda t: t["rms"])["k"] if good else 1), tried


def dineof_fill(mat: DataFrame, k: int, n_cols: int, max_iter: int = 30, tol: float = 1e-6, seed: int = 0,
                accelerate: bool = False, product: str = "distributed") -> tuple[DataFrame, dict]:
    """Fill NULL cells of ``(row_id, vector)``; returns (filled, info).

    Row ids are unique.  The row means are re-estimated from the current filled
    rows each round, so gaps do not bias the centering.  A NaN cell counts as
    missing.  ``product='gram'`` takes V from a Gram of one pass (up to 2,048 columns).  Output: ``(row_id, vector, filled ARRAY<BOOLEAN>)`` with no NULL
    cells.  ``info``: iterations, rms_change, n_missing, converged; a field that
    is not converged after ``max_iter`` rounds comes with a warning."""
    if product not in ("distributed", "gram"):
        raise ValueError(f"unknown product {product!r}")
    spark = mat.sparkSession
    arrow_batch_guard(spark)
    k = min(k, n_cols)
    kept, tasks, n, n_missing = _keep(_pack(mat, n_cols))
    turns: list[np.ndarray] = []  # V of the rounds since the blocks were kept; accelerated rounds need the last only
    info = {"iterations": 0, "rms_change": None, "n_missing": n_missing, "converged": n_missing == 0}

    def passed(kernel, rows: int, cols: int, *rhs):
        """The sum over all rows of kernel(field before the last round, field, rhs), shape (rows, cols)."""
        bc = spark.sparkContext.broadcast((list(turns), *rhs))

        def run(batch, value):
            total = np.zeros((rows, cols))
            for _, x, gap in _blocks(batch, n_cols):
                before = x
                for v in value[0]:
                    before, x = x, _round(x, gap, v, accelerate)
                total += kernel(before, x, *value[1:])
            return total
        try:
            return _sum_partials(kept, run, rows, cols, bc, tasks=tasks)
        finally:
            bc.unpersist()

    def centered(x):
        return x - x.mean(axis=1, keepdims=True)

    def gram_and_change(before, x):
        c = centered(x)
        return np.vstack([c.T @ c, np.full((1, n_cols), ((x - before) ** 2).sum())])

    def cov(before, x, y):
        c = centered(x)
        return c.T @ (c @ y)

    def cov_and_change(before, x, y):
        return np.vstack([cov(before, x, y), np.full((1, y.shape[1]), ((x - before) ** 2).sum())])

    ahead: list[np.ndarray] = []  # the first product of the coming round, if the pass before gave it

    def times(y):
        return (ahead.pop() if ahead else passed(cov, n_cols, y.shape[1], y)) / n

    def current(fn, schema: str) -> DataFrame:
        bc = spark.sparkContext.broadcast(list(turns))

        def run(batches):
            for batch in batches:
                for ids, x, gap in _blocks(batch, n_cols):
                    for v in bc.value:
                        x = _round(x, gap, v, accelerate)
                    yield fn(ids, x, gap)
        return kept.mapInArrow(run, schema)

    if product == "gram" and n_cols > GRAM_MAX_COLS:
        raise ValueError(f"{n_cols} columns: the Gram matrix is too wide for the driver; use product='distributed'")
    mixing, v, saved = _Mixing(), np.zeros((n_cols, k)), None
    g = passed(gram_and_change, n_cols + 1, n_cols) if product == "gram" and n_missing and n else None
    for it in range(max_iter if n_missing and n else 0):
        if product == "gram":
            new_v, ok = sym_eig_desc(g[:n_cols])[1][:, :k], True
        else:
            new_v, _, _, _, ok = krylov_eigs(times, n_cols, k, 1e-12 if accelerate else 1e-8, 100, seed, v if it else None)
        if accelerate and it:
            new_v = mixing.next(v, new_v)
        if not accelerate and len(turns) >= SAVE_EVERY:
            path = scratch_path(spark, "dineof-state")
            current(_block, _BLOCK).write.parquet(path)
            kept.unpersist()
            if saved:
                delete_path(spark, saved)
            saved, turns[:] = path, []
            kept = _dealt(spark.read.schema(_BLOCK).parquet(path), tasks).persist(StorageLevel.MEMORY_AND_DISK)
        turns[:], v = [*turns[-1:], new_v] if accelerate else [*turns, new_v], new_v
        if product == "gram":
            g = passed(gram_and_change, n_cols + 1, n_cols)
            d2 = g[n_cols, 0]
        else:
            y = start_block(n_cols, k, seed, v)
            g = passed(cov_and_change, n_cols + 1, y.shape[1], y)
            ahead[:], d2 = [g[:n_cols]], g[n_cols, 0]
        rms = float(np.sqrt(d2 / n_missing))
        info.update(iterations=it + 1, rms_change=rms)
        if rms < tol and ok:
            info["converged"] = True
            break
    if not info["converged"]:
        warnings.warn(f"gap filling not converged: RMS change {info['rms_change']} after {info['iterations']} rounds", stacklevel=2)

    def final(ids, x, gap):
        flags = pa.ListArray.from_arrays(pa.array(np.arange(0, gap.size + 1, n_cols, dtype=np.int32)), pa.array(gap.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(ids), matrix_to_list_array(x), flags], names=["row_id", "vector", "filled"])

    done = scratch_path(spark, "dineof-filled")
    current(final, "row_id bigint, vector array<double>, filled array<boolean>").write.parquet(done)
    kept.unpersist()
    if saved:
        delete_path(spark, saved)
    return spark.read.parquet(done), info


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.coalesce(1) if parts == 1 else blocks.repartition(parts)


def _keep(blocks: DataFrame) -> tuple[DataFrame, int, int, int]:
    """Blocks persisted, dealt evenly to as few partitions as hold TASK_BYTES each: (blocks, partitions, rows, gaps)."""
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    gaps = F.length(F.replace(F.hex("gap"), F.lit("0"), F.lit("")))  # a gap is the byte 01
    n, missing, size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(gaps), F.lit(0)), F.coalesce(F.sum(F.length("x")), F.lit(0))).first()
    parts = max(1, -(-size // TASK_BYTES))
    if max(parts, blocks.rdd.getNumPartitions()) > 1:
        even = _merged(_dealt(blocks, parts)).persist(StorageLevel.MEMORY_AND_DISK)
        even.count()
        blocks.unpersist()
        blocks = even
    return blocks, parts, int(n), int(missing)
