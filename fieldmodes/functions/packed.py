"""Row matrices whose rows hold few entries, and rows packed into blocks for many passes.

A sparse row is ``struct<size, fill, pos, val>``: ``size`` places, of which those in ``pos`` (ascending) hold
``val`` and all others ``fill`` (0 in a field of sums; minus the row's mean once it is centered).  What a row
costs follows its entries, not the width of the matrix.

``pack`` turns sparse rows into blocks of about BLOCK_ENTRIES entries, one block a row of binary columns, so that
a pass hands bytes to NumPy and converts no cell.  A block is multiplied entry by entry, or, if at
least one cell in DENSE_SHARE is an entry, as dense slabs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmodes.functions.blocks import AlignmentError, list_column_to_matrix

BLOCK_ENTRIES = 1 << 16
DENSE_SHARE = 8          # measured: a cell of a dense slab costs about an eighth of an entry
SLAB_CELLS = 1 << 19     # cells of a dense slab (4 MB)
PACKED = "n int, m int, ids binary, fill binary, counts binary, pos binary, val binary, turn binary"


def sparse_vector(size: int, pos: Column, val: Column) -> Column:
    """A sparse row vector with zeros between its entries."""
    return F.struct(F.lit(size).cast("int").alias("size"), F.lit(0.0).alias("fill"), pos.cast("array<int>").alias("pos"), val.cast("array<double>").alias("val"))


def is_sparse(mat: DataFrame) -> bool:
    return "vector" in mat.columns and mat.schema["vector"].dataType.typeName() == "struct"


def is_packed(mat: DataFrame) -> bool:
    return "turn" in mat.columns


class DenseBlock:
    """Rows as one array."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)

    def times(self, b: np.ndarray) -> np.ndarray:
        return self.x @ b

    def cov(self, b: np.ndarray) -> np.ndarray:
        return self.x.T @ (self.x @ b)

    def slabs(self) -> Iterator[np.ndarray]:
        yield self.x


class SparseBlock:
    """Rows as entries in row order; ``turn`` lists them by column, or is empty for a block multiplied as dense slabs."""

    def __init__(self, m: int, ids, fill, counts, pos, val, turn):
        self.n, self.m, self.ids, self.fill, self.counts, self.pos, self.val, self.turn = len(counts), m, ids, fill, counts, pos, val, turn
        self.dense = len(pos) > 0 and not len(turn)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def slabs(self) -> Iterator[np.ndarray]:
        ends = np.concatenate([[0], np.cumsum(self.counts)])
        step = max(1, SLAB_CELLS // max(self.m, 1))
        for lo in range(0, self.n, step):
            hi = min(lo + step, self.n)
            x = np.repeat(self.fill[lo:hi, None], self.m, axis=1)
            at = slice(ends[lo], ends[hi])
            x[np.repeat(np.arange(hi - lo), self.counts[lo:hi]), self.pos[at]] = self.val[at]
            yield x

    def _extra(self) -> np.ndarray:
        return self.val - np.repeat(self.fill, self.counts) if self.fill.any() else self.val

    def times(self, b: np.ndarray) -> np.ndarray:
        if self.dense:
            return np.concatenate([x @ b for x in self.slabs()])
        out = self.fill[:, None] * b.sum(axis=0)
        if len(self.pos):
            part = b[self.pos] * self._extra()[:, None]
            some = self.counts > 0
            out[some] += part if self.counts.max() == 1 else np.add.reduceat(part, (np.cumsum(self.counts) - self.counts)[some])
        return out

    def cov(self, b: np.ndarray) -> np.ndarray:
        if self.dense:
            return sum(x.T @ (x @ b) for x in self.slabs())
        y = self.times(b)
        out = np.repeat((self.fill @ y)[None, :], self.m, axis=0)
        if len(self.pos):
            at = self.pos[self.turn]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[first]] += np.add.reduceat(y[self.rows()[self.turn]] * self._extra()[self.turn][:, None], first)
        return out


def blocks(batch: pa.RecordBatch, width: int | None = None) -> Iterator[DenseBlock | SparseBlock]:
    """The blocks of a batch of row vectors or of packed rows."""
    if "turn" not in batch.schema.names:
        yield DenseBlock(list_column_to_matrix(batch.column("vector"), width))
        return
    kinds = {"ids": np.int64, "fill": np.float64, "counts": np.int32, "pos": np.int32, "val": np.float64, "turn": np.int32}
    for r in range(batch.num_rows):
        m = batch.column("m")[r].as_py()
        if width is not None and m != width:
            raise AlignmentError(f"row vector length {m} != expected {width}")
        yield SparseBlock(m, **{c: np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in kinds.items()})


def _entries(batch: pa.RecordBatch) -> list[np.ndarray]:
    """[size, id, fill, count of every row; place, value of every entry]."""
    pos, val = batch.column("pos"), batch.column("val")
    flat = [pos.flatten(), val.flatten()]
    if any(batch.column(c).null_count for c in ("size", "fill", "pos", "val")) or any(x.null_count for x in flat):
        raise AlignmentError("NULL row vector or NULL entry in a sparse row")
    counts = np.diff(pos.offsets.to_numpy())
    if (counts != np.diff(val.offsets.to_numpy())).any():
        raise AlignmentError("sparse row with places and values of different number")
    return [np.asarray(x) for x in (batch.column("size"), batch.column("row_id"), batch.column("fill"), counts, *flat)]


def _packed(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    size, ids, fill, counts, pos, val = (np.concatenate(x) for x in zip(*parts))
    m = int(size[0])
    if (size != m).any() or (len(pos) and (pos.min() < 0 or pos.max() >= m)):
        raise AlignmentError("sparse rows of different length, or a place outside of a row")
    ends, at = np.cumsum(counts), 0
    while at < len(ids):
        before = ends[at - 1] if at else 0
        to = max(at + 1, min(at + BLOCK_ENTRIES, int(np.searchsorted(ends, before + BLOCK_ENTRIES, "right"))))
        p, v, n = pos[before:ends[to - 1]], val[before:ends[to - 1]], to - at
        turn = np.zeros(0) if len(p) * DENSE_SHARE > n * m else np.argsort(p.astype(np.uint16) if m < 1 << 16 else p, kind="stable")
        cells = {"ids": ids[at:to].astype(np.int64), "fill": fill[at:to].astype(np.float64), "counts": counts[at:to].astype(np.int32),
                 "pos": p.astype(np.int32), "val": v.astype(np.float64), "turn": turn.astype(np.int32)}
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([m], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells.values())],
                                         names=["n", "m", *cells])
        at = to


def pack(mat: DataFrame) -> DataFrame:
    """Sparse rows -> packed blocks of rows of the same task; rows do not move."""
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(_entries(batch))
                held += max(batch.num_rows, len(parts[-1][4]))
            if held >= BLOCK_ENTRIES:
                yield from _packed(parts)
                parts, held = [], 0
        if parts:
            yield from _packed(parts)
    return mat.select("row_id", "vector.size", "vector.fill", "vector.pos", "vector.val").mapInArrow(run, PACKED)


def merge_blocks(mat: DataFrame) -> DataFrame:
    """Packed blocks of the same task joined to blocks of full size."""
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for b in blocks(batch):
                parts.append([np.full(b.n, b.m), b.ids, b.fill, b.counts, b.pos, b.val])
                held += max(b.n, len(b.pos))
                if held >= BLOCK_ENTRIES:
                    yield from _packed(parts)
                    parts, held = [], 0
        if parts:
            yield from _packed(parts)
    return mat.mapInArrow(run, PACKED)
