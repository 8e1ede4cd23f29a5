"""Distributed matrix products over a row matrix.

The row matrix ``(row_id, vector)`` stays on executors.  Each task turns
its Arrow batches into one NumPy block and does one GEMM per batch,
accumulating a single partial per partition (map-side combine).  Partials
are cut into row blocks keyed by ``block_id`` and summed per block in a
grouped Arrow reduce in a tree of fixed fan-out, so the reduce is parallel
across blocks and every group's size is bounded (FANOUT partials of a block).
Only the m x r result reaches the driver: the reference's "never form
A^T A, multiply by it" design.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.functions.blocks import (
    list_column_to_matrix,
    matrix_to_list_array,
    qr_r,
    split_rows,
    stack_r,
)
from fieldmodes.functions.packed import blocks, is_packed, is_sparse, pack

# Upper bound on the bytes one reduce group holds: FANOUT partials of one row block.
GROUP_TARGET_BYTES = 64 << 20
FANOUT = 64
# When all partials together stay below this (counted, not estimated), the
# driver adds them, the last step of a tree aggregate.
DRIVER_PARTIALS_MAX_BYTES = 16 << 20
# The driver takes an m x m Gram up to this width (32 MB); ``gram_long`` has no limit.
GRAM_MAX_COLS = 2048

_PARTIAL_SCHEMA = "g bigint, block_id int, data array<double>"
# Arrow batches handed to Python are capped in bytes, not rows: a row of
# 46,715 doubles is 374 KB, so a row-count cap alone could build GB batches.
ARROW_BATCH_BYTES = 64 << 20


def arrow_batch_guard(spark) -> None:
    """Cap Arrow batch bytes for the block kernels (keeps an existing lower cap)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    cur = spark.conf.get(key, None)
    try:
        ok = cur is not None and 0 < int(str(cur).rstrip("bB")) <= ARROW_BATCH_BYTES
    except ValueError:
        ok = False
    if not ok:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def _block_rows(m: int, r: int) -> int:
    return int(max(1, min(m, GROUP_TARGET_BYTES // (8 * max(r, 1) * FANOUT))))


def _sum_blocks(table: pa.Table) -> pa.Table:
    """Grouped reduce: element-wise sum of the partials of one block."""
    x = list_column_to_matrix(table.column("data"))
    s = x.sum(axis=0)[None, :]
    return pa.table({"g": table.column("g")[:1], "block_id": table.column("block_id")[:1], "data": matrix_to_list_array(s)})


def _partials_fn(kernel, br: int, bcast):
    def per_partition(batches):
        from pyspark import TaskContext
        acc = None
        bval = bcast.value if bcast is not None else None
        for batch in batches:
            if batch.num_rows:
                c = kernel(batch, bval)
                acc = c if acc is None else acc + c
        if acc is None:
            return
        bids, datas = zip(*split_rows(acc, br))
        offs = np.cumsum([0] + [len(d) for d in datas]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()] * len(bids), pa.int64()), pa.array(bids, pa.int32()),
             pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(datas)))],
            names=["g", "block_id", "data"])
    return per_partition


def _partials(df: DataFrame, kernel, br: int, bcast=None) -> DataFrame:
    """One partial per task, cut into row blocks: (g = task, block_id, data)."""
    arrow_batch_guard(df.sparkSession)
    return df.mapInArrow(_partials_fn(kernel, br, bcast), _PARTIAL_SCHEMA)


def _tree(partials: DataFrame, n: int | None = None) -> DataFrame:
    """Sum partials per block in a tree: a group holds at most FANOUT partials of a block.

    ``n``: number of tasks; None: unknown, three levels (up to FANOUT^3 tasks)."""
    for _ in range(2 if n is None else 20):
        if n is not None and n <= FANOUT:
            break
        partials = (partials.withColumn("g", F.floor(F.col("g") / FANOUT).cast("long"))
                    .groupBy("block_id", "g").applyInArrow(_sum_blocks, _PARTIAL_SCHEMA))
        n = None if n is None else (n + FANOUT - 1) // FANOUT
    return partials.groupBy("block_id").applyInArrow(_sum_blocks, _PARTIAL_SCHEMA)


def _added(rows: DataFrame, m_out: int, r_out: int, br: int) -> np.ndarray:
    """The sum of row blocks, on the driver."""
    out = np.zeros((m_out, r_out))
    for batch in rows.select("block_id", "data").toArrow().to_batches():
        data = batch.column("data")
        flat, ends = data.flatten().to_numpy(), data.offsets.to_numpy() - data.offsets[0].as_py()
        for at, block_id in enumerate(batch.column("block_id").to_pylist()):
            blk = flat[ends[at]:ends[at + 1]].reshape(-1, r_out)
            out[block_id * br:block_id * br + len(blk)] += blk
    return out


def _sum_partials(df: DataFrame, kernel, m_out: int, r_out: int, bcast=None, tasks: int | None = None) -> np.ndarray:
    """Sum of ``kernel`` over all batches as an (m_out, r_out) array.

    The input is scanned once: the partials are persisted, counted, and then
    added by the driver if they are small, else per block in a tree on the
    executors, so the driver only receives the final sum.  ``tasks``: their number, if it is known and need not be counted."""
    br = _block_rows(m_out, r_out)
    if tasks is not None and tasks * m_out * r_out * 8 <= DRIVER_PARTIALS_MAX_BYTES:
        return _added(_partials(df, kernel, br, bcast), m_out, r_out, br)
    parts = _partials(df, kernel, br, bcast).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = parts.agg(F.countDistinct("g"), F.max("g")).first()
        small = n[0] * m_out * r_out * 8 <= DRIVER_PARTIALS_MAX_BYTES
        rows = parts if small else _tree(parts, (n[1] or 0) + 1)
        return _added(rows, m_out, r_out, br)
    finally:
        parts.unpersist()


def _x(batch, width=None):
    return list_column_to_matrix(batch.column("vector"), width)


def _scan(mat: DataFrame) -> DataFrame:
    """What a product reads of a row matrix: its vectors, or its blocks if it is packed (``functions.packed``)."""
    if is_sparse(mat):
        mat = pack(mat)
    return mat if is_packed(mat) else mat.select("vector")


def kept_tasks(mat: DataFrame) -> int | None:
    """The tasks of a pass over a persisted matrix; None if it is not persisted (counting them would run its plan)."""
    return mat.rdd.getNumPartitions() if mat.is_cached else None


def _broadcast(mat: DataFrame, value):
    return mat.sparkSession.sparkContext.broadcast(value)


def gram(mat: DataFrame, n_cols: int, n_rows: int | None = None) -> np.ndarray:
    """A^T A (m x m) on the driver, in one pass (D9); for m <= GRAM_MAX_COLS.

    Each task emits an m x m partial.  With the row count known, tasks are
    merged (``coalesce``, no shuffle) until each holds at least 4m rows, but
    never below the parallelism of the cluster."""
    if n_cols > GRAM_MAX_COLS:
        raise ValueError(f"{n_cols} columns: the Gram matrix is too wide for the driver; use cov_multiply or gram_long")
    x = _scan(mat)
    if n_rows:
        x = x.coalesce(max(mat.sparkSession.sparkContext.defaultParallelism, n_rows // (4 * n_cols)))

    def k(batch, _):
        return sum(a.T @ a for block in blocks(batch, n_cols) for a in block.slabs())
    return _sum_partials(x, k, n_cols, n_cols)


TILE_BYTES = 4 << 20  # a tile: the rows of a slab in the columns of a panel


def gram_long(mat: DataFrame, n_cols: int, panel: int = GRAM_MAX_COLS, num_partitions: int | None = None) -> DataFrame:
    """A^T A as a distributed long table ``(i, j, value)``, never collected, at any width; A is scanned once.

    Columns are cut into panels.  A task cuts slabs of its rows into one tile per panel and sends each pair of
    panels its two tiles of the slab; pairs are dealt to tasks (several per pair, if there are fewer pairs than
    tasks), which multiply tile by tile into one panel x panel square (32 MB).  The squares of a pair are added row
    by row, its mirror image is free.  A is shuffled once per panel: 23 times at 46,715 columns, where a pass per pair of
    panels would scan it 276 times.

    Of sparse or packed rows a pair is sent the entries only, and nothing of a block without a row that has entries in
    both panels; entries are multiplied one by one, or as dense slabs where that is less work."""
    spark = mat.sparkSession
    arrow_batch_guard(spark)
    few = is_sparse(mat) or is_packed(mat)
    edges = [*range(0, n_cols, panel), n_cols]
    panels = list(zip(edges, edges[1:]))
    pairs = [(i, j) for i in range(len(panels)) for j in range(i, len(panels))]
    # (entries are few bytes: a square per shuffle partition would outweigh them)
    tasks = num_partitions or (2 * spark.sparkContext.defaultParallelism if few else int(spark.conf.get("spark.sql.shuffle.partitions")))
    deal = max(1, -(-tasks // max(len(pairs), 1)))  # tasks of a pair
    slab = max(1, TILE_BYTES // (8 * panel))

    def cut(batches):
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, slab):
                a = _x(batch.slice(at, slab), n_cols)
                tiles = [np.ascontiguousarray(a[:, lo:hi]).tobytes() for lo, hi in panels]
                for i, j in pairs:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([n % deal], pa.int32()), pa.array([len(a)], pa.int32()),
                        pa.array([tiles[i]], pa.binary()), pa.array([tiles[j] if j != i else None], pa.binary())],
                        names=["pi", "pj", "deal", "n", "left", "right"])
                n += 1

    def cut_entries(batches):
        n = 0
        for batch in batches:
            for block in blocks(batch, n_cols):
                tiles = _entry_tiles(block, panels)
                for i, j in pairs:
                    both = tiles[i][0] if i == j else np.intersect1d(tiles[i][0], tiles[j][0])
                    if len(both):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([n % deal], pa.int32()), pa.array([block.n], pa.int32()),
                            pa.array([tiles[i][1]], pa.binary()), pa.array([tiles[j][1] if j != i else None], pa.binary())],
                            names=["pi", "pj", "deal", "n", "left", "right"])
                n += 1

    def multiply(batches):
        key, total = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, n = (batch.column(c)[r].as_py() for c in ("pi", "pj", "n"))
                if (i, j) != key:
                    if key is not None:
                        yield _square(key, total)
                    key, total = (i, j), np.zeros((panels[i][1] - panels[i][0], panels[j][1] - panels[j][0]))
                if few:
                    left = np.frombuffer(batch.column("left")[r].as_buffer(), _ENTRY)
                    _add_entries(total, n, left, left if i == j else np.frombuffer(batch.column("right")[r].as_buffer(), _ENTRY))
                    continue
                left = np.frombuffer(batch.column("left")[r].as_buffer()).reshape(n, -1)
                total += left.T @ (left if i == j else np.frombuffer(batch.column("right")[r].as_buffer()).reshape(n, -1))
        if key is not None:
            yield _square(key, total)

    def _square(key, total):
        rows = len(total)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * rows, pa.int32()), pa.array([key[1]] * rows, pa.int32()), pa.array(np.arange(rows, dtype=np.int32)),
                                           matrix_to_list_array(total)], names=["pi", "pj", "row", "data"])

    dealt = (_scan(mat).mapInArrow(cut_entries if few else cut, "pi int, pj int, deal int, n int, left binary, right binary")
             .repartition(max(tasks, len(pairs)), "pi", "pj", "deal").sortWithinPartitions("pi", "pj"))
    squares = dealt.mapInArrow(multiply, "pi int, pj int, row int, data array<double>")  # one square per pair and task
    if few:  # the rows of squares to which no entries were sent
        zeros = spark.createDataFrame([(i, j, panels[i][1] - panels[i][0], panels[j][1] - panels[j][0]) for i, j in pairs], "pi int, pj int, rows int, width int")
        squares = squares.unionByName(zeros.select("pi", "pj", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.array_repeat(F.lit(0.0), F.col("width")).alias("data")))
    if few or deal > 1:  # at most ``deal`` rows of a square's row (and one of zeros), added as arrays
        add = lambda a, x: F.zip_with(a, x, lambda p, q: p + q)
        squares = (squares.groupBy("pi", "pj", "row").agg(F.collect_list("data").alias("d"))
                   .select("pi", "pj", "row", F.aggregate(F.slice("d", F.lit(2), F.size("d")), F.col("d")[0], add).alias("data")))
    cells = squares.select("pi", "pj", "row", F.posexplode("data").alias("col", "value")).select(
        (F.col("pi") * panel + F.col("row")).alias("i"), (F.col("pj") * panel + F.col("col")).alias("j"), "value")
    both = F.when(F.floor(F.col("i") / panel) == F.floor(F.col("j") / panel), F.array(F.struct("i", "j")))
    both = both.otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return cells.select(F.explode(both).alias("at"), "value").select("at.i", "at.j", "value")


_ENTRY = np.dtype([("row", np.int32), ("col", np.int32), ("value", np.float64)])
SLAB_WORK = 32  # an entry that meets an entry costs as much as this many cells of a slab product


def _entry_tiles(block, panels: list[tuple[int, int]]) -> list[tuple[np.ndarray, bytes]]:
    """(rows with entries, the entries by row) of a block in every panel of columns; a fill that is not 0 makes every cell one."""
    if block.fill.any():
        x = np.concatenate(list(block.slabs()))
        rows, pos, val = np.repeat(np.arange(block.n), block.m), np.tile(np.arange(block.m), block.n), x.ravel()
    else:
        rows, pos, val = block.rows(), block.pos, block.val
    out = []
    for lo, hi in panels:
        at = (pos >= lo) & (pos < hi)
        tile = np.empty(int(at.sum()), _ENTRY)
        tile["row"], tile["col"], tile["value"] = rows[at], pos[at] - lo, val[at]
        out.append((np.unique(tile["row"]), tile.tobytes()))
    return out


def _add_entries(total: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> None:
    """total += L^T R of two tiles of entries, sorted by row, of the same n rows."""
    n_left, n_right = np.bincount(left["row"], minlength=n), np.bincount(right["row"], minlength=n)
    if int(n_left @ n_right) * SLAB_WORK > n * total.size:
        step = max(1, TILE_BYTES // (8 * max(total.shape)))
        for lo in range(0, n, step):
            hi, tiles = min(lo + step, n), []
            for part, width in ((left, total.shape[0]), (right, total.shape[1])):
                part = part[np.searchsorted(part["row"], lo):np.searchsorted(part["row"], hi)]
                tiles.append(np.zeros((hi - lo, width)))
                tiles[-1][part["row"] - lo, part["col"]] = part["value"]
            total += tiles[0].T @ tiles[1]
        return
    # entry a of the left meets the entries first[a] .. of the right's same row; as many at a time as a tile may hold
    meets, first = n_right[left["row"]], (np.cumsum(n_right) - n_right)[left["row"]]
    ends = np.cumsum(meets)
    at = 0
    while at < len(left):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TILE_BYTES // 8, "right")))
        a = np.repeat(np.arange(at, to), meets[at:to])
        b = np.arange(len(a)) - np.repeat(ends[at:to] - meets[at:to] - before, meets[at:to]) + first[a]
        np.add.at(total.reshape(-1), left["col"][a].astype(np.int64) * total.shape[1] + right["col"][b], left["value"][a] * right["value"][b])
        at = to


def cov_multiply(mat: DataFrame, rhs: np.ndarray, n_rows: int | None = None) -> np.ndarray:
    """1/n * A^T A * rhs without forming A^T A.

    ``rhs`` (m x r) is broadcast once; each batch does X^T (X rhs).  With
    ``n_rows=None`` the row count is taken from the data (M7).
    """
    rhs = np.ascontiguousarray(rhs, dtype=np.float64)
    m, r = rhs.shape
    if n_rows is None:
        n_rows = mat.count()
    bc = _broadcast(mat, rhs)

    def k(batch, b):
        return sum(block.cov(b) for block in blocks(batch, m))
    try:
        out = _sum_partials(_scan(mat), k, m, r, bc, tasks=kept_tasks(mat))
    finally:
        bc.unpersist()
    return out / max(n_rows, 1)


def left_multiply(lhs: DataFrame, mat: DataFrame, n_cols: int, c: int) -> np.ndarray:
    """B A = sum_i b_i a_i^T for a distributed ``lhs(row_id, coef ARRAY<DOUBLE>[c])``.

    B's columns are keyed by row id and joined to the rows (a shuffle
    join), so neither side is collected.
    """
    j = mat.select("row_id", "vector").join(lhs.select("row_id", "coef"), "row_id").select("vector", "coef")

    def k(batch, _):
        return list_column_to_matrix(batch.column("coef"), c).T @ _x(batch, n_cols)
    return _sum_partials(j, k, c, n_cols)


def right_multiply(mat: DataFrame, b: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """A B (n x k), distributed: broadcast B, one GEMM per batch.

    Output ``(row_id, vector)`` keeps the row layout; nothing is collected.
    """
    b = np.ascontiguousarray(b, dtype=np.float64)
    m, k = b.shape
    arrow_batch_guard(mat.sparkSession)
    bc = _broadcast(mat, b)
    keep = keep or []
    if is_sparse(mat) and not keep:
        mat = pack(mat)
    if is_packed(mat):
        def per_block(batches):
            for batch in batches:
                for block in blocks(batch, m):
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids), matrix_to_list_array(block.times(bc.value))], names=["row_id", "vector"])
        return mat.mapInArrow(per_block, "row_id bigint, vector array<double>")

    def per_batch(batches):
        bv = bc.value
        for batch in batches:
            x = list_column_to_matrix(batch.column("vector"), m) if batch.num_rows else np.zeros((0, m))
            cols = [batch.column("row_id"), matrix_to_list_array(x @ bv)] + [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(cols, names=["row_id", "vector"] + keep)

    sel = mat.select("row_id", "vector", *keep)
    extra = "".join(f", {f.simpleString().replace(':', ' ', 1)}" for f in sel.schema.fields[2:])
    return sel.mapInArrow(per_batch, f"row_id bigint, vector array<double>{extra}")


def tsqr_r(mat: DataFrame, k: int, rhs: np.ndarray | None = None, fanout: int = 64) -> np.ndarray:
    """R of a thin QR of X (n x k), or of X @ rhs computed inline.

    Each partition reduces its rows to one k x k R; those are combined in a
    tree of grouped QRs (``fanout`` per group) so neither a task nor the
    driver ever holds more than ``fanout`` small squares.
    """
    bc = _broadcast(mat, np.ascontiguousarray(rhs, dtype=np.float64)) if rhs is not None else None
    width = rhs.shape[0] if rhs is not None else k

    def per_partition(batches):
        from pyspark import TaskContext
        rs = []
        bv = bc.value if bc is not None else None
        for batch in batches:
            if batch.num_rows:
                for block in blocks(batch, width):
                    rs.extend(qr_r(y) for y in ([block.times(bv)] if bv is not None else block.slabs()))
            if len(rs) > fanout:
                rs = [stack_r(rs, k)]
        if not rs:
            return
        r = stack_r(rs, k)
        pid = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int64()), matrix_to_list_array(r.reshape(1, -1))],
                                         names=["g", "r"])

    def combine(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        r = stack_r(list(list_column_to_matrix(table.column("r"))), k)
        return pa.table({"g": pa.array([g], pa.int64()), "r": matrix_to_list_array(r.reshape(1, -1))})

    try:
        arrow_batch_guard(mat.sparkSession)
        first = _scan(mat).mapInArrow(per_partition, "g bigint, r array<double>").persist(StorageLevel.MEMORY_AND_DISK)
        n = (first.agg(F.max("g")).first()[0] or 0) + 1  # the input is scanned once
        level = first
        while n > fanout:  # tree levels: groups of `fanout` consecutive partials
            level = (level.withColumn("g", F.floor(F.col("g") / fanout).cast("long"))
                     .groupBy("g").applyInArrow(combine, "g bigint, r array<double>"))
            n = (n + fanout - 1) // fanout
        rows = [np.asarray(r["r"]) for r in level.collect()]  # at most `fanout` k x k squares
        first.unpersist()
    finally:
        if bc is not None:
            bc.unpersist()
    return stack_r(rows, k)


def apply_right_inverse(x: DataFrame, r: np.ndarray) -> DataFrame:
    """Q = X R^{-1} as a narrow map (the Q half of TSQR, F6)."""
    k = r.shape[0]
    rinv = np.linalg.solve(r, np.eye(k)) if np.all(np.abs(np.diag(r)) > 0) else np.linalg.pinv(r)
    return right_multiply(x, rinv)


multiply = right_multiply  # F5 planned name


def tsqr(x: DataFrame, k: int, fanout: int = 64) -> tuple[DataFrame, np.ndarray]:
    """Thin QR of a distributed n x k matrix: (Q distributed, R small)."""
    r = tsqr_r(x, k, fanout=fanout)
    return apply_right_inverse(x, r), r
