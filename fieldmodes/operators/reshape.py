"""Long <-> wide reshaping of observation matrices.

* ``column_order``  distinct record ids ascending -> ``col_pos`` (C2)
* ``pivot_rows``    triplets -> row vectors aligned on ``col_order`` (C1)
* ``hconcat``       glue column blocks side by side, one shuffle (C3)
* ``unpivot_rows``  row vectors -> triplets (C4)
* ``transpose``     swap rows and columns in bounded row blocks (C5)
* ``dense_index``   consecutive 0-based numbering without a one-task window (G5)
* ``file_order_index`` the same in file order, without moving rows (A3, A5, G5, G6)
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmodes.functions.blocks import AlignmentError
from fieldmodes.functions.packed import sparse_vector
from fieldmodes.operators.products import arrow_batch_guard

# A dimension table is broadcast only if its rows, counted, and the width of
# its types make at most this many bytes; a row count above BROADCAST_MAX_ROWS
# is not collected even if its rows are narrow.
BROADCAST_MAX_BYTES = 32 << 20
BROADCAST_MAX_ROWS = 2_000_000

_DUP_AGGS = {
    "error": lambda c: F.first(c, ignorenulls=False),
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
}
_MISSING = ("error", "null", "drop_row", "zero")


def _row_bytes(df: DataFrame) -> int:
    """Bytes of a row by its types: 8 a number or time, 64 a string, 1 KB anything else."""
    kinds = (t for _, t in df.dtypes)
    return 16 + sum(64 if t == "string" else 8 if t in _PLAIN_TYPES or t.startswith("timestamp") else 1024 for t in kinds)


_PLAIN_TYPES = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date")


def maybe_broadcast(df: DataFrame, n_rows: int | None) -> DataFrame:
    """Broadcast ``df`` only when its measured rows make few bytes."""
    if n_rows is not None and n_rows <= min(BROADCAST_MAX_ROWS, BROADCAST_MAX_BYTES // _row_bytes(df)):
        return F.broadcast(df)
    return df


def small_table(df: DataFrame, max_rows: int | None = None) -> tuple[DataFrame, int]:
    """Measure a dimension table once; when it has at most ``max_rows`` rows
    (by default as many as may be broadcast) return it rebuilt from the driver
    copy (later joins broadcast it without recomputing its plan), else keep it
    distributed.  Returns (df, rows)."""
    max_rows = min(BROADCAST_MAX_ROWS, BROADCAST_MAX_BYTES // _row_bytes(df)) if max_rows is None else max_rows
    probe = []
    for r in df.toLocalIterator():  # streamed; stops after max_rows + 1 rows
        probe.append(r)
        if len(probe) > max_rows:
            return df, df.count()
    return df.sparkSession.createDataFrame(probe, df.schema), len(probe)


def split_column_order(col_order: DataFrame, cond) -> tuple[DataFrame, int]:
    """Column order of a block of records (a piece) cut from a measured,
    local column order: filtered and renumbered 0.. without rescanning data."""
    spark = col_order.sparkSession
    rows = sorted(col_order.where(cond).collect(), key=lambda r: r["col_pos"])  # small: one row per record
    out = [(i, r[1]) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, col_order.schema), len(out)


def column_order(triplets: DataFrame, col: str = "record_id") -> DataFrame:
    """Sorted distinct column keys with 0-based positions.

    The distinct set is the time dimension (one row per record), so a
    single ordered window over it is cheap; data rows never go through it.
    """
    keys = triplets.select(col).where(F.col(col).isNotNull()).distinct()
    return keys.select(
        (F.row_number().over(Window.orderBy(col)) - 1).cast("int").alias("col_pos"), col
    )


def with_file_place(scan: DataFrame, fmt: str) -> DataFrame:
    """A file scan plus ``place``: the file, the split of it and the row's position that order its rows.

    ``scan`` comes straight from a reader.  Parquet knows the position of a row in its file; other formats give the
    first byte of the split, inside which rows keep their order.  Splits depend on the cluster's parallelism, so
    such a scan is checkpointed: counting and numbering must see the same ones."""
    meta = F.col("_metadata")
    if fmt == "parquet":
        place = F.struct(meta["file_path"].alias("file"), F.lit(0).cast("long").alias("block"), meta["row_index"].alias("at"))
        return scan.select("*", place.alias("place"))
    place = F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    from fieldmodes.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(scan.sparkSession)
    return scan.select("*", place.alias("place")).checkpoint(eager=True)


def file_order_index(placed: DataFrame, out_col: str = "idx", source_col: str | None = None) -> DataFrame:
    """Consecutive 0-based ``out_col`` in the order (source, file name, place in the file).

    ``placed`` has ``place`` from :func:`with_file_place`, all rows of every scan.  Rows do not move: each split's
    rows are counted, and a row's number is the rows of the splits before its own plus its position in it."""
    key = [F.col(source_col).alias("src") if source_col else F.lit(0).alias("src"), F.col("place.file").alias("file"), F.col("place.block").alias("block")]
    splits = placed.select(*key, F.col("place.at").alias("at")).groupBy("src", "file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("src", "file", "block")) - F.col("n")  # one row per split of a file
    splits, n_splits = small_table(splits.select("src", "file", "block", (before - F.col("first")).alias("shift")))
    splits = maybe_broadcast(splits.select(F.struct("src", "file", "block").alias("split"), "shift"), n_splits)
    out = placed.join(splits, F.struct(*key) == F.col("split"))
    return out.withColumn(out_col, F.col("place.at") + F.col("shift")).drop("place", "split", "shift")


def dense_index(df: DataFrame, order_cols: list[str] | None, out_col: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Consecutive 0-based ``out_col`` (G5, B3, A5), zipWithIndex-style.

    Rows are numbered inside each partition and shifted by per-partition
    offsets taken from a table with one row per partition (broadcast), so
    no data row goes through a single task.

    ``order_cols=None`` numbers rows in the order of the partitions, without
    a shuffle (for a scan that is not file order, see ``file_order_index``).  With ``order_cols`` the rows are range-partitioned and
    sorted first; that order is checkpointed into the shared checkpoint
    folder before numbering, because range bounds are re-sampled on every
    evaluation and both the counts and the numbering must see one order.
    """
    if order_cols:
        n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # "_tie" (a hash of the whole row) lets the range partitioner split
        # long runs of equal order keys.
        keys = [*order_cols, "_tie"]
        df = (df.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
              .repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie"))
        from fieldmodes.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    numbered = (df.withColumn("_mid", F.monotonically_increasing_id())
                .withColumn("_part", F.shiftright("_mid", 33))
                .withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1)))
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (numbered.join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn(out_col, F.col("_off") + F.col("_pos"))
            .drop("_mid", "_part", "_pos", "_off"))


def pivot_rows(triplets: DataFrame, col_order: DataFrame | None = None, *,
               row: str = "row_id", col: str = "record_id", value: str = "value",
               on_missing: str = "error", on_duplicate: str = "error", on_unknown: str = "error",
               n_cols: int | None = None, pre_aggregate: bool = True, laid_out: bool = False, sparse: bool = False) -> DataFrame:
    """Triplets -> ``(row_id BIGINT, vector ARRAY<DOUBLE>)``.

    Position j of every vector holds the cell of ``col_order`` position j
    (fixes M9: the reference silently shortened vectors).

    on_missing    'error' (fail), 'null' (NULL in place), 'drop_row', or
                  'zero' (0.0 in place: for fields of sums, where no
                  observation means a zero total).  A NULL value is a missing
                  cell; what 'drop_row' drops is counted by ``pivot_report``
    on_duplicate  'error' (fail) or an aggregate: 'avg' 'sum' 'min' 'max'
    on_unknown    a record that is NULL or not in ``col_order``: 'error', or
                  'drop' for a column order that is a block of the records
    NaN and infinite values fail: no product may run on them.
    pre_aggregate collapse duplicate cells map-side before the row shuffle
                  (default; guards against hot duplicated copies).  Pass
                  False when the triplets come out of a groupBy on
                  (row, col): one shuffle instead of two, and duplicates are
                  still detected inside each row.
    laid_out      the triplets come from a cell store (``sources.cellstore``):
                  every one has a row id and they lie by it, so neither step
                  shuffles a cell.
    sparse        with 'zero': rows as sparse vectors (``functions.packed``), which hold the cells and no zeros
    """
    if sparse and on_missing != "zero":
        raise ValueError("sparse rows need on_missing='zero'")
    if on_missing not in _MISSING:
        raise ValueError(f"on_missing must be one of {_MISSING}")
    if on_duplicate not in _DUP_AGGS:
        raise ValueError(f"on_duplicate must be one of {tuple(_DUP_AGGS)}")
    if on_unknown not in ("error", "drop"):
        raise ValueError("on_unknown must be 'error' or 'drop'")
    if col_order is None:
        col_order = column_order(triplets, col)
    if n_cols is None:
        col_order, n_cols = small_table(col_order)
    co = col_order.select(F.col("col_pos").cast("int").alias("col_pos"), col)
    rid = F.col(row).cast("long")
    # A cell without a location belongs to no row; fail before the shuffle
    # (NULL keys would all meet in one task).
    if not laid_out:  # (an expression would hide the layout)
        rid = F.when(rid.isNull(), F.raise_error(F.lit("triplet with NULL row id")).cast("long")).otherwise(rid)
    v = F.col(value).cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    v = F.when(bad, F.raise_error(F.concat(F.lit("non-finite value in row "), rid.cast("string"))).cast("double")).otherwise(v)
    t = triplets.select(rid.alias("row_id"), col, v.alias("value"))
    if on_unknown == "drop":
        t = t.join(maybe_broadcast(co, n_cols), col).drop(col)
    else:
        t = t.join(maybe_broadcast(co, n_cols), col, "left")
        lost = F.raise_error(F.concat(F.lit("record not in the column order: "), F.coalesce(F.col(col).cast("string"), F.lit("NULL"))))
        t = t.select("row_id", F.when(F.col("col_pos").isNull(), lost.cast("int")).otherwise(F.col("col_pos")).alias("col_pos"), "value")
    if pre_aggregate or on_duplicate != "error":
        # Stage 1: one value per cell.  Map-side partial aggregation collapses
        # a hot duplicated cell before the shuffle.
        cells = t.groupBy("row_id", "col_pos").agg(
            F.count(F.lit(1)).alias("_n"), _DUP_AGGS[on_duplicate]("value").alias("value"))
        # Stage 2: one row per location; a group holds at most n_cols cells.
        rows = cells.groupBy("row_id").agg(
            F.collect_list(F.struct("col_pos", "value")).alias("_cells"), F.max("_n").alias("_dup"))
    else:
        # Single shuffle; a repeated cell is still caught inside its row.
        rows = t.groupBy("row_id").agg(F.collect_list(F.struct("col_pos", "value")).alias("_cells"))
        n_distinct = F.size(F.array_distinct(F.transform("_cells", lambda x: x["col_pos"])))
        rows = rows.withColumn("_dup", F.when(n_distinct < F.size("_cells"), F.lit(2)).otherwise(F.lit(1)))
    rows = rows.withColumn("_cells", F.filter("_cells", lambda x: x["value"].isNotNull()))  # a NULL value is no cell
    dense = F.transform(F.array_sort("_cells"), lambda x: x["value"])
    if sparse:
        rows = rows.select("row_id", "_dup", F.array_sort("_cells").alias("_cells"))
        vec = sparse_vector(n_cols, F.transform("_cells", lambda x: x["col_pos"]), F.transform("_cells", lambda x: x["value"]))
    elif on_missing in ("null", "zero"):
        # Rows with gaps: real cells + one fill cell per position, sorted by
        # (position, real first); the first cell of each position wins.
        # O(m log m) per row (a map lookup per position would be O(m^2)).
        fill = F.lit(None).cast("double") if on_missing == "null" else F.lit(0.0)
        real = F.transform("_cells", lambda c: F.struct(c["col_pos"].alias("col_pos"), F.lit(0).alias("k"),
                                                         c["value"].alias("value")))
        fills = F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)),
                            lambda i: F.struct(i.alias("col_pos"), F.lit(1).alias("k"), fill.alias("value")))
        rows = rows.withColumn("_comb", F.when(F.size("_cells") < n_cols, F.array_sort(F.concat(real, fills))))
        comb = F.col("_comb")
        first = F.filter(comb, lambda x, j: (j == 0) | (comb[j - 1]["col_pos"] != x["col_pos"]))
        vec = F.when(F.size("_cells") == n_cols, dense).otherwise(F.transform(first, lambda x: x["value"]))
    elif on_missing == "error":
        vec = F.when(F.size("_cells") != n_cols,
                     F.raise_error(F.concat(F.lit("missing cell in row "), F.col("row_id").cast("string"))
                                   )).otherwise(dense)
    else:
        keep = F.size("_cells") == n_cols
        if on_duplicate == "error":
            keep = keep | (F.col("_dup") > 1)  # keep so the duplicate check below fails loudly
        rows = rows.where(keep)
        vec = dense
    if on_duplicate == "error":
        vec = F.when(F.col("_dup") > 1,
                     F.raise_error(F.concat(F.lit("duplicate cell in row "), F.col("row_id").cast("string"))
                                   )).otherwise(vec)
    return rows.select("row_id", (vec if sparse else vec.cast("array<double>")).alias("vector"))


def pivot_report(triplets: DataFrame, col_order: DataFrame, n_cols: int, *, row: str = "row_id",
                 col: str = "record_id", value: str = "value") -> DataFrame:
    """What a pivot loses, one row: rows seen, rows with a gap (dropped by 'drop_row'),
    NULL cells, triplets whose record is NULL or not in the column order."""
    t = triplets.select(F.col(row).alias("row_id"), F.col(col).alias("rec"), F.col(value).alias("value"))
    t = t.join(maybe_broadcast(col_order.select("col_pos", F.col(col).alias("rec")), n_cols), "rec", "left")
    cell = F.col("col_pos").isNotNull() & F.col("value").isNotNull()
    per = t.groupBy("row_id").agg(F.countDistinct(F.when(cell, F.col("col_pos"))).alias("n"),
                                  F.count_if(F.col("col_pos").isNotNull() & F.col("value").isNull()).alias("nulls"),
                                  F.count_if(F.col("col_pos").isNull()).alias("lost"))
    return per.agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(F.col("n") < n_cols).alias("rows_dropped"),
                   F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_cells"), F.coalesce(F.sum("lost"), F.lit(0)).alias("unmatched"))


def unpivot_rows(mat: DataFrame, vector: str = "vector") -> DataFrame:
    """Row vectors -> ``(row_id, col_pos, value)`` (C4)."""
    return mat.select("row_id", F.posexplode(vector).alias("col_pos", "value")).select(
        "row_id", F.col("col_pos").cast("int"), "value")


TRANSPOSE_BLOCK = 1 << 17  # values per output row block (1 MB of doubles)


def group_blocks(long: DataFrame, row: str, pos: str, value: str = "value",
                 block_size: int = TRANSPOSE_BLOCK, n: int | None = None, on_gap: str = "error") -> DataFrame:
    """Long cells -> ``(row_id, block, vector)`` with at most ``block_size``
    values per row block: the group size stays bounded however long the
    logical row is.  Position p lands in block p // block_size, at p % block_size.

    ``n`` is the logical row length (measured if not given).  A repeated
    position, one outside 0..n-1 and, with ``on_gap='error'``, a missing one
    fail; ``on_gap='null'`` puts NULL there.  Blocks without any cell have no row."""
    if on_gap not in ("error", "null"):
        raise ValueError("on_gap must be 'error' or 'null'")
    if n is None:
        n = (long.agg(F.max(F.col(pos).cast("long"))).first()[0] or 0) + 1
    t = long.select(F.col(row).cast("long").alias("row_id"), F.col(pos).cast("long").alias("_p"),
                    F.col(value).cast("double").alias("value"))
    t = t.withColumn("block", F.floor(F.col("_p") / block_size).cast("int"))
    g = t.groupBy("row_id", "block").agg(F.collect_list(F.struct("_p", "value")).alias("_c"))
    first = F.col("block").cast("long") * block_size
    size = F.least(F.lit(block_size).cast("long"), F.lit(n).cast("long") - first)
    cells = F.array_sort("_c")
    places = F.transform(cells, lambda x: x["_p"])
    at = F.concat(F.lit(" in row "), F.col("row_id").cast("string"), F.lit(", block "), F.col("block").cast("string"))

    def fail(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(what), at)).cast("array<double>")
    if on_gap == "error":
        vector = F.transform(cells, lambda x: x["value"])
        vector = F.when(F.size(places) < size, fail("missing position")).otherwise(vector)
    else:  # real cells and one NULL cell a position, sorted: the first of each position stays
        real = F.transform("_c", lambda x: F.struct(x["_p"].alias("p"), F.lit(0).alias("k"), x["value"].alias("v")))
        fills = F.transform(F.sequence(first, first + size - 1),
                            lambda i: F.struct(i.alias("p"), F.lit(1).alias("k"), F.lit(None).cast("double").alias("v")))
        both = F.array_sort(F.concat(real, fills))
        g = g.withColumn("_all", both)
        alls = F.col("_all")
        vector = F.transform(F.filter(alls, lambda x, j: (j == 0) | (F.get(alls, j - 1)["p"] != x["p"])), lambda x: x["v"])
    vector = F.when(F.size(F.array_distinct(places)) < F.size(places), fail("repeated position")).otherwise(vector)
    vector = F.when((F.get(places, F.lit(0)) < 0) | (F.get(places, F.size(places) - 1) >= n), fail("position outside the row")).otherwise(vector)
    return g.select("row_id", "block", vector.alias("vector"))


def unpivot_blocks(blocks: DataFrame, block_size: int = TRANSPOSE_BLOCK) -> DataFrame:
    """``(row_id, block, vector)`` -> ``(row_id, col_pos, value)``."""
    e = blocks.select("row_id", "block", F.posexplode("vector").alias("p", "value"))
    return e.select("row_id", (F.col("block").cast("long") * block_size + F.col("p")).alias("col_pos"), "value")


TILE_BYTES = 32 << 20  # values of one transposed tile group, which a task holds whole


def transpose(mat: DataFrame, block_size: int = TRANSPOSE_BLOCK) -> DataFrame:
    """Swap rows and columns (C5), by tiles.

    Old row ids become dense positions through ``dense_index`` (distributed);
    a transposed row has one value per old row, so it comes in blocks
    ``(row_id, block, vector)`` as from ``group_blocks``.  Each Arrow batch of
    rows is cut into tiles of one output block x one panel of columns, and the
    shuffle moves tiles, never cells.  A group is one block x one panel, at most
    ``TILE_BYTES`` of values.  NULL cells stay NULL; a NULL row, rows of
    different lengths and a repeated row id fail.
    """
    arrow_batch_guard(mat.sparkSession)
    ids = dense_index(mat.select("row_id"), ["row_id"], "new_col")
    n = ids.count()
    panel = max(1, TILE_BYTES // (8 * block_size))
    wide = mat.join(ids, "row_id").select("new_col", "vector")
    tiles = wide.mapInArrow(_cut_tiles(block_size, panel), "block int, panel int, width int, places array<bigint>, data array<double>")
    return tiles.groupBy("block", "panel").applyInArrow(_turn_tiles(block_size, panel, n), "row_id bigint, block int, vector array<double>")


def _cut_tiles(block_size: int, panel: int):
    """Batches of (new_col, vector) -> tiles, values row by row; gathers keep NULL cells."""
    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")
            m = np.diff(vectors.offsets.to_numpy())
            if vectors.null_count or (m != m[0]).any():
                raise AlignmentError("transpose needs rows of one length, none of them NULL")
            m, flat = int(m[0]), vectors.flatten()
            pos = batch.column("new_col").to_numpy()
            for block in np.unique(pos // block_size):
                rows = np.flatnonzero(pos // block_size == block)
                places = pa.array([pos[rows]], pa.list_(pa.int64()))
                for first in range(0, m, panel):
                    at = (rows[:, None] * m + np.arange(first, min(m, first + panel))).ravel()
                    data = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), flat.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([first // panel], pa.int32()), pa.array([m], pa.int32()), places, data],
                                                     names=["block", "panel", "width", "places", "data"])
    return cut


def _turn_tiles(block_size: int, panel: int, n: int):
    """All tiles of one (block, panel) -> its columns as rows."""
    def turn(tiles: pa.Table) -> pa.Table:
        tiles = tiles.combine_chunks()
        block, first = tiles["block"][0].as_py(), tiles["panel"][0].as_py() * panel
        widths = tiles["width"].unique().to_pylist()
        if len(widths) > 1:
            raise AlignmentError(f"transpose needs rows of one length, got {sorted(widths)}")
        places = pc.list_flatten(tiles["places"]).to_numpy()
        size, cols = min(block_size, n - block * block_size), min(panel, widths[0] - first)
        order = np.argsort(places, kind="stable")
        if not np.array_equal(places[order], np.arange(size) + block * block_size):
            raise AlignmentError(f"repeated or missing row in block {block} of a transposed row")
        at = (order[None, :] * cols + np.arange(cols)[:, None]).ravel()
        values = pc.list_flatten(tiles["data"]).combine_chunks().take(pa.array(at))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(cols + 1, dtype=np.int32) * size), values)
        return pa.table({"row_id": pa.array(np.arange(first, first + cols, dtype=np.int64)), "block": pa.array(np.full(cols, block, dtype=np.int32)), "vector": vectors})
    return turn


def pivot_components(long: DataFrame, i: str = "i", j: str = "j", value: str = "value",
                     block_size: int = TRANSPOSE_BLOCK, n: int | None = None, on_gap: str = "error") -> DataFrame:
    """Coordinate triplets (i = 0-based location, j = component) -> per
    component its values over locations (C5: eofs[j, i] = v), in bounded
    row blocks ``(row_id = component, block, vector)``; see ``group_blocks``."""
    return group_blocks(long, j, i, value, block_size, n, on_gap)


def hconcat(mats: list[DataFrame], how: str = "inner") -> DataFrame:
    """Glue column blocks side by side on ``row_id``.

    One shuffle for any number of pieces (the reference built a tree of
    joins).  'inner' drops a row missing from any piece.
    """
    if how != "inner":
        raise ValueError("only the inner rule (M10) is supported")
    if not mats:
        raise ValueError("hconcat needs at least one piece")
    n = len(mats)
    tagged = [m.select("row_id", F.lit(i).alias("piece"), "vector") for i, m in enumerate(mats)]
    u = reduce(DataFrame.unionByName, tagged)
    g = u.groupBy("row_id").agg(F.collect_list(F.struct("piece", "vector")).alias("_p"))
    g = g.where(F.size("_p") == n)
    # Safe even if evaluated before the filter: compares with the row's own size.
    g = g.withColumn("_p", F.when(F.size(F.array_distinct(F.transform("_p", lambda x: x["piece"]))) != F.size("_p"),
                                  F.raise_error(F.lit("row repeated inside one piece"))).otherwise(F.col("_p")))
    return g.select("row_id", F.flatten(F.transform(F.array_sort("_p"), lambda x: x["vector"])).alias("vector"))


def hconcat_dropped(mats: list[DataFrame]) -> DataFrame:
    """How many row ids the inner rule drops (one-row report)."""
    ids = reduce(DataFrame.unionByName, [m.select("row_id") for m in mats])
    per = ids.groupBy("row_id").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("rows_seen"),
                   F.sum(F.when(F.col("c") < len(mats), 1).otherwise(0)).alias("rows_dropped"))
