"""End-to-end jobs composed from the operators.

convert_records_job  long gridded records -> masked triplet text + record
            dates + rejects (resumable, shardable)
ingest_job  triplet text -> row matrix Parquet + column order + rejects
eof_job     row matrix -> preprocess -> EOFs -> factor tables
export_job  factor tables -> dated temporal EOFs, gridded spatial fields,
            coordinate text

Every step is a distributed read/transform/write; only the time-sized
column order, V and S pass through the driver.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmodes.operators import factorize as fz
from fieldmodes.operators import grid as gd
from fieldmodes.operators import ingest as ig
from fieldmodes.operators import preprocess as pp
from fieldmodes.operators import reshape as rs
from fieldmodes.operators import stats as st
from fieldmodes.plans.commitlog import CommitLog
from fieldmodes.session import Lifetime
from fieldmodes.sources import cellstore as cs
from fieldmodes.sources import readers as rd
from fieldmodes.sources import writers as wr


def convert_records_job(spark: SparkSession, grid_obs: DataFrame, grid: DataFrame, out: str,
                        n_shards: int = 1, shard: int = 0, key_fmt: str = "yyyyMMddHH",
                        block_size: int = wr.RECORD_BLOCK, record_keys: DataFrame | None = None) -> dict:
    """Gridded records -> triplets, resumable and re-runnable.

    ``grid_obs``: (record_key, message_no, cell_id, value NULL = masked), read twice in a run (its keys, its pending
    records), so a plan that is dear to compute should be written before.
    ``grid``: (cell_id, loc_id NULL = masked), the one fixed mask.
    ``record_keys``: the listing of record files, if there is one; else the
    keys are taken from the observations, a distinct over all of them.
    Records are numbered by key (B7), dated from the key (B8), sharded (B5);
    records already committed are skipped (B6).  Numbers are kept with the
    keys (``register_keys``), so a key that arrives late changes no other
    record; the column order by date is ``dated_order``.  The 41 depth
    messages are kept and leveled (B4), masked values dropped (B2),
    locations numbered from the grid (B3).  A value at a cell the grid masks
    goes to rejects (A17).

    Every run writes ``vals`` (A10), ``rejects`` and ``record_dates`` (A13)
    of its pending records into a batch of its own and then commits it with
    one entry of the commit log.  Readers go through the log, so a batch
    whose run died, or is still being written, is not there.  Runs may
    overlap: one that finds records of its batch committed by another in the
    meantime leaves its batch uncommitted and converts what is still pending."""
    listing = (grid_obs if record_keys is None else record_keys).select("record_key")
    keys = register_keys(spark, listing, out)
    if n_shards > 1:
        keys = ig.shard(keys, n_shards, shard)
    keys = keys.select("record_id", "record_key", ig.date_from_key("record_key", 3, key_fmt).alias("obs_ts"))
    log = CommitLog(spark, f"{out}/{COMMITS}")
    while True:
        entries = log.entries()
        pending = ig.pending_records(keys, _records_of(spark, out, entries)) if entries else keys
        mine, n_new = rs.small_table(pending)  # one row per record file
        if not n_new:
            return {"records": 0, "batch": None}
        batch = _write_batch(grid_obs, mine, n_new, grid, out, key_fmt, block_size)
        number, free = len(entries), True
        while free and not log.append(number, {"batch": batch, "records": n_new}):
            later = log.entries()[number:]
            free = mine.join(_records_of(spark, out, later), "record_id", "left_semi").isEmpty()
            number += len(later)
        if free:
            return {"records": n_new, "batch": batch, "vals": f"{out}/vals"}


COMMITS = "_commits"


def _write_batch(grid_obs: DataFrame, keys: DataFrame, n_keys: int, grid: DataFrame, out: str, key_fmt: str, block_size: int) -> str:
    batch = f"{_batch_name(keys)}-{uuid.uuid4().hex[:8]}"
    obs = grid_obs.join(rs.maybe_broadcast(keys, n_keys), "record_key")
    obs = ig.compress_mask(ig.select_levels(obs, "message_no"))
    located = obs.join(grid.select("cell_id", "loc_id"), "cell_id", "left").select("record_id", "record_key", "cell_id", "loc_id", "value")
    with Lifetime(grid_obs.sparkSession) as life:  # written to two places, read and joined once
        located = life.cache(located)
        good = located.where(F.col("loc_id").isNotNull()).select("record_id", F.col("loc_id").alias("row_id"), "value")
        bad = located.where(F.col("loc_id").isNull()).select("record_id", "record_key", "cell_id", "value")
        wr.write_triplets(good, f"{out}/vals/batch={batch}", block_size=block_size)
        bad.write.parquet(f"{out}/rejects/batch={batch}")
    wr.write_record_dates(keys.select("record_id", "obs_ts"), f"{out}/record_dates/batch={batch}", key_fmt)
    return batch


def _date_folders(out: str, entries: list[dict]) -> list[str]:
    return [f"{out}/record_dates/batch={e['batch']}" for e in entries]


def _records_of(spark: SparkSession, out: str, entries: list[dict]) -> DataFrame:
    """(record_id) of the records of some committed batches."""
    return spark.read.schema("record_id INT, date_text STRING").csv(_date_folders(out, entries)).select("record_id").distinct()


def converted_records(spark: SparkSession, out: str) -> DataFrame | None:
    """(record_id) of the records of committed runs; None if nothing was converted."""
    entries = CommitLog(spark, f"{out}/{COMMITS}").entries()
    return _records_of(spark, out, entries) if entries else None


def _batch_name(keys: DataFrame) -> str:
    sums = keys.agg(F.count("*"), F.min("record_id"), F.max("record_id"), F.bit_xor(F.xxhash64("record_id", "record_key"))).first()
    return hashlib.sha1(",".join(map(str, sums)).encode()).hexdigest()[:16]


def register_keys(spark: SparkSession, listing: DataFrame, out: str) -> DataFrame:
    """(record_id, record_key) of all listed records; new keys are numbered and written to ``out/registry``.

    The first listing numbers its keys in their order from 0; keys listed later
    get, in their order, the numbers after the largest one given.  Listings that
    are registered at the same time go one after the other: new keys are written
    to a folder of their own, and a log entry makes them known; if another run
    took the entry, its keys are known now and the rest is numbered again."""
    schema = "record_id INT, record_key STRING"
    log = CommitLog(spark, f"{out}/registry/_log")
    read = lambda entries: spark.read.schema(schema).parquet(*[f"{out}/registry/batch={e['batch']}" for e in entries])
    listed, _ = rs.small_table(listing.select("record_key").distinct())  # one row per record file, read once
    while True:
        entries = log.entries()
        new, first = (listed.join(read(entries), "record_key", "left_anti") if entries else listed), sum(e["keys"] for e in entries)
        new = ig.number_records(new).select((F.col("record_id") + first).cast("int").alias("record_id"), "record_key")
        new, n = rs.small_table(new)
        if not n:
            return (read(entries) if entries else spark.createDataFrame([], schema)).join(listed, "record_key", "left_semi")
        batch = f"{_batch_name(new)}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(f"{out}/registry/batch={batch}")
        log.append(len(entries), {"batch": batch, "keys": n})


def read_converted(spark: SparkSession, out: str) -> DataFrame:
    """Triplets of committed conversion batches only (see convert_records_job)."""
    batches = [e["batch"] for e in CommitLog(spark, f"{out}/{COMMITS}").entries()]
    return rd.read_triplets(spark, f"{out}/vals").where(F.col("batch").isin(batches)).drop("batch")  # folders are pruned


def dated_order(spark: SparkSession, out: str, key_fmt: str = "yyyyMMddHH") -> DataFrame:
    """Column order of a conversion by date: (col_pos, record_id), whatever order the keys came in."""
    dates = rd.read_record_dates(spark, _date_folders(out, CommitLog(spark, f"{out}/{COMMITS}").entries()), key_fmt)
    w = Window.orderBy("obs_ts", "record_id")  # one row per record
    return dates.select((F.row_number().over(w) - 1).cast("int").alias("col_pos"), "record_id")


def ingest_job(spark: SparkSession, triplet_path: str, out: str, blocks: list[int] | None = None,
               on_missing: str = "error", on_duplicate: str = "error", mode: str = "errorifexists",
               cells: str | None = None, buckets: int | None = None) -> dict:
    """Triplet text -> ``out/rowmat`` (Parquet), ``out/col_order``, ``out/rejects``.

    The text is read once: one job parses it into a cell store (see
    ``sources.cellstore``) and collects the record ids; the rows come from the
    store without a further shuffle.  Malformed lines go to the reject table
    and the job goes on (A17).  The column order covers every record present
    in the selected blocks.  ``cells`` keeps the store at that path."""
    with Lifetime(spark) as life:
        store = cells or life.scratch("cells")
        records = cs.write_cells(spark, triplet_path, store, blocks, buckets)
        co = spark.createDataFrame(list(enumerate(records)), "col_pos INT, record_id INT")
        mat = rs.pivot_rows(cs.read_cells(spark, store), co, n_cols=len(records), on_missing=on_missing, on_duplicate=on_duplicate, laid_out=True)
        wr.write_row_matrix(mat, f"{out}/rowmat", mode=mode)
        wr.write_col_order(co, f"{out}/col_order", mode=mode)
        cs.read_rejects(spark, store).write.mode(mode).parquet(f"{out}/rejects")
    return {"rowmat": f"{out}/rowmat", "col_order": f"{out}/col_order", "rejects": f"{out}/rejects",
            "n_cols": len(records)}


def eof_job(spark: SparkSession, rowmat_path: str | None, out: str, k: int, method: str = "exact",
            preprocess: str = pp.CENTER, weights: DataFrame | None = None, mode: str = "errorifexists",
            manifest: str | None = None, **kw) -> fz.EOFResult:
    """Row matrix -> preprocessing -> EOFs -> ``out/{u,s,v,row_stats}``.

    The input is one row matrix, or a text ``manifest`` of several (see
    ``readers.parse_manifest``), rows numbered in file order.
    The preprocessed rows are persisted once and scanned by every pass; the
    factor tables are written distributed (U) or tiny (S, V)."""
    mat = rd.read_row_matrix(spark, rowmat_path) if manifest is None else rd.read_manifest(spark, rd.parse_manifest(spark, manifest), file_order=True)
    p = pp.preprocess(mat, preprocess, weights)
    with Lifetime(spark) as life:
        rows = life.cache(p.rows)
        x = rows.select("row_id", "vector")
        n, m = st.dims(x)
        res = fz.compute_eofs(x, k, method, n_rows=n, n_cols=m, **kw)
        results = res if isinstance(res, dict) else {"": res}
        for suffix, r in results.items():
            wr.save_factors(spark, r, f"{out}{suffix}", row_stats=rows.select("row_id", "mean", "std"), mode=mode)
    return res


def combine_job(spark: SparkSession, pieces: list[str], out: str, mode: str = "errorifexists") -> dict:
    """Row matrices of consecutive blocks of records, glued side by side: ``out/rowmat``.

    Rows missing from a piece are dropped (M10) and counted in ``out/dropped``."""
    mats = [rd.read_row_matrix(spark, p) for p in pieces]
    wr.write_row_matrix(rs.hconcat(mats), f"{out}/rowmat", mode=mode)
    rs.hconcat_dropped(mats).write.mode(mode).parquet(f"{out}/dropped")
    return {"rowmat": f"{out}/rowmat", "pieces": len(pieces)}


def export_job(spark: SparkSession, factors_path: str, grid: DataFrame, out: str,
               col_order: DataFrame | None = None, record_dates: DataFrame | None = None,
               attrs: dict | None = None, mode: str = "errorifexists") -> dict:
    """Factor tables -> gridded fields + dated temporal EOFs + coordinate text.

    ``grid`` is (cell_id, level_i, lat_i, lon_i, lat, lon, depth_m, loc_id);
    ``loc_id`` names the matrix row observed at that cell (NULL = masked).
    Components and the mean become one field each, filled where masked."""
    f = rd.load_factors(spark, factors_path)
    u_long, s, v = f["u"], f["s"], f["v"]
    k = s.count()
    # wide U per location: k values sorted by component (k is small)
    u_wide = u_long.groupBy(F.col("row_id").alias("loc_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "value"))), lambda x: x["value"])
        .alias("vector"))
    fields = gd.expand_to_grid(u_wide, grid, k)
    if "row_stats" in f:
        mean = f["row_stats"].select(F.col("row_id").alias("loc_id"), F.array("mean").alias("vector"))
        mean_field = gd.expand_to_grid(mean, grid, 1).withColumn("component", F.lit(-1))  # -1 = mean field
        fields = fields.unionByName(mean_field)
    wr.write_fields(fields, f"{out}/fields", attrs=attrs or {"_FillValue": gd.FILL}, mode=mode)
    if col_order is not None:
        vv = v
        if record_dates is not None:
            vv = gd.attach_dates(v, col_order, record_dates)
        vv.write.mode(mode).parquet(f"{out}/temporal")
    n_rows = u_long.select("row_id").distinct().count()
    n_dates = v.select("col_pos").distinct().count()
    wr.write_coordinate_text(u_long, f"{out}/colEOFs", n_rows, k, i="row_id", j="component")
    wr.write_coordinate_text(v, f"{out}/rowEOFs", n_dates, k, i="col_pos", j="component")
    if "row_stats" in f:  # 1-column matrix: the mean of each location
        wr.write_coordinate_text(f["row_stats"].select("row_id", F.lit(0).alias("j"), F.col("mean").alias("value")), f"{out}/rowMeans", n_rows, 1,
                                 i="row_id", j="j")
    wr.write_coordinate_text(s.select(F.lit(0).alias("i"), "component", "sigma"), f"{out}/evalEOFs", 1, k,
                             i="i", j="component", value="sigma")
    return {"fields": f"{out}/fields", "k": k}
