import numpy as np
from pyspark.sql import functions as F

from fieldmodes.operators import grid as gd
from fieldmodes.plans import jobs as jb
from fieldmodes.session import scratch_path
from fieldmodes.sources import readers as rd
from fieldmodes.sources import writers as wr


def _field(spark, n=30, m=6, seed=4):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, 2)) @ rng.standard_normal((2, m)) + rng.normal(0, 0.01, (n, m))
    rows = [(int(r), int(1990 + c), float(a[r, c])) for r in range(n) for c in range(m)]
    return spark.createDataFrame(rows, "row_id bigint, record_id int, value double"), a


def test_ingest_eof_both_and_export(spark):
    t, a = _field(spark)
    src, out, fac, exp = (scratch_path(spark, x) for x in ("src", "ing", "fac", "exp"))
    wr.write_triplets(t, src, block_size=3)
    paths = jb.ingest_job(spark, src, out)
    assert paths["n_cols"] == 6
    res = jb.eof_job(spark, paths["rowmat"], fac, 2, "both", seed=1)
    s = np.linalg.svd(a - a.mean(axis=1, keepdims=True), compute_uv=False)[:2]
    for suffix in ("exact", "inexact"):
        got = sorted(r.sigma for r in rd.load_factors(spark, f"{fac}{suffix}")["s"].collect())[::-1]
        assert np.allclose(got, s, rtol=1e-6)
    assert set(res) == {"exact", "inexact"}
    cells = spark.range(40).select(F.col("id").alias("cell_id"))
    grid = gd.attach_loc_ids(gd.build_grid_dim(cells, 2, 4),
                             spark.range(30).select(F.col("id").alias("cell_id"), F.col("id").alias("loc_id")))
    co = rd.read_col_order(spark, [paths["col_order"]])
    dates = co.select("record_id", F.make_timestamp_ntz("record_id", F.lit(1), F.lit(1), F.lit(0), F.lit(0),
                                                        F.lit(0)).alias("obs_ts"))
    jb.export_job(spark, f"{fac}exact", grid, exp, col_order=co, record_dates=dates)
    fields = spark.read.parquet(f"{exp}/fields/fields")
    assert fields.count() == 40 * 3  # 2 components + the mean field
    assert fields.where((F.col("cell_id") >= 30) & (F.col("value") != gd.FILL)).count() == 0
    temporal = spark.read.parquet(f"{exp}/temporal")
    assert temporal.where(F.col("obs_ts").isNull()).count() == 0 and temporal.count() == 12
    u = rd.read_coordinate_text(spark, f"{exp}/colEOFs")
    assert u.count() == 60 and u.agg(F.max("i")).first()[0] == 29


def test_command_line(spark, capsys):
    import json

    from fieldmodes.__main__ import main
    t, a = _field(spark)
    src, out, fac, exp, gp = (scratch_path(spark, x) for x in ("c_src", "c_ing", "c_fac", "c_exp", "c_grid"))
    wr.write_triplets(t, src)
    main(["ingest", src, out])
    main(["eofs", f"{out}/rowmat", fac, "centerOverAllObservations", "2", "both"])
    info = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert info["exact"]["S"] == 2 and info["inexact"]["V"] == [6, 2]
    cells = spark.range(30).select(F.col("id").alias("cell_id"))
    gd.attach_loc_ids(gd.build_grid_dim(cells, 2, 3), cells.select("cell_id", F.col("cell_id").alias("loc_id"))) \
        .write.parquet(gp)
    main(["export", f"{fac}exact", gp, exp, "--col-order", f"{out}/col_order"])
    assert spark.read.parquet(f"{exp}/fields/fields").count() == 30 * 3


def test_convert_records_survives_an_uncommitted_batch(spark):
    rows = [(f"obs.daily.20200101{h:02d}.grb2", 207 if c % 2 else 40, c, float(c + h) if c != 3 else None)
            for h in range(3) for c in range(6)]
    grid_obs = spark.createDataFrame(rows, "record_key string, message_no int, cell_id bigint, value double")
    grid = spark.createDataFrame([(c, c if c != 5 else None) for c in range(6)], "cell_id bigint, loc_id bigint")
    out = scratch_path(spark, "conv")
    # a run that died after writing its triplets but before its commit marker
    orphan = spark.createDataFrame([(0, 0, 99.0)], "record_id int, row_id bigint, value double")
    wr.write_triplets(orphan, f"{out}/vals/batch=deadbeef", mode="overwrite")
    first = jb.convert_records_job(spark, grid_obs, grid, out, n_shards=2, shard=0)
    again = jb.convert_records_job(spark, grid_obs, grid, out, n_shards=2, shard=0)  # nothing pending
    rest = jb.convert_records_job(spark, grid_obs, grid, out)
    assert first["records"] == 2 and again["records"] == 0 and rest["records"] == 1
    got = sorted(tuple(r) for r in jb.read_converted(spark, out).collect())
    # 3 records x 4 observed, unmasked cells (cell 3 NULL, cell 5 masked by the grid)
    assert len(got) == 12 and len(set((r[0], r[1]) for r in got)) == 12
    assert (0, 0, 99.0) not in got
    assert spark.read.parquet(f"{out}/rejects").count() == 3  # cell 5 in each record


def _conversion(spark, hours):
    rows = [(f"obs.daily.20200101{h:02d}.grb2", 207, c, float(10 * h + c)) for h in hours for c in range(2)]
    return spark.createDataFrame(rows, "record_key string, message_no int, cell_id bigint, value double")


def _cells(spark):
    return spark.createDataFrame([(0, 0), (1, 1)], "cell_id bigint, loc_id bigint")


def test_commit_log_gives_a_number_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    from fieldmodes.plans.commitlog import CommitLog
    log = CommitLog(spark, scratch_path(spark, "log"))
    assert log.entries() == []
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: log.append(0, {"run": k}), range(16)))
    assert sum(won) == 1 and log.entries() == [{"run": won.index(True)}]
    assert log.append(1, {"run": "x"}) and not log.append(1, {"run": "y"}) and [e["run"] for e in log.entries()][1] == "x"


def test_listings_registered_at_once_get_distinct_ids(spark, monkeypatch):
    """Another run registers an overlapping listing between numbering and commit."""
    from fieldmodes.plans import commitlog
    out = scratch_path(spark, "reg")
    append, late = commitlog.CommitLog.append, []

    def slow(self, number, entry):
        if not late:
            late.append(1)
            jb.register_keys(spark, _conversion(spark, [1, 5]), out).collect()
        return append(self, number, entry)
    monkeypatch.setattr(commitlog.CommitLog, "append", slow)
    mine = {r.record_key: r.record_id for r in jb.register_keys(spark, _conversion(spark, [0, 1, 2]), out).collect()}
    monkeypatch.undo()
    every = {r.record_key[18:20]: r.record_id for r in jb.register_keys(spark, _conversion(spark, range(6)), out).collect()}
    assert {k[18:20]: v for k, v in mine.items()} == {"01": 0, "00": 2, "02": 3} and every["05"] == 1
    assert sorted(every.values()) == list(range(6))


def test_overlapping_conversions_convert_each_record_once(spark, monkeypatch):
    from fieldmodes.plans import commitlog
    out, obs, grid = scratch_path(spark, "over"), _conversion(spark, range(4)), _cells(spark)
    jb.register_keys(spark, obs, out).collect()
    append, late = commitlog.CommitLog.append, []

    def slow(self, number, entry):
        if not late and "records" in entry:
            late.append(1)
            jb.convert_records_job(spark, obs, grid, out, n_shards=2, shard=1)
        return append(self, number, entry)
    monkeypatch.setattr(commitlog.CommitLog, "append", slow)
    first = jb.convert_records_job(spark, obs, grid, out)
    assert first["records"] == 2  # the other shard's records were committed by then
    got = sorted(tuple(r) for r in jb.read_converted(spark, out).collect())
    assert got == [(h, c, float(10 * h + c)) for h in range(4) for c in range(2)]
    assert [r.record_id for r in jb.dated_order(spark, out).orderBy("col_pos").collect()] == [0, 1, 2, 3]
    assert jb.convert_records_job(spark, obs, grid, out)["records"] == 0


def test_a_run_reads_the_records_twice(spark, tmp_path):
    """Once for their keys and once to convert them: values and rejects come of one reading."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    cells = spark.range(20).select(F.concat(F.lit("obs.daily."), (F.col("id") % 2 + 1995).cast("string"), F.lit("010100.grb2")).alias("record_key"),
                                   F.lit(207).alias("message_no"), F.col("id").alias("cell_id"), F.col("id").cast("double").alias("value"))
    grid = spark.range(15).select(F.col("id").alias("cell_id"), F.col("id").alias("loc_id"))
    out = str(tmp_path / "converted")
    assert jb.convert_records_job(spark, cells.mapInArrow(count, cells.schema), grid, out)["records"] == 2
    assert seen.value == 40
    assert jb.read_converted(spark, out).count() == 15 and spark.read.parquet(f"{out}/rejects").count() == 5
