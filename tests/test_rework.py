"""One behaviour at every width, true convergence, aligned blocks, missing cells and resumed jobs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmodes import session
from fieldmodes.operators import factorize as fz
from fieldmodes.operators import gapfill as gf
from fieldmodes.operators import products as pr
from fieldmodes.operators import reshape as rs
from fieldmodes.plans import catalog as cat
from fieldmodes.plans import jobs as jb
from fieldmodes.session import scratch_path
from fieldmodes.sources import readers as rd
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


# ---- solvers ---------------------------------------------------------------------


def _flat(n=200, m=120, seed=0):
    """A field whose spectrum decays slowly."""
    rng = np.random.default_rng(seed)
    u, v = np.linalg.qr(rng.standard_normal((n, m)))[0], np.linalg.qr(rng.standard_normal((m, m)))[0]
    return (u * np.linspace(2, 1, m)) @ v.T


def test_krylov_equals_numpy_with_either_product(mk):
    a = _flat()
    s = np.linalg.svd(a, compute_uv=False)[:4]
    for product in ("distributed", "gram"):
        r = fz.eof_exact(mk(a, 3).persist(), 4, product=product, tol=1e-8)
        assert r.converged and r.residual <= 1e-8 and r.iterations > 1
        assert np.allclose(r.s, s, rtol=1e-10)


def test_unconverged_is_said(mk):
    with pytest.warns(UserWarning, match="not converged"):
        r = fz.eof_exact(mk(_flat(), 2).persist(), 4, max_iter=2)
    assert r.converged is False and r.residual > 1e-10 and r.iterations == 2


def test_krylov_on_a_rank_one_field(mk):
    a = np.outer(np.arange(1.0, 31), np.arange(1.0, 21))
    r = fz.eof_exact(mk(a, 2).persist(), 3)
    assert r.converged and r.n_computed == 1 and np.isclose(r.s[0], np.linalg.norm(a))


def test_randomized_row_fails_for_a_wrong_product_or_no_rounds(spark, monkeypatch):
    con, name = duck(SF), "eof_randomized_order_month"
    check = lambda: compare(spark, name, cat.QUERIES[name], cat.ORACLES[name], SF, con)["status"]
    assert check() == "match"
    with monkeypatch.context() as m:
        m.setattr(fz, "cov_multiply", lambda mat, y, n: np.zeros_like(y))
        assert check() != "match"
    with monkeypatch.context() as m:
        real = fz.eof_randomized
        m.setattr(fz, "eof_randomized", lambda *a, **k: real(*a, **{**k, "power_iters": 0}))
        assert check() != "match"


def test_gram_long_in_panels(mk):
    a = np.random.default_rng(1).standard_normal((40, 11))
    g = {(r["i"], r["j"]): r["value"] for r in pr.gram_long(mk(a, 3), 11, panel=4).collect()}
    assert len(g) == 121 and np.allclose([[g[i, j] for j in range(11)] for i in range(11)], a.T @ a)


def test_partials_tree_equals_the_driver_sum(mk, monkeypatch):
    a = np.random.default_rng(2).standard_normal((300, 9))
    monkeypatch.setattr(pr, "DRIVER_PARTIALS_MAX_BYTES", 0)
    monkeypatch.setattr(pr, "FANOUT", 2)
    monkeypatch.setattr(pr, "GROUP_TARGET_BYTES", 8 * 9 * 2 * 4)  # blocks of 4 rows
    assert np.allclose(pr.gram(mk(a, 7), 9), a.T @ a)


def test_counting_tasks_does_not_run_the_plan(spark, mk):
    """A product scans its input once, however its plan is partitioned."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    a = np.random.default_rng(3).standard_normal((64, 5))
    df = mk(a, 4).repartition(6, "row_id")
    df = df.mapInArrow(count, df.schema)
    pr.cov_multiply(df, np.eye(5), 64)
    assert seen.value == 64


def test_gap_filling_is_the_same_at_any_width(spark, mk):
    rng = np.random.default_rng(5)
    a = np.outer(rng.standard_normal(40), rng.standard_normal(30)) + np.outer(rng.standard_normal(40), rng.standard_normal(30)) * 0.3
    gap = rng.random(a.shape) < 0.05
    x = np.where(gap, np.nan, a)

    def brute(k, rounds):
        cur = np.where(gap, np.nanmean(x, axis=1, keepdims=True), a)
        for _ in range(rounds):
            mu = cur.mean(axis=1, keepdims=True)
            v = np.linalg.svd(cur - mu, full_matrices=False)[2][:k].T
            cur = np.where(gap, (cur - mu) @ v @ v.T + mu, a)
        return cur
    df = spark.createDataFrame([(i, [None if np.isnan(c) else float(c) for c in r]) for i, r in enumerate(x)], "row_id long, vector array<double>")
    with pytest.warns(UserWarning, match="not converged"):
        out, info = gf.dineof_fill(df, 3, 30, max_iter=3, tol=1e-12)
    got = np.array([r["vector"] for r in out.orderBy("row_id").collect()])
    assert info["iterations"] == 3 and not info["converged"] and info["n_missing"] == gap.sum()
    assert np.allclose(got, brute(3, 3), atol=1e-6)


# ---- alignment -------------------------------------------------------------------


def _cells(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, value double")


def test_blocks_keep_positions(spark):
    long = _cells(spark, [(0, 0, 1.0), (1, 0, 2.0), (3, 0, 4.0)])
    with pytest.raises(Exception, match="missing position"):
        rs.pivot_components(long).collect()
    got = rs.pivot_components(long, block_size=3, n=5, on_gap="null").orderBy("block").collect()
    assert [r["vector"] for r in got] == [[1.0, 2.0, None], [4.0, None]]
    with pytest.raises(Exception, match="repeated position"):
        rs.pivot_components(_cells(spark, [(0, 0, 1.0), (0, 0, 1.0), (1, 0, 2.0)])).collect()
    with pytest.raises(Exception, match="outside"):
        rs.pivot_components(_cells(spark, [(0, 0, 1.0), (7, 0, 1.0)]), n=5, on_gap="null").collect()


def _trip(spark, rows):
    return spark.createDataFrame(rows, "row_id long, record_id int, value double")


def test_null_cells_are_missing(spark):
    t = _trip(spark, [(1, 1, 1.0), (1, 2, None), (2, 1, 3.0), (2, 2, 4.0)])
    co = rs.column_order(t)
    for pre in (True, False):
        with pytest.raises(Exception, match="missing cell"):
            rs.pivot_rows(t, co, pre_aggregate=pre).collect()
        rows = lambda how: {r["row_id"]: r["vector"] for r in rs.pivot_rows(t, co, on_missing=how, pre_aggregate=pre).collect()}  # noqa: E731,B023
        assert rows("drop_row") == {2: [3.0, 4.0]}
        assert rows("zero") == {1: [1.0, 0.0], 2: [3.0, 4.0]} and rows("null")[1] == [1.0, None]
    r = rs.pivot_report(t, co, 2).first()
    assert (r["rows_seen"], r["rows_dropped"], r["null_cells"], r["unmatched"]) == (2, 1, 1, 0)


def test_unknown_records_and_bad_numbers_fail(spark):
    t = _trip(spark, [(1, 1, 1.0), (1, 2, 2.0), (1, None, 3.0)])
    co = spark.createDataFrame([(0, 1), (1, 2)], "col_pos int, record_id int")
    with pytest.raises(Exception, match="not in the column order"):
        rs.pivot_rows(t, co).collect()
    assert rs.pivot_rows(t, co, on_unknown="drop").first()["vector"] == [1.0, 2.0]
    assert rs.pivot_report(t, co, 2).first()["unmatched"] == 1
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="non-finite"):
            rs.pivot_rows(_trip(spark, [(1, 1, bad)])).collect()


# ---- jobs ------------------------------------------------------------------------


def _obs(spark, days):
    rows = [(f"obs.daily.202001{d:02d}00.grb2", 207, c, float(d * 10 + c)) for d in days for c in range(2)]
    return spark.createDataFrame(rows, "record_key string, message_no int, cell_id bigint, value double")


def test_late_keys_are_converted_once(spark):
    grid = spark.createDataFrame([(0, 0), (1, 1)], "cell_id bigint, loc_id bigint")
    out = scratch_path(spark, "late")
    assert jb.convert_records_job(spark, _obs(spark, [2, 3]), grid, out)["records"] == 2
    assert jb.convert_records_job(spark, _obs(spark, [1, 2, 3]), grid, out)["records"] == 1
    assert jb.convert_records_job(spark, _obs(spark, [1, 2, 3]), grid, out)["records"] == 0
    got = jb.read_converted(spark, out).join(jb.dated_order(spark, out), "record_id").orderBy("col_pos", "row_id").collect()
    assert [(r["col_pos"], r["row_id"], r["value"]) for r in got] == [(d - 1, c, float(d * 10 + c)) for d in (1, 2, 3) for c in (0, 1)]
    mat = rs.pivot_rows(jb.read_converted(spark, out), jb.dated_order(spark, out)).orderBy("row_id").collect()
    assert [r["vector"] for r in mat] == [[10.0, 20.0, 30.0], [11.0, 21.0, 31.0]]


def test_manifest_combine_and_convert_from_the_command_line(spark, mk, capsys):
    from fieldmodes.__main__ import main
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((12, 5)), rng.standard_normal((8, 5))
    pa_, pb_, man, fac, glued = (scratch_path(spark, x) for x in ("ma", "mb", "man", "mfac", "glued"))
    mk(a).write.parquet(pa_)
    mk(b).write.orc(pb_)
    spark.createDataFrame([("# parts of the field",), (f"{pa_},parquet,2",), ("",), (f"{pb_},orc",)], "value string").coalesce(1).write.text(man)
    main(["eofs", man, fac, "none", "2", "exact", "--manifest"])
    info = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert info["exact"]["U"] == [20, 2]
    s = sorted((r["sigma"] for r in rd.load_factors(spark, fac)["s"].collect()), reverse=True)
    assert np.allclose(s, np.linalg.svd(np.vstack([a, b]), compute_uv=False)[:2])
    main(["combine", glued, pa_, pa_])
    assert np.allclose([r["vector"] for r in rd.read_row_matrix(spark, f"{glued}/rowmat").orderBy("row_id").collect()], np.hstack([a, a]))
    obs, grid, out, keys = (scratch_path(spark, x) for x in ("cobs", "cgrid", "cout", "ckeys"))
    _obs(spark, [1, 2]).write.parquet(obs)
    spark.createDataFrame([(0, 0), (1, 1)], "cell_id bigint, loc_id bigint").write.parquet(grid)
    spark.createDataFrame([("obs.daily.2020010200.grb2",)], "value string").write.text(keys)
    main(["convert", obs, grid, out, "--keys", keys])
    assert sorted(r["value"] for r in jb.read_converted(spark, out).collect()) == [20.0, 21.0]


def test_export_writes_row_means(spark, mk):
    from fieldmodes.operators import grid as gd
    from fieldmodes.sources import writers as wr
    a = np.random.default_rng(9).standard_normal((6, 4)) + 3
    rm, fac, out = (scratch_path(spark, x) for x in ("rm", "rfac", "rout"))
    wr.write_row_matrix(mk(a), rm)
    jb.eof_job(spark, rm, fac, 2)
    cells = spark.range(6).select(F.col("id").alias("cell_id"))
    grid = gd.attach_loc_ids(gd.build_grid_dim(cells, 2, 3), cells.select("cell_id", F.col("cell_id").alias("loc_id")))
    jb.export_job(spark, fac, grid, out)
    got = {r["i"]: r["value"] for r in rd.read_coordinate_text(spark, f"{out}/rowMeans").collect()}
    assert np.allclose([got[i] for i in range(6)], a.mean(axis=1))


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
