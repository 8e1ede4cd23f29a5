"""Sparse and packed rows against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmodes.functions import packed as pk
from fieldmodes.operators import factorize as fz
from fieldmodes.operators import preprocess as pp
from fieldmodes.operators import products as pr
from fieldmodes.operators import reshape as rs
from fieldmodes.operators import stats as st


def _triplets(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j]) if a[i, j] else None) for i, j in np.ndindex(a.shape)], "row_id bigint, record_id int, value double").repartition(3)


def _both(spark, a):
    t = _triplets(spark, a)
    return (rs.pivot_rows(t, on_missing="zero", sparse=s, pre_aggregate=False) for s in (False, True))


def _field(share, shape=(90, 23), seed=0):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(shape) < share, rng.standard_normal(shape), 0.0)
    a[5] = 0.0  # a row without cells
    return a


@pytest.mark.parametrize("share", [0.02, 0.6])
@pytest.mark.parametrize("centered", [False, True])
def test_products_of_sparse_rows(spark, monkeypatch, share, centered):
    a = _field(share)
    dense, sparse = _both(spark, a)
    if centered:
        dense, sparse, a = pp.center_rows(dense).drop("mean"), pp.center_rows(sparse).drop("mean"), a - a.mean(axis=1, keepdims=True)
    assert pk.is_sparse(sparse) and not pk.is_sparse(dense) and st.dims(sparse) == st.dims(dense) == a.shape
    packed = pk.pack(sparse).persist()
    assert pk.is_packed(packed) and st.dims(packed) == a.shape
    b = np.random.default_rng(1).standard_normal((a.shape[1], 4))
    for mat in (sparse, packed):
        assert np.allclose(pr.cov_multiply(mat, b, len(a)), a.T @ (a @ b) / len(a))
        assert np.allclose(pr.gram(mat, a.shape[1]), a.T @ a)
        assert np.allclose(np.abs(pr.tsqr_r(mat, 4, rhs=b)), np.abs(np.linalg.qr(a @ b, mode="r")))
        got = {r["row_id"]: r["vector"] for r in pr.right_multiply(mat, b).collect()}
        assert np.allclose([got[i] for i in range(len(a))], a @ b)
        for work in (1e-9, 1e9):  # entry by entry, and as slabs
            monkeypatch.setattr(pr, "SLAB_WORK", work)
            g = {(r["i"], r["j"]): r["value"] for r in pr.gram_long(mat, a.shape[1], panel=8).collect()}
            assert len(g) == a.shape[1] ** 2
            assert np.allclose([[g[i, j] for j in range(a.shape[1])] for i in range(a.shape[1])], a.T @ a)
    packed.unpersist()


def test_eofs_of_sparse_rows(spark):
    dense, sparse = _both(spark, _field(0.1))
    want, _ = fz.run_eofs(pp.preprocess(dense, pp.CENTER).mat, 3)
    got, cached = fz.run_eofs(pp.preprocess(sparse, pp.CENTER).mat, 3)
    assert pk.is_packed(cached) and got.converged
    assert np.allclose(got.s, want.s) and np.allclose(got.v, want.v, atol=1e-6)
    u = [np.array([r["vector"] for r in x.u.orderBy("row_id").collect()]) for x in (got, want)]
    assert np.allclose(*u, atol=1e-6)


def test_packed_rows_hold_entries_only(spark):
    a = np.zeros((200, 300))
    a[np.arange(200), np.arange(200)] = 1.0
    packed = pk.pack(rs.pivot_rows(spark.createDataFrame([(i, i, 1.0) for i in range(200)], "row_id bigint, record_id int, value double"),
                                   spark.range(300).select(F.col("id").cast("int").alias("col_pos"), F.col("id").cast("int").alias("record_id")), on_missing="zero", sparse=True))
    assert packed.agg(F.sum(F.length("val"))).first()[0] == 200 * 8
    assert np.allclose(pr.cov_multiply(packed, np.eye(300), 1), a.T @ a)


def test_a_block_ends_at_its_entries_and_its_rows(spark, monkeypatch):
    monkeypatch.setattr(pk, "BLOCK_ENTRIES", 16)
    a = _field(0.3, (60, 9))
    parts = [[np.full(60, 9), np.arange(60), np.zeros(60), (a != 0).sum(axis=1), np.nonzero(a)[1], a[a != 0]]]
    got = [b for batch in pk._packed(parts) for b in pk.blocks(batch, 9)]
    assert len(got) > 5 and all(len(b.pos) <= 16 and b.n <= 16 for b in got)
    assert np.array_equal(np.concatenate([x for b in got for x in b.slabs()]), a)


def test_errors_of_sparse_rows(spark):
    with pytest.raises(ValueError, match="zero"):
        rs.pivot_rows(_triplets(spark, _field(0.5)), on_missing="null", sparse=True)
    twice = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0)], "row_id bigint, record_id int, value double")
    with pytest.raises(Exception, match="duplicate cell"):
        rs.pivot_rows(twice, on_missing="zero", sparse=True, pre_aggregate=False).collect()
    null = spark.createDataFrame([(0, None)], "row_id bigint, vector struct<size: int, fill: double, pos: array<int>, val: array<double>>")
    with pytest.raises(Exception, match="NULL row vector"):
        pr.cov_multiply(null, np.eye(2), 1)


def test_plain_rounds_go_on_from_saved_blocks(spark, monkeypatch):
    from fieldmodes.operators import gapfill as gf
    a = np.outer(np.arange(1.0, 41), np.sqrt(np.arange(1.0, 8))) + 1
    x = [(i, [None if (i + j) % 7 == 3 else float(a[i, j]) for j in range(7)]) for i in range(40)]
    df = spark.createDataFrame(x, "row_id bigint, vector array<double>").repartition(20)
    monkeypatch.setattr(gf, "BLOCK_BYTES", 8 * 7 * 3)
    got = []
    for every in (100, 3):
        monkeypatch.setattr(gf, "SAVE_EVERY", every)
        out, info = gf.dineof_fill(df, 1, 7, max_iter=60, tol=1e-7)
        rows = out.orderBy("row_id").collect()
        assert info["converged"] and info["n_missing"] == 40 and [[c for c in r["filled"]] for r in rows] == [[c is None for c in r] for _, r in x]
        got.append((info["iterations"], [r["vector"] for r in rows]))
    assert got[0][0] == got[1][0] and np.allclose(got[0][1], got[1][1], atol=1e-9) and np.allclose(got[0][1], a, atol=1e-4)


def test_a_round_of_gap_filling_runs_few_jobs_of_few_tasks(spark):
    from fieldmodes.operators import gapfill as gf
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [None if rng.random() < 0.1 else float(i * j % 5 + rng.random()) for j in range(6)]) for i in range(200)],
                               "row_id bigint, vector array<double>").repartition(30)
    tracker = spark.sparkContext.statusTracker()

    def jobs(rounds):
        group = f"rounds-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        with pytest.warns(UserWarning, match="not converged"):
            gf.dineof_fill(df, 1, 6, max_iter=rounds, tol=0.0, accelerate=True, product="gram")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))
    assert jobs(7) - jobs(3) == 4  # a job a round


def test_a_small_matrix_is_kept_in_few_partitions(spark, mk):
    a = np.random.default_rng(0).standard_normal((300, 6))
    kept, n, m = st.materialize_dims(mk(a, 40))
    assert (n, m) == a.shape and kept.rdd.getNumPartitions() == 1 and kept.is_cached
    kept.unpersist()


def test_a_plain_round_of_gap_filling_is_one_pass(spark):
    from fieldmodes.operators import gapfill as gf
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [None if rng.random() < 0.1 else float(i * j % 5 + rng.random()) for j in range(7)]) for i in range(200)],
                               "row_id bigint, vector array<double>").repartition(30)
    tracker = spark.sparkContext.statusTracker()

    def jobs(rounds):
        group = f"plain-rounds-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        with pytest.warns(UserWarning, match="not converged"):
            gf.dineof_fill(df, 1, 7, max_iter=rounds, tol=0.0)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))
    assert jobs(7) - jobs(3) == 4  # a job a round: the change and the next product


def test_a_field_of_two_blocks_takes_one_product():
    rng = np.random.default_rng(1)
    for m, k, few in ((7, 1, True), (12, 1, True), (13, 1, False), (40, 3, False)):
        c = np.cov(rng.standard_normal((m, 3 * m)))
        v0 = np.linalg.qr(rng.standard_normal((m, k)))[0]
        y = fz.start_block(m, k, 0, v0)
        assert y.shape[1] == (m if few else k + fz.OVERSAMPLE) and np.allclose(y.T @ y, np.eye(y.shape[1])) and np.allclose(y @ (y.T @ v0), v0)
        v, lam, products, _, ok = fz.krylov_eigs(lambda b: c @ b, m, k, 1e-9, 100, 0, v0)
        want = np.linalg.eigvalsh(c)[::-1][:k]
        assert ok and np.allclose(lam, want) and np.allclose(c @ v, v * lam, atol=1e-6) and (products == 1) == few


def test_blocks_are_dealt_evenly(spark, mk, monkeypatch):
    from fieldmodes.operators import gapfill as gf
    a = np.random.default_rng(3).standard_normal((600, 5))
    a[::7, 2] = np.nan
    monkeypatch.setattr(gf, "BLOCK_BYTES", 40 * 10)
    for parts, task_bytes, want in ((1, 40 * 100, 6), (40, 40 * 100, 6), (40, 1 << 20, 1), (1, 1 << 20, 1)):
        monkeypatch.setattr(gf, "TASK_BYTES", task_bytes)
        kept, tasks, n, missing = gf._keep(gf._pack(mk(a, parts), 5))
        rows = kept.withColumn("p", F.spark_partition_id()).collect()
        assert tasks == kept.rdd.getNumPartitions() == want and n == 600 and missing == np.isnan(a).sum()
        held = [sum(r["n"] for r in rows if r["p"] == p) for p in range(want)]
        assert sum(held) == 600 and max(held) <= 2 * 600 / want
        back = set()
        for r in rows:
            ids, x, gap = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"]).reshape(-1, 5), np.frombuffer(r["gap"], np.bool_).reshape(-1, 5)
            assert len(ids) == r["n"] and len(r["x"]) <= 40 * 10 and np.array_equal(gap, np.isnan(a[ids])) and np.allclose(x[~gap], a[ids][~gap])
            back.update(ids.tolist())
        assert len(back) == 600
        kept.unpersist()
