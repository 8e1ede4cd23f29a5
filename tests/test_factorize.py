import numpy as np
import pytest

from fieldmodes.operators import evaluate as ev
from fieldmodes.operators import factorize as fz
from fieldmodes.operators import preprocess as pp
from fieldmodes.operators import products as pr
from tests.conftest import to_np


def _lowrank(n=60, m=8, seed=3):
    rng = np.random.default_rng(seed)
    u, _ = np.linalg.qr(rng.standard_normal((n, m)))
    v, _ = np.linalg.qr(rng.standard_normal((m, m)))
    s = np.array([20, 10, 5, 1, 0.5, 0.2, 0.1, 0.05])[:m]
    return (u * s) @ v.T


def test_known_svd_and_sse(spark, mk):
    a = np.zeros((5, 4))
    a[0, 0], a[1, 1], a[2, 2] = 3, 2, 1
    m = mk(a, parts=3)
    r1 = fz.eof_exact(m, 1)
    assert np.allclose(r1.s, [3])
    assert ev.sse(m, r1.u, r1.s, r1.v).first()[0] == pytest.approx(5.0)
    r2 = fz.eof_exact(m, 2)
    assert np.allclose(r2.s, [3, 2])
    assert ev.sse(m, r2.u, r2.s, r2.v).first()[0] == pytest.approx(1.0)
    assert ev.sse_projection(m, r2.v).first()[0] == pytest.approx(1.0)


def test_k_must_be_below_columns(spark, mk):
    with pytest.raises(ValueError):
        fz.eof_exact(mk(np.ones((5, 3))), 3)


def test_rank_below_k(spark, mk):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((5, 2)) @ rng.standard_normal((2, 4))
    r = fz.eof_exact(mk(a), 3)
    assert r.n_computed == 2


def test_sign_rule(spark, mk):
    a = _lowrank()
    r1, r2 = fz.eof_exact(mk(a), 3), fz.eof_exact(mk(-a), 3)
    assert np.allclose(r1.v, r2.v)
    assert np.allclose(to_np(r1.u), -to_np(r2.u))
    assert np.all(np.abs(r1.v).argmax(axis=0) == np.argmax(r1.v, axis=0))


def test_invariants_exact_vs_numpy(spark, mk):
    a = _lowrank()
    m = mk(a, parts=4)
    r = fz.eof_exact(m, 4)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(r.s, s[:4], rtol=1e-10)
    u = to_np(r.u)
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-10)
    assert np.allclose(r.v.T @ r.v, np.eye(4), atol=1e-10)
    assert np.all(np.diff(r.s) <= 0)
    full = fz.eof_exact(m, 7)
    assert np.isclose(np.sum(full.s ** 2), np.sum(a ** 2) - s[7] ** 2)
    assert np.allclose(r.eigenvalues, s[:4] ** 2 / a.shape[0])


def test_centered_v_columns_sum_to_zero(spark, mk):
    a = _lowrank() + 7.0
    p = pp.preprocess(mk(a), "center")
    r = fz.eof_exact(p.mat, 3)
    assert np.allclose(r.v.sum(axis=0), 0, atol=1e-10)


def test_randomized_matches_exact_with_gap(spark, mk):
    a = _lowrank()
    m = mk(a, parts=3)
    e, q = fz.eof_exact(m, 3), fz.eof_randomized(m, 3, seed=7, product="distributed")
    g = fz.eof_randomized(m, 3, seed=7, product="gram")
    assert q.info["product"] == "distributed" and g.info["product"] == "gram"
    assert np.allclose(g.s, q.s, rtol=1e-12) and np.allclose(g.v, q.v, atol=1e-10)
    assert np.allclose(e.s, q.s, rtol=1e-8)
    assert np.allclose(e.v, q.v, atol=1e-6)
    d = ev.compare_factors(e, q)
    assert d["v_frobenius_diff"] < 1e-5 and d["u_frobenius_diff"] < 1e-5


def test_mllib_wide_path_matches_gram(spark, mk):
    a = _lowrank(n=40, m=8)
    m = mk(a)
    g, w = fz.eof_exact(m, 3), fz.eof_exact(m, 3, solver="mllib")
    assert np.allclose(g.s, w.s, rtol=1e-8) and np.allclose(g.v, w.v, atol=1e-6)


def test_empty_partitions_same_result(spark, mk):
    a = np.array([[1.0, 2, 3], [4, 5, 7], [2, 1, 0]])
    r8, r1 = fz.eof_exact(mk(a, parts=8), 2), fz.eof_exact(mk(a, parts=1), 2)
    assert np.allclose(r8.s, r1.s) and np.allclose(r8.v, r1.v)


def test_products_vs_numpy(spark, mk):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 6))
    m = mk(a, parts=4)
    rhs = rng.standard_normal((6, 3))
    assert np.allclose(pr.gram(m, 6), a.T @ a)
    assert np.allclose(pr.cov_multiply(m, rhs), a.T @ (a @ rhs) / 30)
    assert np.allclose(to_np(pr.right_multiply(m, rhs)), a @ rhs)
    from pyspark.sql import functions as F
    lhs = m.select("row_id", F.array(F.lit(1.0), F.col("row_id").cast("double")).alias("coef"))
    b = np.vstack([np.ones(30), np.arange(30)])
    assert np.allclose(pr.left_multiply(lhs, m, 6, 2), b @ a)
    r = pr.tsqr_r(m, 6, fanout=2)
    ref = np.linalg.qr(a, mode="r")
    assert np.allclose(r, ref * np.sign(np.diag(ref))[:, None])
    q = to_np(pr.apply_right_inverse(m, r))
    assert np.allclose(q.T @ q, np.eye(6))


def test_misaligned_rows_fail_loudly(spark, mk):
    m = spark.createDataFrame([(0, [1.0, None]), (1, [2.0, 3.0])], "row_id bigint, vector array<double>")
    with pytest.raises(Exception, match="NULL cell"):
        pr.gram(m, 2)


def test_to_eofs_and_project_spatial(spark, mk):
    a = _lowrank()
    m = mk(a)
    r = fz.eof_exact(m, 3)
    u = fz.project_spatial(m, r.v, r.s)
    assert np.allclose(to_np(u), to_np(r.u))
    fat = np.diag(r.s) @ r.v.T
    t = fz.to_eofs(r.u, fat)
    assert np.allclose(t.s, r.s) and np.allclose(np.abs(t.v), np.abs(r.v))


def test_method_dispatch(spark, mk):
    m = mk(_lowrank())
    both = fz.compute_eofs(m, 2, "both", seed=1)
    assert set(both) == {"exact", "inexact"}
    with pytest.raises(ValueError):
        fz.compute_eofs(m, 2, "other")


def test_dineof_fills_low_rank_gaps(spark):
    from fieldmodes.operators.gapfill import dineof_fill
    rng = np.random.default_rng(5)
    a = rng.standard_normal((40, 2)) @ rng.standard_normal((2, 6)) + 3.0
    holes = {(3, 1), (10, 4), (22, 0), (31, 5)}
    rows = [(i, [None if (i, j) in holes else float(a[i, j]) for j in range(6)]) for i in range(40)]
    m = spark.createDataFrame(rows, "row_id bigint, vector array<double>")
    out, info = dineof_fill(m, 2, 6, max_iter=200, tol=1e-10)
    f = {r.row_id: r for r in out.collect()}
    for i, j in holes:
        assert f[i].filled[j]
        assert abs(f[i].vector[j] - a[i, j]) < 1e-3
    assert info["n_missing"] == 4


def test_gram_coalesces_tasks_with_few_rows(spark, mk):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((40, 5))
    m = mk(a, parts=8)  # 5 rows per task < 4m = 20
    assert np.allclose(pr.gram(m, 5, n_rows=40), a.T @ a)
    assert np.allclose(pr.gram(m, 5), a.T @ a)


def test_empty_input(spark):
    from fieldmodes.operators import reshape as rs
    from fieldmodes.operators import stats as st
    t = spark.createDataFrame([], "row_id bigint, record_id int, value double")
    m = rs.pivot_rows(t)
    assert m.count() == 0 and st.dims(m) == (0, 0)
    with pytest.raises(ValueError):
        fz.eof_exact(m, 1)
    with pytest.raises(ValueError):
        fz.eof_randomized(m, 1)


def test_compare_projected_is_one_scan_and_equals_the_join(spark, mk):
    m = mk(np.random.default_rng(4).normal(size=(40, 6)), parts=3)
    a, b = fz.eof_exact(m, 2), fz.eof_exact(m, 3)
    b = type(b)(**{**b.__dict__, "v": b.v * np.array([1.0, -1.0, 1.0]), "u": fz.project_spatial(m, b.v * np.array([1.0, -1.0, 1.0]), b.s)})
    one, joined = ev.compare_projected(m, a, b), ev.compare_factors(a, b)
    assert all(abs(one[x] - joined[x]) < 1e-9 for x in joined)
    assert joined["u_frobenius_diff"] == pytest.approx(2) and joined["u_frobenius_diff_aligned"] < 1e-6
    assert one["sse_a"] == pytest.approx(ev.sse(m, a.u, a.s, a.v).first()[0])
    assert one["sse_b"] == pytest.approx(ev.sse_projection(m, b.v[:, :2]).first()[0])
