"""Rows-only queries (no SQL oracle) checked against NumPy brute force on sf0.001."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
Q = E.queries()


def _dense(sql):
    rows = duckdb.sql(sql).fetchall()
    ids = sorted({r[0] for r in rows})
    cols = sorted({r[1] for r in rows})
    a = np.full((len(ids), len(cols)), np.nan)
    ix, jx = {v: i for i, v in enumerate(ids)}, {v: j for j, v in enumerate(cols)}
    for r, c, v in rows:
        a[ix[r], jx[c]] = v
    return a, ids, cols


SUPPLIER_YEAR = (f"SELECT l_suppkey, year(l_shipdate), sum(l_extendedprice) / 1e6 "
                 f"FROM '{SF}/lineitem.parquet' GROUP BY 1, 2")


def _emb():
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    return np.array([r[1] for r in rows], dtype=np.float64)


def test_eof_exact_supplier_year(spark):
    a, _, years = _dense(SUPPLIER_YEAR)
    c = a - a.mean(axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    out = Q["eof_exact_supplier_year"](spark, SF).collect()
    sig = {r.component: r.sigma for r in out}
    assert np.allclose([sig[i] for i in range(3)], s[:3], atol=2e-6)
    for r in out:
        v = vt[r.component]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        assert abs(r.v - v[r.col_pos]) < 2e-6 and r.record_id == years[r.col_pos]


def test_eof_embeddings_exact_and_randomized(spark):
    x = _emb()
    s = np.linalg.svd(x - x.mean(axis=1, keepdims=True), compute_uv=False)
    ex = sorted(Q["eof_mllib_embeddings"](spark, SF).collect())
    assert np.allclose([r.sigma for r in ex], s[:5], atol=2e-6)
    rn = sorted(Q["eof_randomized_embeddings"](spark, SF).collect())
    got = np.array([r.sigma for r in rn])
    assert np.all(got <= s[:5] + 1e-6) and np.all(got >= 0.9 * s[:5])  # Ritz values: lower bounds


def test_eof_coslat_u_orthonormal(spark):
    u = Q["eof_coslat_supplier_year"](spark, SF).collect()
    ids = sorted({r.row_id for r in u})
    m = np.zeros((len(ids), 2))
    ix = {v: i for i, v in enumerate(ids)}
    for r in u:
        m[ix[r.row_id], r.component] = r.value
    assert np.allclose(m.T @ m, np.eye(2), atol=1e-4)


def test_compare_factors_small_on_gapped_spectrum(spark):
    d = Q["compare_factors"](spark, SF).first()
    assert d.k == 3 and d.s_l2_diff < 1e-6 and d.subspace_cosines_min > 0.999


def test_dineof_keeps_present_cells(spark):
    a, ids, days = _dense(f"SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)), sum(value) "
                          f"FROM '{SF}/events.parquet' GROUP BY 1, 2")
    out = Q["dineof_fill"](spark, SF).collect()
    ix = {v: i for i, v in enumerate(ids)}
    assert len(out) == a.size
    for r in out:
        orig = a[ix[r.row_id], r.col_pos]
        assert r.filled == bool(np.isnan(orig))
        if not r.filled:
            assert r.value == pytest.approx(orig, abs=1e-8)
        assert r.converged
    want = _plain_filling(a, 1)  # one EOF fills cells set aside best
    assert np.allclose([r.value for r in sorted(out, key=lambda r: (r.row_id, r.col_pos))], want.ravel(), atol=1e-4)


def _plain_filling(a, k, rounds=5000, tol=1e-9):
    """The rounds of the method as published, to the end."""
    gap = np.isnan(a)
    cur = np.where(gap, np.nanmean(a, axis=1, keepdims=True), a)
    for _ in range(rounds):
        mu = cur.mean(axis=1, keepdims=True)
        v = np.linalg.svd(cur - mu, full_matrices=False)[2][:k].T
        new = np.where(gap, (cur - mu) @ v @ v.T + mu, a)
        if np.sqrt(((new - cur)[gap] ** 2).mean()) < tol:
            return new
        cur = new
    raise AssertionError("no fixed point")


def test_accelerated_filling_has_the_fixed_point_of_the_plain_rounds(spark):
    from fieldmodes.operators import gapfill as gf
    rng = np.random.default_rng(11)
    a = rng.standard_normal((60, 2)) @ rng.standard_normal((2, 12)) * 3 + 0.3 * rng.standard_normal((60, 12))
    a[rng.random(a.shape) < 0.15] = np.nan
    a[7] = np.nan  # a row without any value
    a[8, 1:] = np.nan
    df = spark.createDataFrame([(i, [None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(a)], "row_id bigint, vector array<double>")
    ok = ~np.isnan(a).all(axis=1)
    want = _plain_filling(np.where(ok[:, None], a, 0.0), 2)
    rounds = {}
    for product in ("gram", "distributed"):
        out, info = gf.dineof_fill(df, 2, 12, max_iter=40, tol=1e-9, accelerate=True, product=product)
        got = np.array([r.vector for r in out.orderBy("row_id").collect()])
        assert info["converged"] and np.allclose(got, want, atol=1e-5)
        rounds[product] = info["iterations"]
    assert max(rounds.values()) <= 30
    k, tried = gf.dineof_select(df, 5, 12, share=0.05, max_iter=40, accelerate=True, product="gram")
    assert k == 2 and [t["k"] for t in tried][:3] == [1, 2, 3]


def test_wide_supplier_day_exact_and_randomized(spark):
    a, _, _ = _dense(f"SELECT l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)), "
                     f"sum(l_extendedprice) / 1e6 FROM '{SF}/lineitem.parquet' GROUP BY 1, 2")
    a = np.nan_to_num(a)  # no shipments that day: zero revenue
    s = np.linalg.svd(a - a.mean(axis=1, keepdims=True), compute_uv=False)
    ex = sorted(Q["eof_exact_supplier_day"](spark, SF).collect())
    assert a.shape[1] > 2048 and np.allclose([r.sigma for r in ex], s[:3], atol=2e-6)
    rn = Q["eof_randomized_supplier_day"](spark, SF).collect()
    sig = {r.component: r.sigma for r in rn}
    assert np.allclose([sig[i] for i in range(3)], s[:3], rtol=1e-3)
