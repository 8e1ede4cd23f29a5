import math

import pytest

from fieldmodes.operators import preprocess as pp
from fieldmodes.operators import stats as st
from tests.conftest import to_np


def test_constant_row_and_one_column(spark, mk):
    s = {r.row_id: r for r in st.row_mean_std(mk([[5, 5, 5]])).collect()}
    assert s[0].mean == 5 and s[0].std == 0 and s[0].low_std and s[0].std_used == 1.0
    z = pp.standardize_rows(mk([[5, 5, 5]])).first()
    assert z.vector == [0.0, 0.0, 0.0]
    one = st.row_mean_std(mk([[7]])).first()
    assert one.std == 0 and one.std_used == 1.0


def test_sample_std(spark, mk):
    r = st.row_mean_std(mk([[1, 2, 3, 4]])).first()
    assert r.mean == 2.5 and math.isclose(r.std, 1.2909944487358056, rel_tol=1e-14)


def test_low_std_report(spark, mk):
    rows = st.low_std_rows(mk([[1, 1, 1], [1, 2, 3], [4, 4.00001, 4]])).collect()
    assert sorted(r.row_id for r in rows) == [0, 2]


def test_center_weight_missing_weight_zero(spark, mk):
    m = mk([[1, 2, 3], [2, 4, 6]])
    w = spark.createDataFrame([(0, 0.5)], "row_id bigint, weight double")
    p = pp.preprocess(m, "cosLat+centerOverAllObservations", w)
    rows = {r.row_id: r for r in p.rows.collect()}
    assert rows[0].vector == [-0.5, 0.0, 0.5] and rows[0].mean == 1.0
    assert rows[1].vector == [0.0, 0.0, 0.0] and rows[1].mean == 0.0


def test_preprocess_dispatch(spark, mk):
    m = mk([[1, 2, 3]])
    assert pp.preprocess(m, "centerOverAllObservations").rows.first().vector == [-1.0, 0.0, 1.0]
    assert pp.preprocess(m, "standardize").rows.first().vector == [-1.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        pp.preprocess(m, "x")


def test_dims_and_frobenius(spark, mk):
    m = mk([[1, 2], [3, 4], [0, 1]])
    assert st.dims(m) == (3, 2)
    assert st.frobenius2(m).first()[0] == 31.0
    assert {r.col_pos: r.mean for r in st.col_means(m).collect()} == {0: 4 / 3, 1: 7 / 3}
    assert to_np(m).shape == (3, 2)


def test_wide_rows_are_linear_time(spark):
    """Row scalars (mean, std) must be evaluated once per row, not once per
    element: with 50,000 columns a per-element re-evaluation is ~2.5e9
    operations per row."""
    import time

    from pyspark.sql import functions as F
    m = spark.range(8).select(F.col("id").alias("row_id"),
                              F.transform(F.sequence(F.lit(0), F.lit(49_999)),
                                          lambda i: (i % 97).cast("double")).alias("vector"))
    t0 = time.perf_counter()
    for method in ("center", "standardize"):
        r = pp.preprocess(m, method).mat.select(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).collect()
        assert len(r) == 8
    st.row_mean_std(m).collect()
    assert time.perf_counter() - t0 < 60
