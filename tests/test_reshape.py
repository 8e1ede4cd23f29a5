import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmodes.operators import reshape as rs


def _trip(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, record_id int, value double")


def test_pivot_aligns_on_column_order(spark):
    t = _trip(spark, [(0, 5, 1.0), (0, 0, 2.0), (0, 2, 3.0), (1, 2, 6.0), (1, 0, 4.0), (1, 5, 5.0)])
    co = rs.column_order(t)
    assert [tuple(r) for r in co.orderBy("col_pos").collect()] == [(0, 0), (1, 2), (2, 5)]  # gap in record numbers
    m = {r.row_id: r.vector for r in rs.pivot_rows(t, co).collect()}
    assert m == {0: [2.0, 3.0, 1.0], 1: [4.0, 6.0, 5.0]}


def test_missing_cell_policies(spark):
    t = _trip(spark, [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (2, 1, 9.0), (2, 0, 8.0)])
    with pytest.raises(Exception, match="missing cell"):
        rs.pivot_rows(t).collect()
    nul = {r.row_id: r.vector for r in rs.pivot_rows(t, on_missing="null").collect()}
    assert nul[1] == [3.0, None] and nul[0] == [1.0, 2.0]
    drop = {r.row_id for r in rs.pivot_rows(t, on_missing="drop_row").collect()}
    assert drop == {0, 2}


def test_duplicate_cell_policies(spark):
    t = _trip(spark, [(0, 0, 1.0), (0, 0, 3.0), (0, 1, 2.0)])
    with pytest.raises(Exception, match="duplicate cell"):
        rs.pivot_rows(t).collect()
    assert rs.pivot_rows(t, on_duplicate="avg").first().vector == [2.0, 2.0]
    with pytest.raises(ValueError):
        rs.pivot_rows(t, on_duplicate="first")


def test_hconcat_inner_drops_row_missing_in_a_piece(spark, mk):
    a = mk([[1, 2], [3, 4], [5, 6]])
    b = mk([[7], [8]], ids=[0, 2])
    out = {r.row_id: r.vector for r in rs.hconcat([a, b]).collect()}
    assert out == {0: [1.0, 2.0, 7.0], 2: [5.0, 6.0, 8.0]}
    rep = rs.hconcat_dropped([a, b]).first()
    assert (rep.rows_seen, rep.rows_dropped) == (3, 1)


def test_unpivot_and_transpose(spark, mk):
    a = mk([[1, 2, 3], [4, 5, 6]], ids=[10, 20])
    long = {(r.row_id, r.col_pos): r.value for r in rs.unpivot_rows(a).collect()}
    assert long[(20, 1)] == 5.0 and len(long) == 6
    t = {r.row_id: r.vector for r in rs.transpose(a).collect()}
    assert t == {0: [1.0, 4.0], 1: [2.0, 5.0], 2: [3.0, 6.0]}
    blocks = {(r.row_id, r.block): r.vector for r in rs.transpose(a, block_size=1).collect()}
    assert blocks[(2, 0)] == [3.0] and blocks[(2, 1)] == [6.0]
    back = {(r.row_id, r.col_pos): r.value for r in rs.unpivot_blocks(rs.transpose(a, block_size=1), 1).collect()}
    assert back[(1, 1)] == 5.0 and len(back) == 6


def test_dense_index_splits_equal_keys(spark):
    df = spark.range(0, 3000).selectExpr("id DIV 1000 AS k", "id")
    idx = rs.dense_index(df, ["k"], "i", num_partitions=6)
    assert sorted(r.i for r in idx.collect()) == list(range(3000))
    per = idx.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in per) < 3000


def test_dense_index_is_consecutive(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k").repartition(5)
    idx = rs.dense_index(df, ["k"], "i", num_partitions=4).orderBy("k").collect()
    assert [r.i for r in idx] == list(range(len(idx)))
    assert [r.k for r in idx] == list(range(0, 1000, 7))


def test_single_shuffle_pivot_still_catches_duplicates(spark):
    t = _trip(spark, [(0, 0, 1.0), (0, 0, 3.0), (0, 1, 2.0), (1, 0, 1.0), (1, 1, 1.0)])
    with pytest.raises(Exception, match="duplicate cell"):
        rs.pivot_rows(t, pre_aggregate=False).collect()
    with pytest.raises(Exception, match="duplicate cell"):
        rs.pivot_rows(t, pre_aggregate=False, on_missing="drop_row").collect()
    ok = _trip(spark, [(0, 0, 1.0), (0, 1, 2.0)])
    assert rs.pivot_rows(ok, pre_aggregate=False).first().vector == [1.0, 2.0]


def test_hot_duplicated_cell_is_collapsed_before_the_shuffle(spark):
    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("row_id"), F.lit(1).alias("record_id"),
                                      F.lit(0.5).alias("value"))
    rest = _trip(spark, [(7, 2, 1.0), (8, 1, 2.0), (8, 2, 3.0)])
    t = hot.unionByName(rest).repartition(4)
    m = rs.pivot_rows(t, on_duplicate="sum")
    assert {r.row_id: r.vector for r in m.collect()} == {7: [50_000.0, 1.0], 8: [2.0, 3.0]}
    plan = m._jdf.queryExecution().executedPlan().toString()
    # a partial (map-side) sum on (row_id, col_pos) runs before the first exchange
    assert "partial_sum(" in plan
    assert plan.index("partial_sum(") > plan.index("Exchange hashpartitioning")  # printed below it


def test_null_row_id_fails_loudly(spark):
    t = _trip(spark, [(None, 0, 1.0), (1, 0, 2.0)])
    with pytest.raises(Exception, match="NULL row id"):
        rs.pivot_rows(t).collect()


def test_small_table_fallback_keeps_large_tables_distributed(spark, monkeypatch):
    df = spark.range(50).select(F.col("id").cast("int").alias("col_pos"), F.col("id").cast("int").alias("record_id"))
    local, n = rs.small_table(df, max_rows=100)
    # measured once: the small copy no longer carries the upstream plan
    assert n == 50 and "Range" not in local._jdf.queryExecution().optimizedPlan().toString()
    big, n2 = rs.small_table(df, max_rows=10)
    assert n2 == 50 and "Range" in big._jdf.queryExecution().optimizedPlan().toString()
    t = _trip(spark, [(r, c, float(r + c)) for r in range(3) for c in range(50)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # isolate our own hint
    try:
        small = rs.pivot_rows(t, local, n_cols=n)
        assert "BroadcastExchange" in small._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(rs, "BROADCAST_MAX_ROWS", 10)
        m = rs.pivot_rows(t, big, n_cols=n2)
        assert "BroadcastExchange" not in m._jdf.queryExecution().executedPlan().toString()
        assert {r.row_id: r.vector[7] for r in m.collect()} == {0: 7.0, 1: 8.0, 2: 9.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("block_size, tile_bytes", [(4, 32 << 20), (4, 3 * 8 * 4), (3, 8), (1000, 32 << 20)])
def test_transpose_tiles(spark, mk, monkeypatch, block_size, tile_bytes):
    monkeypatch.setattr(rs, "TILE_BYTES", tile_bytes)
    a = np.random.default_rng(1).normal(size=(11, 7))
    ids = [3 * i - 5 for i in np.random.default_rng(2).permutation(11)]
    got = rs.transpose(mk(a, parts=3, ids=ids), block_size)
    whole = np.full((7, 11), np.nan)
    for r in got.collect():
        whole[r.row_id, r.block * block_size : r.block * block_size + len(r.vector)] = r.vector
    assert np.array_equal(whole, a[np.argsort(ids)].T)


def test_transpose_keeps_nulls_and_rejects_bad_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "row_id bigint, vector array<double>")
    got = {r.row_id: r.vector for r in rs.transpose(make([(1, [1.0, None]), (2, [None, 4.0])])).collect()}
    assert got == {0: [1.0, None], 1: [None, 4.0]}
    assert rs.transpose(make([])).count() == 0
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0]), (2, None)], [(1, [1.0]), (1, [2.0])]):
        with pytest.raises(Exception, match="one length|repeated"):
            rs.transpose(make(bad)).collect()
