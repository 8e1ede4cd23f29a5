"""Plan properties: pruning and shuffle counts of the key operators."""

import re

from fieldmodes.operators import products as pr
from fieldmodes.operators import reshape as rs
from fieldmodes.plans import catalog as cat
from fieldmodes.plans import fixtures as fx
from fieldmodes.session import scratch_path
from fieldmodes.sources import readers as rd
from fieldmodes.sources import writers as wr

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    p = _plan(fx.triplets_part_year(spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == ["l_extendedprice", "l_partkey", "l_shipdate"]


def test_block_selection_prunes_partitions(spark):
    p = scratch_path(spark, "plan_trip")
    wr.write_triplets(fx.triplets_supplier_year(spark, SF), p, block_size=4)
    assert "PartitionFilters: [isnotnull(record_block" in _plan(rd.read_triplets(spark, p, blocks=[499]))


def test_pivot_shuffles_once_after_the_triplet_aggregate(spark):
    mat, _, _ = fx.matrix(spark, SF, "part_year", "null")
    p = _plan(mat)
    assert p.count("Exchange hashpartitioning") == 2  # triplet groupBy + row groupBy
    assert "BroadcastExchange" in p  # the measured column order


def test_hconcat_adds_no_exchange_over_its_pieces(spark):
    pieces = cat._hconcat_pieces(spark, SF)
    per_piece = sum(_plan(m).count("Exchange hashpartitioning") for m in pieces)
    assert _plan(rs.hconcat(pieces)).count("Exchange hashpartitioning") == per_piece


def test_gram_of_all_panels_scans_once(spark):
    p = scratch_path(spark, "plan_gram")
    spark.range(50).selectExpr("id AS row_id", "transform(sequence(1, 9), x -> cast(x * id AS double)) AS vector").write.parquet(p)
    plan = _plan(pr.gram_long(rd.read_row_matrix(spark, p), 9, panel=2))
    assert plan.count("FileScan parquet") == 1


def test_transpose_shuffles_tiles_not_cells(spark):
    p = scratch_path(spark, "plan_transpose")
    spark.range(50).selectExpr("id AS row_id", "transform(sequence(1, 9), x -> cast(x * id AS double)) AS vector").write.parquet(p)
    plan = _plan(rs.transpose(rd.read_row_matrix(spark, p), block_size=16))
    assert "Generate" not in plan and "MapInArrow" in plan
