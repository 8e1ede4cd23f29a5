import pytest
from pyspark.sql import functions as F

from fieldmodes.session import scratch_path
from fieldmodes.sources import readers as rd
from fieldmodes.sources import writers as wr
from fieldmodes.streaming.ingest import ingest_triplet_stream, read_ingested


def test_malformed_lines_go_to_rejects(spark):
    p = scratch_path(spark, "bad")
    spark.createDataFrame([("0,1,2.5",), ("0,1,bad",), ("1,0",), ("2,3,4",)], "value string").write.text(p)
    good, bad = rd.read_triplets(spark, p, with_rejects=True)
    assert sorted(tuple(r) for r in good.collect()) == [(0, 1, 2.5), (2, 3, 4.0)]
    assert sorted(r.line for r in bad.collect()) == ["0,1,bad", "1,0"]


def test_triplet_blocks_prune(spark):
    t = spark.createDataFrame([(r, 0, float(r)) for r in (1, 5, 12, 25)], "record_id int, row_id bigint, value double")
    p = scratch_path(spark, "trip")
    wr.write_triplets(t, p, block_size=10)
    sel = rd.read_triplets(spark, p, blocks=[1])
    assert sorted(r.record_id for r in sel.collect()) == [12]
    assert "PartitionFilters: [isnotnull(record_block" in sel._jdf.queryExecution().executedPlan().toString() \
        or "record_block" in sel._jdf.queryExecution().executedPlan().toString()


def test_coordinate_text_roundtrip(spark):
    long = spark.createDataFrame([(0, 0, 1.5), (0, 1, -2.0), (1, 0, 1e-300), (1, 1, 0.1)], "i long, j long, value double")
    p = scratch_path(spark, "coord")
    wr.write_coordinate_text(long, p, 2, 2)
    back = sorted(tuple(r) for r in rd.read_coordinate_text(spark, p).collect())
    assert back == sorted(tuple(r) for r in long.collect())


def test_output_guard(spark):
    p = scratch_path(spark, "guard")
    a = spark.createDataFrame([(1, 0, 1.0)], "record_id int, row_id bigint, value double")
    b = spark.createDataFrame([(2, 0, 2.0)], "record_id int, row_id bigint, value double")
    wr.write_triplets(a, p)
    wr.write_triplets(b, p, mode="ignore")
    assert [r.record_id for r in rd.read_triplets(spark, p).collect()] == [1]


def test_stream_ingest_is_resumable(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    t = spark.createDataFrame([(r, 0, float(r)) for r in range(6)], "record_id int, row_id bigint, value double")
    wr.write_triplets(t.where("record_id < 3"), src, block_size=1, compression="none")
    ingest_triplet_stream(spark, src, out, ck)
    wr.write_triplets(t.where("record_id >= 3"), src, block_size=1, compression="none", mode="append")
    second = ingest_triplet_stream(spark, src, out, ck)
    assert second["rows"] == 3  # only the new parts
    assert sorted(r.record_id for r in read_ingested(spark, out).collect()) == list(range(6))


def test_record_dates_and_col_order(spark):
    d = spark.createDataFrame([(0, "2020010100"), (3, "2020010206")], "record_id int, s string") \
        .select("record_id", F.to_timestamp_ntz("s", F.lit("yyyyMMddHH")).alias("obs_ts"))
    p = scratch_path(spark, "dates")
    wr.write_record_dates(d, p)
    assert sorted(tuple(r) for r in rd.read_record_dates(spark, p).collect()) == sorted(tuple(r) for r in d.collect())
    p0, p1 = scratch_path(spark, "c0"), scratch_path(spark, "c1")
    spark.createDataFrame([("7",), ("3",)], "value string").write.text(p0)  # two files, 7 in the first
    spark.createDataFrame([("1",)], "value string").write.text(p1)
    co = sorted(tuple(r) for r in rd.read_col_order(spark, [p0, p1]).collect())
    assert co == [(0, 7), (1, 3), (2, 1)]


def files_of(spark, name, *contents, fmt="text"):
    """A folder of one file per item of ``contents``, named in their order; the first is the smallest."""
    p = scratch_path(spark, name)
    for k, c in enumerate(contents):
        df = spark.createDataFrame([(x,) for x in c], "value string") if fmt == "text" else \
            spark.createDataFrame([(x, [float(x)]) for x in c], "row_id bigint, vector array<double>")
        getattr(df.coalesce(1).write, fmt)(f"{p}/f{k}")
    return f"{p}/*"


@pytest.mark.parametrize("split", ["128m", "4k"])
def test_col_order_is_in_file_order_whatever_the_file_sizes(spark, split):
    many = [str(100 + (i * 7919) % 3001) for i in range(3000)]
    p0 = files_of(spark, "sized", ["7"], many, ["", "5", "3"])
    p1 = files_of(spark, "sized", ["1"], ["2", "0"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [r.record_id for r in rd.read_col_order(spark, [p0, p1]).orderBy("col_pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [7, *map(int, many), 5, 3, 1, 2, 0]


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_manifest_is_in_file_order_whatever_the_file_sizes(spark, fmt):
    many = [(i * 7919) % 5003 for i in range(5000)]
    p0, p1 = files_of(spark, "rows", [9], many, [4, 2], fmt=fmt), files_of(spark, "rows", [8], [1], fmt=fmt)
    m = rd.read_manifest(spark, [(p0, fmt, 0), (p1, fmt, 0), (p0, fmt, 0)], file_order=True)
    rows = m.orderBy("row_id").collect()
    once = [9, *many, 4, 2]
    assert [r.row_id for r in rows] == list(range(len(rows))) and [r.source_row_id for r in rows] == [*once, 8, 1, *once]


def test_manifest_lines(spark):
    p = files_of(spark, "manifest", ["# data sets", "", "/a/b  temp 12", "/c parquet 3", "/d,orc,0", "/e", "/f,csv"])
    assert rd.parse_manifest(spark, p) == [("/a/b/temp", "parquet", 12), ("/c", "parquet", 3), ("/d", "orc", 0), ("/e", "parquet", 0), ("/f", "csv", 0)]


def test_manifest_file_order_numbering(spark):
    p0, p1 = scratch_path(spark, "m0"), scratch_path(spark, "m1")
    spark.createDataFrame([(5, [1.0]), (3, [2.0])], "row_id bigint, vector array<double>").coalesce(1).write.parquet(p0)
    spark.createDataFrame([(1, [3.0])], "row_id bigint, vector array<double>").coalesce(1).write.parquet(p1)
    by_id = {r.row_id: r.source_row_id for r in rd.read_manifest(spark, [(p0, "parquet", 2), (p1, "parquet", 1)]).collect()}
    assert by_id == {0: 3, 1: 5, 2: 1}
    by_file = {r.row_id: r.source_row_id for r in
               rd.read_manifest(spark, [(p0, "parquet", 2), (p1, "parquet", 1)], file_order=True).collect()}
    assert by_file == {0: 5, 1: 3, 2: 1}


def test_part_prefix_selects_record_files(spark):
    p = scratch_path(spark, "flat")
    import os
    local = p[len("file:"):] if p.startswith("file:") else p  # tests use a local checkpoint folder
    os.makedirs(local)
    for rec, lines in ((3, "3,0,1.5\n3,1,2.5\n"), (10003, "10003,0,4.0\n")):
        with open(os.path.join(local, f"part-{rec:05d}"), "w") as f:
            f.write(lines)
    got = sorted(tuple(r) for r in rd.read_triplets(spark, p, part_prefix="0").collect())
    assert got == [(3, 0, 1.5), (3, 1, 2.5)]
    assert rd.read_triplets(spark, p).count() == 3


def test_coordinate_text_leaves_out_null_values(spark):
    p = scratch_path(spark, "coord")
    wr.write_coordinate_text(spark.createDataFrame([(0, 0, 1.5), (1, 0, None), (2, 1, 0.25)], "i long, j long, value double"), p, 3, 2)
    assert sorted(r.value for r in spark.read.text(p).collect()) == sorted(["1 1 1.5", "3 2 0.25", rd.COORD_HEADER, "3 2 2"])
    assert sorted(tuple(r) for r in rd.read_coordinate_text(spark, p).collect()) == [(0, 0, 1.5), (2, 1, 0.25)]
