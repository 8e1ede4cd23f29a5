"""Cell store, one-scan ingest, ordered field files, lifetime of kept data."""

import glob
import json
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldmodes.operators import reshape as rs
from fieldmodes.plans import catalog as cat
from fieldmodes.plans import jobs as jb
from fieldmodes.session import Lifetime, path_exists, scratch_path
from fieldmodes.sources import cellstore as cs
from fieldmodes.sources import readers as rd
from fieldmodes.sources import writers as wr

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _text(spark, lines, parts=3):
    path = scratch_path(spark, "text")
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(parts).write.text(path)
    return path


def _local(path):
    return path.replace("file:", "", 1)


def _persistent(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_store_holds_cells_and_rejects_of_one_scan(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 5))
    good = [f"{c},{r},{a[r, c]!r}".replace("np.float64(", "").replace(")", "") for r in range(40) for c in range(5)]
    bad = ["", "1,2", "x,1,2.0", "1,y,2.0", "1,2,z", "1,2,3.0,4", *["junk"] * 50]
    path = scratch_path(spark, "cells")
    assert cs.write_cells(spark, _text(spark, good + bad), path, buckets=7) == [0, 1, 2, 3, 4]
    cells = cs.read_cells(spark, path)
    assert sorted((r.record_id, r.row_id, r.value) for r in cells.collect()) == sorted((c, r, a[r, c]) for r in range(40) for c in range(5))
    assert sorted(r.line for r in cs.read_rejects(spark, path).collect()) == sorted(bad)
    assert 1 < len(glob.glob(f"{_local(path)}/good=true/*.parquet")) <= 7  # a bucket is one file
    co = spark.createDataFrame([(c, c) for c in range(5)], "col_pos int, record_id int")
    mat = rs.pivot_rows(cells, co, n_cols=5, laid_out=True)
    assert "Exchange hashpartitioning" not in _plan(mat)
    got = {r.row_id: r.vector for r in mat.collect()}
    assert got == {r: a[r].tolist() for r in range(40)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cells_")]


def test_layout_keeps_the_duplicate_check(spark):
    path = scratch_path(spark, "cells")
    cs.write_cells(spark, _text(spark, ["0,1,1.0", "1,1,2.0", "0,1,5.0"], 2), path)
    cells = cs.read_cells(spark, path)
    with pytest.raises(Exception, match="(?i)duplicate"):
        rs.pivot_rows(cells, laid_out=True).collect()
    mat = rs.pivot_rows(cells, on_duplicate="avg", laid_out=True)
    assert mat.first().vector == [3.0, 2.0]


def test_store_of_nothing_and_of_rejects_only(spark):
    for lines in ([], ["no cell", ""]):
        path = scratch_path(spark, "cells")
        assert cs.write_cells(spark, _text(spark, lines, 1), path) == []
        assert cs.read_cells(spark, path).collect() == [] and cs.read_rejects(spark, path).count() == len(lines)


def test_ingest_reads_the_text_once(tmp_path):
    """Event log of a session of its own: tasks that read the text read each of its bytes once."""
    import subprocess
    import sys
    src, log = tmp_path / "src", tmp_path / "log"
    src.mkdir(), log.mkdir()
    for k in range(4):
        (src / f"part-{k:05d}").write_text("".join(f"{k},{r},{k + r}.5\n" for r in range(5000)) + "bad line\n")
    code = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from fieldmodes.plans import jobs as jb
from fieldmodes.session import get_session
spark = get_session("local[2]", 4, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{log}", "spark.eventLog.compress": "false"}})
out = jb.ingest_job(spark, "{src}", "{tmp_path}/out")
assert out["n_cols"] == 4 and spark.read.parquet(out["rowmat"]).count() == 5000 and spark.read.parquet(out["rejects"]).count() == 4
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=240)
    events = [json.loads(x) for f in glob.glob(f"{log}/**/*", recursive=True) if os.path.isfile(f) for x in open(f) if x.startswith("{")]
    text_scans = set()

    def visit(node):
        if node["nodeName"].strip() == "Scan text":
            text_scans.add(tuple(m["accumulatorId"] for m in node["metrics"] if m["name"] == "number of output rows"))
        for c in node["children"]:
            visit(c)
    for e in events:
        if "sparkPlanInfo" in e:
            visit(e["sparkPlanInfo"])
    rows = {a["ID"]: int(a["Value"]) for e in events if e["Event"] == "SparkListenerStageCompleted" for a in e["Stage Info"]["Accumulables"]
            if str(a.get("Value", "")).isdigit()}
    assert sum(rows.get(i, 0) for ids in text_scans for i in ids) == 4 * 5001


def test_field_files_are_sorted_runs_in_grid_order(spark):
    fields = spark.range(6 * 500).select(
        F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("component"), (F.col("id") * 7919 % 3000).alias("cell_id")).select(
        "component", "cell_id", F.floor(F.col("cell_id") / 500).cast("int").alias("level_i"), (F.col("cell_id") * 0.5).alias("value"))
    path = scratch_path(spark, "fields")
    wr.write_fields(fields.repartition(40), path)
    runs = {}
    for f in sorted(glob.glob(f"{_local(path)}/fields/component=*/*.parquet")):
        cells = pq.read_table(f, partitioning=None)["cell_id"].to_pylist()
        assert cells == sorted(cells)
        runs.setdefault(f.split("component=")[1].split("/")[0], []).append((cells[0], cells[-1], len(cells)))
    assert set(runs) == {"-1", "0", "1"} and sum(len(x) for x in runs.values()) < 12  # not one file a task and component
    for r in runs.values():
        r.sort()
        assert sum(x[2] for x in r) == 3000 and all(p[1] < q[0] for p, q in zip(r, r[1:]))
    back = spark.read.parquet(f"{path}/fields").where("level_i = 2 AND component = 1")
    assert back.count() == 500 and "PushedFilters: [IsNotNull(level_i), EqualTo(level_i,2)]" in _plan(back)


def test_lifetime_frees_all_it_owns(spark):
    before = _persistent(spark)
    with pytest.raises(RuntimeError), Lifetime(spark) as life:
        df = life.cache(spark.range(10))
        path = life.scratch("x")
        df.write.parquet(path)
        bc = life.broadcast([1])
        assert path_exists(spark, path) and _persistent(spark) == before + 1 and bc.value == [1]
        raise RuntimeError
    assert not path_exists(spark, path) and _persistent(spark) == before and not df.is_cached


def test_jobs_and_queries_leave_nothing_cached(spark):
    before = _persistent(spark)
    src, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    wr.write_triplets(spark.range(60).select((F.col("id") % 4).cast("int").alias("record_id"), F.floor(F.col("id") / 4).alias("row_id"),
                                             (F.col("id") * 1.5 % 7).alias("value")), src)
    base = _local(os.path.dirname(src))
    held = set(os.listdir(base)) | {os.path.basename(out)}
    paths = jb.ingest_job(spark, src, out)
    jb.eof_job(spark, paths["rowmat"], f"{out}/eofs", 1)
    assert set(os.listdir(base)) <= held
    cat.QUERIES["eof_coslat_supplier_year"](spark, SF).count()
    assert _persistent(spark) == before
    assert rd.read_row_matrix(spark, paths["rowmat"]).count() == 15
