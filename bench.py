"""Headline benchmark: prints ONE JSON line.

year, centered, k=3, U materialized), eof_randomized (embeddings,
centered, k=5, oversample 5, 10 rounds of distributed products, U
materialized).  Each is run ``BENCH_WARMUPS`` times to warm up, then timed
``BENCH_REPEAT`` times; the median is kept.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3), BENCH_WARMUPS (default 3), BENCH_EVENTLOG_DIR (optional: write Spark's event
log there for stage and task times).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldmodes.operators import factorize as fz  # noqa: E402
from fieldmodes.operators import preprocess as pp  # noqa: E402
from fieldmodes.operators import products as pr  # noqa: E402
from fieldmodes.operators import reshape as rs  # noqa: E402
from fieldmodes.plans import catalog as cat  # noqa: E402
from fieldmodes.plans import fixtures as fx  # noqa: E402
from fieldmodes.session import get_session  # noqa: E402


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def b_pivot_rows(spark, sf):
    mat, _, _ = fx.matrix(spark, sf, "part_year", on_missing="null")
    _run(mat)


def b_hconcat(spark, sf):
    _run(rs.hconcat(cat._hconcat_pieces(spark, sf)))


def b_gram(spark, sf):
    mat, _, n = fx.matrix(spark, sf, "part_year", on_missing="drop_row")
    pr.gram(mat, n)


def b_eof_exact(spark, sf):
    mat, _, _ = fx.matrix(spark, sf, "supplier_year")
    res, m = fz.run_eofs(pp.preprocess(mat, pp.CENTER).mat, 3, "exact")
    _run(res.u)
    m.unpersist()


def b_eof_randomized(spark, sf):
    mat, _, _ = fx.matrix(spark, sf, "vec_dim")
    res, m = fz.run_eofs(pp.preprocess(mat, pp.CENTER).mat, 5, "randomized", oversample=5, power_iters=10, seed=0,
                          product="distributed")
    _run(res.u)
    m.unpersist()


BENCH = {
    "pivot_rows": b_pivot_rows,
    "hconcat": b_hconcat,
    "gram": b_gram,
    "eof_exact": b_eof_exact,
    "eof_randomized": b_eof_randomized,
}


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    extra = {}
    if os.environ.get("BENCH_EVENTLOG_DIR"):
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENTLOG_DIR"]}
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="fieldmodes-bench", extra=extra)
    out = {}
    for name, fn in BENCH.items():
        for _ in range(int(os.environ.get("BENCH_WARMUPS", "3"))):  # JIT, Python workers, file listing
            fn(spark, sf)
        times = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            fn(spark, sf)
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    sf_val = sf.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(sf_val) if sf_val.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
