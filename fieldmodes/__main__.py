"""Command line for the end-to-end jobs.

  python -m fieldmodes ingest  TRIPLETS OUT [--blocks 0 1] [--on-missing error|null|drop_row|zero]
  python -m fieldmodes convert OBSERVATIONS GRID OUT [--shards N --shard R] [--keys LISTING]
  python -m fieldmodes combine OUT PIECE [PIECE ...]
  python -m fieldmodes eofs    ROWMAT OUT PREPROCESS K METHOD [--manifest] [--weights CSV] [--seed N]
                               (--manifest: ROWMAT is a text manifest of row matrices)
  python -m fieldmodes export  FACTORS GRID OUT [--col-order DIR] [--record-dates DIR]

PREPROCESS is centerOverAllObservations | standardizeEach |
cosLat+centerOverAllObservations (or center | standardize | coslat | none);
METHOD is exact | randomized | both ('both' writes OUTexact and OUTinexact).
The master and resources come from spark-submit / the environment.
"""

from __future__ import annotations

import argparse
import json

from fieldmodes.plans import jobs
from fieldmodes.session import get_session
from fieldmodes.sources import readers as rd


def main(argv=None):
    ap = argparse.ArgumentParser(prog="fieldmodes")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("triplets")
    a.add_argument("out")
    a.add_argument("--blocks", type=int, nargs="*")
    a.add_argument("--on-missing", default="error")
    c = sub.add_parser("convert")
    c.add_argument("observations")
    c.add_argument("grid")
    c.add_argument("out")
    c.add_argument("--shards", type=int, default=1)
    c.add_argument("--shard", type=int, default=0)
    c.add_argument("--keys")
    b = sub.add_parser("combine")
    b.add_argument("out")
    b.add_argument("pieces", nargs="+")
    e = sub.add_parser("eofs")
    e.add_argument("rowmat")
    e.add_argument("out")
    e.add_argument("preprocess")
    e.add_argument("k", type=int)
    e.add_argument("method", choices=["exact", "randomized", "both"])
    e.add_argument("--manifest", action="store_true")
    e.add_argument("--weights")
    e.add_argument("--seed", type=int, default=0)
    x = sub.add_parser("export")
    x.add_argument("factors")
    x.add_argument("grid")
    x.add_argument("out")
    x.add_argument("--col-order")
    x.add_argument("--record-dates")
    args = ap.parse_args(argv)

    from pyspark import SparkConf
    master = None if SparkConf().contains("spark.master") else "local[*]"  # spark-submit sets it
    spark = get_session(master, app_name=f"fieldmodes-{args.cmd}")
    if args.cmd == "ingest":
        info = jobs.ingest_job(spark, args.triplets, args.out, blocks=args.blocks, on_missing=args.on_missing)
    elif args.cmd == "convert":
        keys = spark.read.text(args.keys).withColumnRenamed("value", "record_key") if args.keys else None
        info = jobs.convert_records_job(spark, spark.read.parquet(args.observations), rd.read_grid(spark, args.grid), args.out,
                                        n_shards=args.shards, shard=args.shard, record_keys=keys)
    elif args.cmd == "combine":
        info = jobs.combine_job(spark, args.pieces, args.out)
    elif args.cmd == "eofs":
        w = rd.read_weights(spark, args.weights) if args.weights else None
        res = jobs.eof_job(spark, None if args.manifest else args.rowmat, args.out, args.k, args.method, args.preprocess, w, seed=args.seed,
                           manifest=args.rowmat if args.manifest else None)
        results = res if isinstance(res, dict) else {"": res}
        info = {name or args.method: {"U": [r.n_rows, r.n_computed], "S": r.n_computed,
                                      "V": [r.n_cols, r.n_computed]} for name, r in results.items()}
    else:
        grid = rd.read_grid(spark, args.grid)
        co = rd.read_col_order(spark, [args.col_order]) if args.col_order else None
        dates = rd.read_record_dates(spark, args.record_dates) if args.record_dates else None
        info = jobs.export_job(spark, args.factors, grid, args.out, col_order=co, record_dates=dates)
    print(json.dumps(info))


if __name__ == "__main__":
    main()
