"""Scans (A1-A9).  Every reader declares its schema; nothing is inferred.

Text formats are parsed JVM-side with ``split`` + ``try_cast`` so a bad
line becomes a reject row instead of failing the job (A17, B1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmodes.operators.reshape import dense_index, file_order_index, with_file_place
from fieldmodes.session import path_exists

# Fixed value: header line of the coordinate text format.
COORD_HEADER = "%%MatrixMarket matrix coordinate real general"


def parsed_lines(lines: DataFrame, sep: str = ",") -> DataFrame:
    """``value`` text lines 'rec,loc,val' -> (good, record_id, row_id, value, line, other columns).

    A good line has the three numbers and no ``line``, a bad one only its ``line``."""
    rest = [c for c in lines.columns if c != "value"]
    p = lines.select(F.col("value").alias("line"), F.split(F.trim(F.col("value")), sep).alias("_p"), *rest)
    p = p.select("line", *rest, F.expr("try_cast(trim(get(_p, 0)) AS INT)").alias("_rec"), F.expr("try_cast(trim(get(_p, 1)) AS BIGINT)").alias("_loc"),
                 F.expr("try_cast(trim(get(_p, 2)) AS DOUBLE)").alias("_val"), F.size("_p").alias("_n"))
    ok = (F.col("_n") == 3) & F.col("_rec").isNotNull() & F.col("_loc").isNotNull() & F.col("_val").isNotNull()
    return p.select(ok.alias("good"), *(F.when(ok, F.col(c)).alias(name) for c, name in (("_rec", "record_id"), ("_loc", "row_id"), ("_val", "value"))),
                    F.when(~ok, F.col("line")).alias("line"), *rest)


def parse_triplet_lines(lines: DataFrame, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """``value`` text lines 'rec,loc,val' -> (triplets, rejects)."""
    rest = [c for c in lines.columns if c != "value"]
    p = parsed_lines(lines, sep)
    return p.where("good").select("record_id", "row_id", "value", *rest), p.where("NOT good").select("line", *rest)


def triplet_lines(spark: SparkSession, path: str, blocks: list[int] | None = None, part_prefix: str | None = None) -> DataFrame:
    """The lines of triplet text (see ``read_triplets``), other blocks pruned."""
    lines = spark.read.text(f"{path.rstrip('/')}/part-{part_prefix}*" if part_prefix is not None else path)
    if "record_block" not in lines.columns:
        return lines
    return (lines if blocks is None else lines.where(F.col("record_block").isin(list(blocks)))).drop("record_block")


def read_triplets(spark: SparkSession, path: str, blocks: list[int] | None = None,
                  with_rejects: bool = False, part_prefix: str | None = None):
    """Triplet text scan (A1).  gzip is transparent.  ``blocks`` prunes the
    ``record_block=`` partitions written by ``write_triplets``;
    ``part_prefix`` selects flat ``part-<prefix>*`` files (one file per
    record, zero-padded record number), e.g. '0' for records 0-9999."""
    good, bad = parse_triplet_lines(triplet_lines(spark, path, blocks, part_prefix))
    return (good, bad) if with_rejects else good


def read_record_dates(spark: SparkSession, path: str | list[str], fmt: str = "yyyyMMddHH") -> DataFrame:
    """'rec,datestring' lines -> ``(record_id INT, obs_ts TIMESTAMP_NTZ)`` (A2)."""
    df = spark.read.schema("record_id INT, date_text STRING").csv(path)
    return df.select("record_id", F.to_timestamp_ntz("date_text", F.lit(fmt)).alias("obs_ts"))


def read_col_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Column-order pieces in list order -> one global ``col_pos``.

    A piece holds 'col_pos,record_id' lines, in any order, or bare record ids
    in the order of its files' names and of the lines in them.  Empty lines are skipped; any other line that
    is neither fails.
    """
    pieces = [with_file_place(spark.read.text(p), "text").select(F.lit(i).alias("piece"), "value", "place") for i, p in enumerate(paths)]
    u = file_order_index(reduce(DataFrame.unionByName, pieces), "line", "piece").where(F.trim("value") != "").withColumn("f", F.split("value", ","))
    record, place = F.expr("try_cast(f[size(f) - 1] AS INT)"), F.expr("CASE WHEN size(f) = 1 THEN line ELSE try_cast(f[0] AS BIGINT) END")
    bad = record.isNull() | place.isNull() | (F.size("f") > 2)
    fail = F.raise_error(F.concat(F.lit("not a column-order line: "), "value"))
    u = u.select("piece", F.when(bad, fail.cast("bigint")).otherwise(place).alias("place"), record.alias("record_id"))
    return dense_index(u, ["piece", "place"], "col_pos").select(
        F.col("col_pos").cast("int"), "record_id")


def read_row_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Row-matrix Parquet (A4): ``(row_id, vector)`` or the reference's
    ``(index, vector)``; ML vectors are turned into arrays JVM-side."""
    df = spark.read.parquet(path)
    idx = "row_id" if "row_id" in df.columns else "index"
    vtype = df.schema["vector"].dataType.typeName()
    vec = F.col("vector")
    if vtype not in ("array",):
        from pyspark.ml.functions import vector_to_array
        vec = vector_to_array(vec)
    return df.select(F.col(idx).cast("long").alias("row_id"), vec.cast("array<double>").alias("vector"))


def read_manifest(spark: SparkSession, entries: list[tuple], order_col: str = "row_id",
                  file_order: bool = False) -> DataFrame:
    """Several row-matrix datasets unioned in list order, coalesced to the
    first entry's partition count, rows renumbered 0.. in that order (A5, G4).

    ``entries`` = [(path, format, partitions), ...]; format 'parquet', 'orc' or
    'csv' ('row;v0,v1,...').
    Rows are numbered by (source, ``order_col``); with ``file_order=True``
    by (source, file name, place in the file) as the original did, without a sort.
    The source id is kept as ``source_row_id``.
    """
    dfs = []
    for i, (path, fmt, _parts) in enumerate(entries):
        d = spark.read.csv(path, schema=f"{order_col} BIGINT, cells STRING", sep=";") if fmt == "csv" else spark.read.format(fmt).load(path)
        cells = F.split("cells", ",").cast("array<double>") if fmt == "csv" else F.col("vector")
        d = with_file_place(d, fmt) if file_order else d.withColumn("place", F.lit(None))
        dfs.append(d.select(F.lit(i).alias("source_ord"), F.col(order_col).alias("source_row_id"), cells.alias("vector"), "place"))
    u = reduce(DataFrame.unionByName, dfs)
    first_parts = entries[0][2] if entries and entries[0][2] else None
    numbered = file_order_index(u, "row_id", "source_ord") if file_order else dense_index(u, ["source_ord", "source_row_id"], "row_id")
    if first_parts:
        numbered = numbered.coalesce(int(first_parts))
    return numbered.select("row_id", "source_ord", "source_row_id", F.col("vector").cast("array<double>"))


FORMATS = ("parquet", "orc", "csv")


def parse_manifest(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """Text manifest -> entries of ``read_manifest`` (A5): one data set a line, 'path dataset partitions' split on
    blanks or 'path,dataset,partitions'.

    ``dataset`` is a format (parquet, orc, csv) or the name of a Parquet data set under the path.  It and the
    partitions may be left out (parquet, 0 = as read); empty lines and lines that begin with '#' are skipped."""
    entries = []
    for r in spark.read.text(path, wholetext=False).collect():  # one line per data set
        line = r["value"].strip()
        if line and not line.startswith("#"):
            parts = [p.strip() for p in line.split(",")] if "," in line else line.split()
            where, dataset, n = (*parts, "", "")[:3]
            if dataset and dataset not in FORMATS:
                where, dataset = f"{where.rstrip('/')}/{dataset}", "parquet"
            entries.append((where, dataset or "parquet", int(n or 0)))
    if not entries:
        raise ValueError(f"manifest {path} names no data set")
    return entries


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """'rowidx,weight' CSV -> ``(row_id, weight)`` (A6); joined, never collected."""
    return spark.read.schema("row_id BIGINT, weight DOUBLE").csv(path)


def read_grid(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Grid metadata table (A7): cell_id, level_i, lat_i, lon_i, lat, lon,
    depth_m and the observed location id (NULL = masked)."""
    g = spark.read.format(fmt).load(path)
    cols = ["cell_id", "level_i", "lat_i", "lon_i", "lat", "lon", "depth_m", "loc_id"]
    return g.select(*[c for c in cols if c in g.columns])


def read_coordinate_text(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate text -> 0-based ``(i, j, value)``.

    '%' lines are comments; in each file that carries the header, the first
    non-comment line is the size line and is dropped.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("mid"))
    body = lines.where(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0))
    headed = lines.where(F.col("value").startswith("%%MatrixMarket")).select("f").distinct()
    size_lines = (body.where(F.col("b") == 0).join(headed, "f")
                  .groupBy("f").agg(F.min("mid").alias("mid")))  # one row per file
    entries = body.join(F.broadcast(size_lines), ["f", "mid"], "left_anti")
    p = entries.select(F.split(F.trim("value"), r"\s+").alias("t"))
    return p.select((F.col("t")[0].cast("long") - 1).alias("i"), (F.col("t")[1].cast("long") - 1).alias("j"),
                    F.col("t")[2].cast("double").alias("value"))


def load_factors(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """U, S, V and row statistics saved by ``save_factors``."""
    out = {}
    for name in ("u", "s", "v", "row_stats"):
        if name != "row_stats" or path_exists(spark, f"{path}/{name}"):  # row_stats is optional
            out[name] = spark.read.parquet(f"{path}/{name}")
    return out
