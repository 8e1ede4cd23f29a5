"""Sinks (A10-A18).  All writes are distributed DataFrame writes; the
output guard is the writer's save mode ('ignore' skips an existing
output, 'errorifexists' refuses it) (A18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldmodes.sources.readers import COORD_HEADER

RECORD_BLOCK = 10000  # records per triplet block (the reference's 5-digit names)


def write_triplets(df: DataFrame, path: str, block_size: int = RECORD_BLOCK,
                   compression: str = "gzip", mode: str = "errorifexists") -> None:
    """'rec,loc,val' text, partitioned by record block (A10).

    Blocks become ``record_block=`` folders, so a reader selecting blocks
    prunes whole folders (the reference's per-prefix glob)."""
    out = df.select(F.floor(F.col("record_id") / block_size).cast("int").alias("record_block"),
                    "record_id", "row_id", F.col("value").cast("string").alias("value"))
    line = F.concat_ws(",", F.col("record_id").cast("string"), F.col("row_id").cast("string"), "value")
    (out.select("record_block", line.alias("value"))
        .write.mode(mode).partitionBy("record_block").option("compression", compression).text(path))


def write_row_matrix(mat: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Row matrix to Parquet."""
    mat.select("row_id", "vector").write.mode(mode).parquet(path)


def write_col_order(col_order: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Column order as 'col_pos,record_id' text in one small file.

    The table has one row per time record, so a single writer is cheap."""
    col_order.coalesce(1).select("col_pos", "record_id").write.mode(mode).csv(path)


def write_record_dates(dates: DataFrame, path: str, fmt: str = "yyyyMMddHH", mode: str = "errorifexists") -> None:
    """'record_id,date text' CSV."""
    dates.select("record_id", F.date_format("obs_ts", fmt).alias("date_text")).write.mode(mode).csv(path)


def save_factors(spark: SparkSession, res, path: str, row_stats: DataFrame | None = None,
                 mode: str = "errorifexists") -> None:
    """U (distributed), S, V and optional row stats as Parquet tables."""
    res.u_long().write.mode(mode).parquet(f"{path}/u")
    res.s_df(spark).coalesce(1).write.mode(mode).parquet(f"{path}/s")
    res.v_df(spark).coalesce(1).write.mode(mode).parquet(f"{path}/v")
    if row_stats is not None:
        row_stats.write.mode(mode).parquet(f"{path}/row_stats")


def write_coordinate_text(long_df: DataFrame, path: str, n_rows: int, n_cols: int,
                          i: str = "i", j: str = "j", value: str = "value") -> None:
    """1-based 'i j v' lines plus header and size line.

    Values are written with Spark's shortest exact text (the reference's
    6-decimal form was lossy, defect 6).  Entries are written in parallel and
    counted on the way; the two header lines go to their own small file in the
    same folder.  A NULL value is an entry that is not there."""
    written = Observation()
    entries = long_df.where(F.col(value).isNotNull()).observe(written, F.count("*").alias("n"))
    body = entries.select(F.concat_ws(" ", (F.col(i) + 1).cast("string"), (F.col(j) + 1).cast("string"),
                                      F.col(value).cast("string")).alias("value"))
    body.write.mode("errorifexists").text(path)
    spark = long_df.sparkSession
    head = spark.createDataFrame([(COORD_HEADER,), (f"{n_rows} {n_cols} {written.get['n']}",)], "value string")
    head.coalesce(1).write.mode("append").text(path)


def write_fields(fields: DataFrame, path: str, attrs: dict | None = None, mode: str = "errorifexists") -> None:
    """Gridded fields, one folder per component, plus a metadata table.

    ``fields``: (component, cell_id, level_i, lat, lon, value) with fills.
    Cells are range-partitioned and sorted in grid order (level, cell), so a
    file is one sorted run, the number of files follows the size of the data
    (adaptive execution joins small ranges), and a reader that selects levels
    or cells skips row groups by their statistics."""
    order = ["component", *(c for c in ("level_i", "cell_id") if c in fields.columns)]
    fields.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("component").parquet(f"{path}/fields")
    if attrs:
        spark = fields.sparkSession
        spark.createDataFrame([(str(k), str(v)) for k, v in attrs.items()], "name string, value string") \
            .coalesce(1).write.mode(mode).parquet(f"{path}/attributes")


def write_rejects(rejects: DataFrame, path: str, mode: str = "append") -> None:
    """Reject log (A17): bad lines are kept, the job goes on."""
    rejects.write.mode(mode).text(path) if rejects.columns == ["line"] else rejects.write.mode(mode).parquet(path)
