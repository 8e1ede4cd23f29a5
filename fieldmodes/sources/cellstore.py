"""Typed triplets laid out by row id: what the pivot needs, made in one pass over the text.

``write_cells`` scans triplet text once.  Every line becomes a typed cell or a
reject, both written by the same job: cells under ``good=true``, bucketed and
sorted by row id, rejected lines under ``good=false``.  The record ids are
collected on the way.  ``read_cells`` gives the cells with their layout, so the
pivot and its duplicate check shuffle no cell again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldmodes.session import path_exists
from fieldmodes.sources.readers import parsed_lines, triplet_lines

CELLS = "record_id INT, row_id BIGINT, value DOUBLE"


def write_cells(spark: SparkSession, text_path: str, path: str, blocks: list[int] | None = None,
                buckets: int | None = None) -> list[int]:
    """Triplet text -> cell store at ``path`` (A1, A17, B1); the ids of its records, ascending.

    One scan and one shuffle of typed cells by row id; a task writes one file of cells.  Rejected lines are dealt by
    a hash of the line, so a file full of them does not meet in one task.  ``buckets`` (default: the session's shuffle
    partitions) should give files of a few hundred MB.  The ids are a set, which a task that runs twice does not change;
    there is one per time record, the width of the matrix."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation()
    lines = parsed_lines(triplet_lines(spark, text_path, blocks)).select("good", "record_id", "row_id", "value", "line")
    lines = lines.observe(seen, F.sort_array(F.collect_set("record_id")).alias("records"))
    table = f"cells_{uuid.uuid4().hex}"
    (lines.repartition(n, F.coalesce("row_id", F.xxhash64("line"))).write.partitionBy("good")
     .bucketBy(n, "row_id").sortBy("row_id", "record_id").saveAsTable(table, format="parquet", path=path))
    spark.sql(f"DROP TABLE {table}")  # the files lie at a path of their own and stay
    spark.createDataFrame([(n,)], "buckets INT").coalesce(1).write.json(f"{path}/layout")
    # (a scan without lines may be planned away, and its observation with it)
    return list(seen.get["records"]) if path_exists(spark, f"{path}/good=true") else []


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a store: (record_id, row_id, value), partitioned by row id as they lie in the files."""
    if not path_exists(spark, f"{path}/good=true"):
        return spark.createDataFrame([], CELLS)
    n = spark.read.schema("buckets INT").json(f"{path}/layout").first()["buckets"]
    table = f"cells_{uuid.uuid4().hex}"
    # Spark keeps a layout with a table name; the name goes once it is read.
    spark.sql(f"CREATE TABLE {table} ({CELLS}) USING parquet CLUSTERED BY (row_id) SORTED BY (row_id, record_id) INTO {n} BUCKETS "
              f"LOCATION '{path}/good=true'")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rejected lines of a store: (line)."""
    if not path_exists(spark, f"{path}/good=false"):
        return spark.createDataFrame([], "line STRING")
    return spark.read.schema("line STRING").parquet(f"{path}/good=false")
