"""Written tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmodes.session import delete_path, scratch_path
from fieldmodes.session import prepare as prepare_session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """The shared folder and the package on the executors; Arrow batches of texts bounded in bytes."""
    prepare_session(spark)
    now = spark.conf.get(BATCH, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keep(df: DataFrame, name: str, partition_by: str | None = None, bucket_by: str | None = None) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    ``bucket_by``: also lay the rows out by the hash of a column, so that later joins on it leave them
    where they are.  Spark keeps the layout with a table name; the name is dropped once it is read."""
    spark = df.sparkSession
    prepare(spark)
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the table replaces the shuffle files it came from
    writer = df.write.option("compression", "zstd")
    table = path.rsplit("/", 1)[1].replace("-", "_") if bucket_by else ""
    try:
        if bucket_by:
            writer.bucketBy(partitions(spark), bucket_by).saveAsTable(table, format="parquet", path=path)
        else:
            writer.parquet(path, partitionBy=partition_by)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if bucket_by:
        out = spark.table(table)
        spark.sql(f"DROP TABLE {table}")  # the files lie at a path of their own and stay
        return out
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(*dfs: DataFrame) -> None:
    """Delete the files of kept tables nobody reads any more (a loop's earlier rounds)."""
    for df in dfs:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, folder)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many ``_`` behind it as it takes to be no column of ``df`` (names are compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, apart: str) -> Column:
    """All columns of ``df`` but one as a struct ``row``, so that names an operator adds cannot clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != apart]
    return F.struct(*rest or [F.lit(0).alias("none")]).alias("row")


def unpacked(df: DataFrame, apart: str, value: str, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` in their order: from ``row``, and ``value`` for the one kept apart."""
    return [F.col(value).alias(apart) if c == apart else F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in without]
