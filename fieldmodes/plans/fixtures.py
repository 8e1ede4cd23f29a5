"""Observation fields derived by Spark from the given test tables.

Every matrix here is a Spark plan over the full tables, so its work grows
with the data:

  supplier_year  lineitem: supplier x ship year,   sum(price)/1e6 (complete)
  part_year      lineitem: part x ship year,       sum(price)/1e6 (cells missing)
  supplier_status lineitem: supplier x linestatus  (2 columns, complete)
  supplier_flag  lineitem: supplier x returnflag   (3 columns, complete)
  supplier_day   lineitem: supplier x ship day,    sum(price)/1e6 (wide: ~2,500
                 daily columns; a day without shipments is a zero total)
  user_type      events:   user x event type,      avg(value)
  user_day       events:   user x day,             sum(value) (cells missing)
  vec_dim        embeddings: vec_id x dimension (native row matrix)
  weights        supplier: abs(cos(lat)), lat = s_nationkey*7-84 degrees;
                 suppliers with a negative balance have no weight row
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmodes.functions.vector import lat_weight
from fieldmodes.operators.reshape import column_order, pivot_rows, small_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str = "l_extendedprice"):
    return (F.sum(c) / F.lit(1e6)).alias("value")


def triplets_supplier_year(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("row_id"),
                      F.year("l_shipdate").cast("int").alias("record_id")).agg(_money())


def triplets_part_year(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("row_id"),
                      F.year("l_shipdate").cast("int").alias("record_id")).agg(_money())


def triplets_supplier_status(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("row_id"), F.col("l_linestatus").alias("record_id")).agg(_money())


def triplets_supplier_flag(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("row_id"), F.col("l_returnflag").alias("record_id")).agg(_money())


def triplets_supplier_day(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("row_id"), day_index("l_shipdate").alias("record_id")).agg(_money())


def triplets_user_type(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("row_id"), F.col("event_type").alias("record_id")).agg(
        F.avg("value").alias("value"))


def day_index(ts_col: str = "ts"):
    """Whole days since the Unix epoch: the record number of a daily field."""
    return F.datediff(F.to_date(F.col(ts_col)), F.lit("1970-01-01").cast("date")).cast("int")


def triplets_user_day(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("row_id"), day_index().alias("record_id")).agg(
        F.sum("value").alias("value"))


def _orders(spark, sf_dir, record) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("row_id"), record.cast("int").alias("record_id"),
                    (F.col("o_totalprice") / 1e6).cast("double").alias("value"))


def triplets_order_day(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir, day_index("o_orderdate"))


def triplets_order_month(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir, F.year("o_orderdate") * 12 + F.month("o_orderdate"))


TRIPLETS = {
    "order_day": triplets_order_day,
    "order_month": triplets_order_month,
    "supplier_year": triplets_supplier_year,
    "part_year": triplets_part_year,
    "supplier_status": triplets_supplier_status,
    "supplier_flag": triplets_supplier_flag,
    "supplier_day": triplets_supplier_day,
    "user_type": triplets_user_type,
    "user_day": triplets_user_day,
}


def matrix(spark, sf_dir, name: str, on_missing: str = "error", sparse: bool = False, triplets: DataFrame | None = None):
    """(rowmat, col_order, n_cols) for a named field; ``sparse``: rows without the zeros of absent cells;
    ``triplets``: those of the field, if they have been written before."""
    if name == "vec_dim":
        emb = table(spark, sf_dir, "embeddings")
        m = emb.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"))
        return m, None, None
    t = TRIPLETS[name](spark, sf_dir) if triplets is None else triplets
    co, n = small_table(column_order(t))  # one job; the time dimension is small
    # The triplets come out of a groupBy on (row, record): one shuffle suffices.
    return pivot_rows(t, co, on_missing=on_missing, n_cols=n, pre_aggregate=False, sparse=sparse), co, n


def weights_supplier(spark, sf_dir, everyone: bool = False) -> DataFrame:
    """Latitude weights; without ``everyone`` some suppliers have none (their rows become 0)."""
    sup = table(spark, sf_dir, "supplier")
    lat = (F.col("s_nationkey") * 7 - 84).cast("double")
    return sup.where(F.lit(everyone) | (F.col("s_acctbal") >= 0)).select(F.col("s_suppkey").alias("row_id"),
                                                      lat_weight(lat).alias("weight"))


def record_dates_year(t: DataFrame) -> DataFrame:
    """record_id (a year) -> first instant of that year."""
    return t.select("record_id").distinct().select(
        "record_id", F.make_timestamp_ntz(F.col("record_id"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        .alias("obs_ts"))
