"""Record ingest operators (B2-B9): masking, location numbering, level
selection, sharding, resumable conversion, record numbering and dates.

Field parsing (B1) lives with the text readers (``sources.readers``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmodes.operators.reshape import dense_index

# The depth levels are read from messages 207 (surface)
# and then 40 down to 1; level i is the i-th selected message.
SURFACE_MESSAGE = 207
SUBSURFACE_MESSAGES = 40


def level_messages() -> list[tuple[int, int]]:
    """(message_no, level_i) pairs built from the rule above (41 rows)."""
    msgs = [SURFACE_MESSAGE] + list(range(SUBSURFACE_MESSAGES, 0, -1))
    return [(m, i) for i, m in enumerate(msgs)]


def compress_mask(grid_obs: DataFrame, value: str = "value") -> DataFrame:
    """Drop masked cells (NULL values) (B2)."""
    return grid_obs.where(F.col(value).isNotNull())


def assign_loc_ids(cells: DataFrame, cell_col: str = "cell_id", out_col: str = "loc_id") -> DataFrame:
    """Dense 0-based location ids in cell order for observed cells.

    Built once on the grid dimension with a distributed numbering, then
    joined to data; never a one-task window over the observations."""
    return dense_index(cells.select(cell_col).distinct(), [cell_col], out_col)


def select_levels(df: DataFrame, message_col: str = "message_no") -> DataFrame:
    """Keep the 41 depth messages and attach their level index."""
    spark = df.sparkSession
    lv = spark.createDataFrame(level_messages(), f"{message_col} int, level_i int")
    return df.join(F.broadcast(lv), message_col)  # fixed 41-row table


def shard_of(record_col: str, n: int) -> Column:
    """Shard number of a record (B5): record mod n."""
    return F.pmod(F.col(record_col), F.lit(n)).cast("int")


def shard(df: DataFrame, n: int, r: int, record_col: str = "record_id") -> DataFrame:
    """Keep the records of shard r of n."""
    return df.where(shard_of(record_col, n) == r)


def pending_records(all_records: DataFrame, done: DataFrame, key: str = "record_id") -> DataFrame:
    """Records not yet converted: anti join against finished ids."""
    return all_records.join(done.select(key).distinct(), key, "left_anti")


def number_records(keys: DataFrame, key: str = "record_key") -> DataFrame:
    """0-based record number in sorted key order.

    The key listing is the time dimension (one row per record file)."""
    return keys.select(key).distinct().select(
        (F.row_number().over(Window.orderBy(key)) - 1).cast("int").alias("record_id"), key)


def date_from_key(key: str = "record_key", part: int = 3, fmt: str = "yyyyMMddHH") -> Column:
    """Timestamp from the ``part``-th dot-separated piece of a key."""
    return F.to_timestamp_ntz(F.split_part(F.col(key), F.lit("."), F.lit(part)), F.lit(fmt))


def truncate_components(df: DataFrame, k: int, component: str = "component") -> DataFrame:
    """Keep the first k components of a long factor table."""
    return df.where(F.col(component) < k)


def truncate_vector(vector: str, k: int) -> Column:
    """Keep the first k entries of a row vector (B9, wide form)."""
    return F.slice(F.col(vector), 1, k)
