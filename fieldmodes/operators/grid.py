"""Grid dimension and export-side lookups.

grid(cell_id, level_i, lat_i, lon_i, lat, lon, depth_m, loc_id NULL=masked)
cell = level * nlat * nlon + lat_i * nlon + lon_i  (row-major, C8)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.operators.reshape import maybe_broadcast

# Depths (m) of the 41 levels below sea level.
DEPTHS_M = [0, 5, 15, 25, 35, 45, 55, 65, 75, 85, 95, 105, 115, 125, 135,
            145, 155, 165, 175, 185, 195, 205, 215, 225, 238, 262, 303,
            366, 459, 584, 747, 949, 1193, 1479, 1807, 2174, 2579, 3016,
            3483, 3972, 4478]
FILL = 9999.0  # export fill value for masked cells


def build_grid_dim(cells: DataFrame, nlat: int, nlon: int, cell_col: str = "cell_id") -> DataFrame:
    """Coordinates of every cell by index arithmetic.

    Cell centres: lat = -90 + (lat_i + 0.5) * 180/nlat, lon = (lon_i + 0.5) * 360/nlon.
    Depth comes from the fixed level table (NULL beyond its last level).
    """
    per_level = nlat * nlon
    c = F.col(cell_col)
    level = F.floor(c / per_level).cast("int")
    lat_i = F.pmod(F.floor(c / nlon), F.lit(nlat)).cast("int")
    lon_i = F.pmod(c, F.lit(nlon)).cast("int")
    depths = F.array(*[F.lit(float(d)) for d in DEPTHS_M])
    g = cells.select(c.cast("long").alias("cell_id"), level.alias("level_i"), lat_i.alias("lat_i"),
                     lon_i.alias("lon_i"))
    return g.select("cell_id", "level_i", "lat_i", "lon_i",
                    (F.lit(-90.0) + (F.col("lat_i") + 0.5) * (180.0 / nlat)).alias("lat"),
                    ((F.col("lon_i") + 0.5) * (360.0 / nlon)).alias("lon"),
                    F.try_element_at(depths, F.col("level_i") + 1).alias("depth_m"))


def depths_table(spark) -> DataFrame:
    """The fixed 41-row level -> depth table."""
    return spark.createDataFrame([(i, float(d)) for i, d in enumerate(DEPTHS_M)], "level_i int, depth_m double")


def lat_weights(grid: DataFrame, key: str = "loc_id") -> DataFrame:
    """Per-location area weight abs(cos(lat)) from the grid (E5); masked cells
    (NULL ``key``) carry no weight row."""
    from fieldmodes.functions.vector import lat_weight
    return grid.where(F.col(key).isNotNull()).select(F.col(key).alias("row_id"), lat_weight("lat").alias("weight"))


def attach_loc_ids(grid: DataFrame, loc_ids: DataFrame) -> DataFrame:
    """Left-join observed-cell location ids onto the grid; NULL = masked."""
    return grid.join(loc_ids.select("cell_id", "loc_id"), "cell_id", "left")


def attach_dates(df: DataFrame, col_order: DataFrame, record_dates: DataFrame) -> DataFrame:
    """col_pos -> record_id -> obs_ts two-hop lookup.

    Both lookup tables have one row per time record; they are broadcast
    only after their size is measured."""
    co = maybe_broadcast(col_order.select("col_pos", "record_id"), col_order.count())
    rd = maybe_broadcast(record_dates.select("record_id", "obs_ts"), record_dates.count())
    return df.join(co, "col_pos").join(rd, "record_id", "left")


def expand_to_grid(u: DataFrame, grid: DataFrame, k: int, fill: float = FILL) -> DataFrame:
    """Observed per-location vectors -> every grid cell, fill elsewhere.

    ``u`` is wide ``(loc_id, vector[k])``; observed cells are left-joined to
    it on ``loc_id`` (no cross join), masked cells bypass the join, then each
    cell's k values are exploded.
    """
    # Masked cells (NULL loc_id, often a third of a grid) skip the join: in
    # a join they would all hash to one task.
    observed = grid.where(F.col("loc_id").isNotNull()).join(
        u.select(F.col("loc_id"), F.col("vector")), "loc_id", "left")
    masked = grid.where(F.col("loc_id").isNull()).withColumn("vector", F.lit(None).cast("array<double>"))
    j = observed.unionByName(masked)
    filled = F.coalesce(F.col("vector"), F.array_repeat(F.lit(None).cast("double"), k))
    j = j.select(*[c for c in grid.columns], F.posexplode(filled).alias("component", "value"))
    return j.withColumn("component", F.col("component").cast("int")).withColumn(
        "value", F.coalesce(F.col("value"), F.lit(fill)))
