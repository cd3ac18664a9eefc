"""The driver's star schema seen as cells, observations and granules; in DataFrames and, for checks, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.observations import observation_table
from .tables import read

#: The value of l_tax at which a cell's velocity is declared missing, and the sentinel that stands there.
MISSING = -32767.0


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell per line item: place, dates, missions, velocity with a declared missing value, and its error.

    Both dimension tables are joined on unique keys; Catalyst broadcasts them while they are small.
    """
    t = {n: read(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier", "part", "nation")}
    rows = (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .filter("o_orderdate <> l_shipdate")
    )
    raw = rows.select(
        F.concat(F.lit("cube"), F.col("n_regionkey").cast("string")).alias("cube_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("observation_index"),
        F.col("s_nationkey").cast("long").alias("x"),
        F.col("p_size").cast("long").alias("y"),
        F.least("o_orderdate", "l_shipdate").alias("date_img1"),
        F.greatest("o_orderdate", "l_shipdate").alias("date_img2"),
        F.when(F.col("l_linestatus") == "O", "S").otherwise("L").alias("mission_img1"),
        F.when(F.col("o_orderstatus") == "F", "L").otherwise("S").alias("mission_img2"),
        F.when(F.col("l_linestatus") == "O", "1A").otherwise("8").alias("satellite_img1"),
        F.when(F.col("o_orderstatus") == "O", "1B").when(F.col("o_orderstatus") == "F", "8").otherwise("2A").alias("satellite_img2"),
        F.when(F.col("l_returnflag") == "N", " c-sar").otherwise("OLI").alias("sensor_img1"),
        F.when(F.col("o_orderpriority") > "3", "C-SAR ").otherwise("oli").alias("sensor_img2"),
        F.when(F.col("l_quantity") < 40, F.concat_ws(":", "l_orderkey", "l_linenumber")).otherwise("").alias("image_pair_id"),
        F.when(F.col("l_tax") == 0, F.lit(MISSING)).otherwise(F.col("l_extendedprice")).alias("v"),
        (F.col("l_discount") * 100).alias("v_error"),
    )
    return observation_table(raw)


#: The same cells in SQL, to begin a query with.
CELLS_SQL = f"""
WITH raw AS (
  SELECT 'cube' || n_regionkey AS cube_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS observation_index,
    CAST(s_nationkey AS BIGINT) AS x, CAST(p_size AS BIGINT) AS y,
    least(o_orderdate, l_shipdate) AS date_img1, greatest(o_orderdate, l_shipdate) AS date_img2,
    CASE l_linestatus WHEN 'O' THEN 'SENTINEL-1' ELSE 'LANDSAT-8' END AS m1,
    CASE o_orderstatus WHEN 'O' THEN 'SENTINEL-1' WHEN 'F' THEN 'LANDSAT-8' ELSE 'SENTINEL-2' END AS m2,
    CASE l_linestatus WHEN 'O' THEN '1A' ELSE '8' END AS satellite_img1,
    CASE o_orderstatus WHEN 'O' THEN '1B' WHEN 'F' THEN '8' ELSE '2A' END AS satellite_img2,
    CASE WHEN l_returnflag = 'N' THEN 'C-SAR' ELSE 'OLI' END AS sensor_img1,
    CASE WHEN o_orderpriority > '3' THEN 'C-SAR' ELSE 'OLI' END AS sensor_img2,
    CASE WHEN l_quantity < 40 THEN l_orderkey || ':' || l_linenumber ELSE '' END AS image_pair_id,
    CASE WHEN l_tax = 0 THEN {MISSING} ELSE l_extendedprice END AS v, l_discount * 100 AS v_error
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey
  WHERE o_orderdate <> l_shipdate),
cells AS (
  SELECT *, make_timestamp((epoch_us(date_img1) + epoch_us(date_img2)) // 2) AS mid_date,
    (epoch_us(date_img2) - epoch_us(date_img1)) / 86400000000.0::DOUBLE AS pair_days,
    CASE WHEN m1 = m2 THEN m1 ELSE 'MIXED' END AS mission, m1 = m2 AS same_mission, v <> {MISSING} AS valid
  FROM raw)
"""

PLATFORMS = ("S1A", "s1b", "LC08", "LC8_OLI", "S2B", "LE07", "lt5")


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue record per event: every seventh platform, sizes that are missing, malformed or negative at times."""
    e = read(spark, sf_dir, "events")
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    return e.select(
        i.alias("item_id"),
        F.when(i % 11 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("datetime"),
        F.when(i % 22 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("mid_datetime"),
        F.element_at(F.array(*map(F.lit, PLATFORMS)), (i % 7 + 1).cast("int")).alias("platform"),
        F.when(i % 13 != 0, (F.col("user_id") - 75).cast("string")).otherwise("n/a").alias("pair_interval_days"),
        F.when(i % 17 != 0, k).alias("percent_valid_pixels"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 19 == 0, F.lit("3.0")).when(i % 23 == 0, F.lit("-5")).otherwise((F.col("value") * 1000).cast("long").cast("string")).alias("asset_size_bytes"),
        F.col("event_type"),
    )


GRANULES_SQL = f"""
WITH granules AS (
  SELECT event_id AS item_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS datetime, CASE WHEN event_id % 22 <> 0 THEN ts END AS mid_datetime,
    list_extract([{", ".join(f"'{p}'" for p in PLATFORMS)}], CAST(event_id % 7 + 1 AS INTEGER)) AS platform,
    CASE WHEN event_id % 13 <> 0 THEN CAST(user_id - 75 AS DOUBLE) END AS pair_days,
    CASE WHEN event_id % 17 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS valid_percent,
    CASE WHEN event_id % 5 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 THEN NULL ELSE CAST(trunc(value * 1000) AS BIGINT) END AS size,
    event_type
  FROM events)
"""
