"""The registered queries and, beside each, the same result in DuckDB SQL.

Every query runs over whole tables. Values that depend on the order of floating-point sums are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, mission, text
from .functions import time as dates
from .operators import coverage as cov
from .operators import inventory as inv
from .operators import mosaic as mos
from .operators import observations as obs
from .plans import footprints, inversion, runs
from .sources.fixtures import CELLS_SQL, GRANULES_SQL, MISSING, cells, granules
from .sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SELECT = obs.Selection("1996-01-01", "1999-12-31", mission="SENTINEL-1", most_days=365)
BOX = (2, 5, 12, 25)
SELECTED_SQL = "same_mission AND mission = 'SENTINEL-1' AND mid_date >= '1996-01-01' AND mid_date < '2000-01-01' AND pair_days <= 365"
BOX_SQL = "x BETWEEN 2 AND 12 AND y BETWEEN 5 AND 25"
POLYGON = [(1.0, 3.0), (15.0, 3.0), (20.0, 20.0), (10.0, 40.0), (4.0, 28.0), (1.0, 3.0)]
BINS = (12.0, 36.0, 96.0)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Places: every supplier's nation with every part's size, from distinct values alone."""
    x = read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("x")).distinct()
    y = read(spark, d, "part").select(F.col("p_size").cast("long").alias("y")).distinct()
    return y.crossJoin(x)  # the axes of a grid: its size is the grid's


PIXELS_SQL = "pixels AS (SELECT x, y FROM (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS x FROM supplier), (SELECT DISTINCT CAST(p_size AS BIGINT) AS y FROM part))"
COUNT_SQL = f"""{CELLS_SQL}, {PIXELS_SQL},
counts AS (SELECT y, x, count(*) AS n FROM cells WHERE {SELECTED_SQL} AND {BOX_SQL} AND valid GROUP BY y, x),
cover AS (SELECT p.y, p.x, CAST(coalesce(n, 0) AS BIGINT) AS valid_count FROM pixels p LEFT JOIN counts USING (y, x) WHERE {BOX_SQL.replace('x BETWEEN', 'p.x BETWEEN').replace('y BETWEEN', 'p.y BETWEEN')})"""


def _is_valid():
    return cov.valid([F.col("v")], [MISSING])


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return cov.coverage(obs.selected(cells(spark, d), SELECT), _pixels(spark, d), _is_valid(), cov.in_box(*BOX))


@query("coverage_count", f"{COUNT_SQL} SELECT y, x, valid_count FROM cover")
def coverage_count(spark, d):
    return _coverage(spark, d)


@query("coverage_fraction", f"{COUNT_SQL} SELECT y, x, valid_count, round(valid_count / (SELECT count(*)::DOUBLE FROM cells WHERE {SELECTED_SQL}), 10) AS valid_fraction FROM cover")
def coverage_fraction(spark, d):
    n = obs.selected(cells(spark, d), SELECT).agg(F.count("*").alias("n"))
    return cov.fraction(_coverage(spark, d), n).withColumn("valid_fraction", F.round("valid_fraction", 10))


STATISTICS_SQL = """CAST(count(*) AS BIGINT) AS pixel_count, min(valid_count) AS min_count, max(valid_count) AS max_count, round(avg(valid_count), 8) AS mean_count,
  CAST(quantile_cont(valid_count, 0.5) AS DOUBLE) AS median_count, CAST(quantile_cont(valid_count, 0.25) AS DOUBLE) AS p25_count, CAST(quantile_cont(valid_count, 0.75) AS DOUBLE) AS p75_count"""


@query("coverage_summary_stats", f"{COUNT_SQL} SELECT {STATISTICS_SQL} FROM cover")
def coverage_summary_stats(spark, d):
    return cov.statistics(_coverage(spark, d)).withColumn("mean_count", F.round("mean_count", 8))


@query("coverage_thresholds", f"{COUNT_SQL} SELECT " + ", ".join(f"round(avg(CASE WHEN valid_count >= {t} THEN 1.0 ELSE 0.0 END), 10) AS share_ge_{t}" for t in cov.THRESHOLDS) + " FROM cover")
def coverage_thresholds(spark, d):
    s = cov.shares(_coverage(spark, d))
    return s.select(*[F.round(c, 10).alias(c) for c in s.columns])


@query("mission_inventory", f"{CELLS_SQL} SELECT mission, count(*) AS n_observations FROM cells WHERE mid_date >= '1996-01-01' AND mid_date < '2000-01-01' GROUP BY mission")
def mission_inventory(spark, d):
    return obs.mission_inventory(cells(spark, d), SELECT.start, SELECT.end)


FUNNEL = obs.Selection("1996-01-01", "1999-12-31T12:00:00", mission="LANDSAT", sensor="oli", least_days=30, most_days=700)


@query(
    "filter_funnel",
    f"""{CELLS_SQL}, f AS (SELECT mid_date >= '1996-01-01' AND mid_date <= '1999-12-31 12:00:00' AS a, same_mission AND mission LIKE 'LANDSAT-%' AS b,
    sensor_img1 = 'OLI' AND sensor_img2 = 'OLI' AS c, pair_days BETWEEN 30 AND 700 AS e FROM cells)
    SELECT count(*) AS observations_in_cube, count(*) FILTER (a) AS within_time_range, count(*) FILTER (a AND b) AS matching_mission,
    count(*) FILTER (a AND b AND c) AS matching_sensor, count(*) FILTER (a AND b AND c AND e) AS matching_pair_duration FROM f""",
)
def filter_funnel(spark, d):
    return obs.funnel(cells(spark, d), FUNNEL)


@query("observation_table", f"{CELLS_SQL} SELECT cube_id, observation_index, y, x, mid_date, date_img1, date_img2, pair_days, m1 AS mission_img1_normalized, m2 AS mission_img2_normalized, mission, same_mission FROM cells")
def observation_table(spark, d):
    return cells(spark, d).select("cube_id", "observation_index", "y", "x", "mid_date", "date_img1", "date_img2", "pair_days", "mission_img1_normalized", "mission_img2_normalized", "mission", "same_mission")


RAW_MISSIONS = ("S1", "sentinel 1", "Sentinel-1", " l8 ", "LANDSAT 8", "landsat_9", "L7", "LANDSAT", "S2", "sentinel2", "ENVISAT", "--ers  2--", "Landsat-4", "Landsat 6")
NAMED_MISSIONS = ("SENTINEL-1", "SENTINEL-1", "SENTINEL-1", "LANDSAT-8", "LANDSAT-8", "LANDSAT-9", "LANDSAT-7", "LANDSAT", "SENTINEL-2", "SENTINEL-2", "ENVISAT", "ERS-2", "LANDSAT-4", "LANDSAT-6")


def _picked(values: tuple, n: int):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % n + 1).cast("int"))


def _listed(values: tuple, n: int) -> str:
    return "list_extract([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"], CAST(p_partkey % {n} + 1 AS INTEGER))"


@query(
    "mission_normalize",
    f"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 15 = 14 THEN NULL ELSE {_listed(RAW_MISSIONS + ('',), 15)} END AS raw FROM part),
    s AS (SELECT p_partkey, raw, trim(regexp_replace(upper(trim(raw)), '[^A-Z0-9]+', '-', 'g'), '-') AS s FROM r)
    SELECT p_partkey, raw, CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s IN ('S1', 'SENTINEL1') THEN 'SENTINEL-1' WHEN s IN ('S2', 'SENTINEL2') THEN 'SENTINEL-2'
      WHEN regexp_matches(s, '^L[45789]$') THEN 'LANDSAT-' || s[2] WHEN regexp_matches(s, '^LANDSAT-?[45789]$') THEN 'LANDSAT-' || right(s, 1) ELSE s END AS mission FROM s""",
)
def mission_normalize(spark, d):
    raw = F.when(F.col("p_partkey") % 15 == 14, F.lit(None)).otherwise(_picked((*RAW_MISSIONS, ""), 15))
    return read(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("mission", mission.normalize_mission(F.col("raw")))


PAIR_CODES = (("S", "1A"), ("S", "2b"), ("L", "8"), ("L", "x"), ("LANDSAT", "9"), ("sentinel", "1"), (None, "l7"), (None, ""), ("S", "3A"), ("ENVISAT", "1A"), ("Sentinel-1", "2A"))
PAIR_NAMES = ("SENTINEL-1", "SENTINEL-2", "LANDSAT-8", "LANDSAT", "LANDSAT-9", "SENTINEL-1", "LANDSAT-7", "UNKNOWN", "S", "ENVISAT", "SENTINEL-1")


@query("pair_mission_normalize", f"SELECT p_partkey, {_listed(PAIR_NAMES, 11)} AS mission FROM part")
def pair_mission_normalize(spark, d):
    m, s = (_picked(tuple(c[i] for c in PAIR_CODES), 11) for i in (0, 1))
    return read(spark, d, "part").select("p_partkey", mission.normalize_pair_mission(m, s).alias("mission"))


@query("sensor_filter", f"{CELLS_SQL} SELECT cube_id, count(*) AS n_observations FROM cells WHERE mid_date >= '1995-01-01' AND mid_date < '2002-01-01' AND sensor_img1 = 'C-SAR' AND sensor_img2 = 'C-SAR' GROUP BY cube_id")
def sensor_filter(spark, d):
    s = obs.Selection("1995-01-01", "2001-12-31", sensor=" c-sar")
    return obs.selected(cells(spark, d), s).groupBy("cube_id").agg(F.count("*").alias("n_observations"))


@query("pair_duration_range", f"{CELLS_SQL} SELECT mission, count(*) AS n_observations, min(pair_days) AS min_days, max(pair_days) AS max_days FROM cells WHERE mid_date >= '1995-01-01' AND mid_date < '2002-01-01' AND pair_days BETWEEN 12 AND 96 GROUP BY mission")
def pair_duration_range(spark, d):
    s = obs.Selection("1995-01-01", "2001-12-31", least_days=12, most_days=96)
    return obs.selected(cells(spark, d), s).groupBy("mission").agg(F.count("*").alias("n_observations"), F.min("pair_days").alias("min_days"), F.max("pair_days").alias("max_days"))


BIN_SQL = "CASE WHEN pair_days <= 12 THEN 0 WHEN pair_days <= 36 THEN 1 WHEN pair_days <= 96 THEN 2 ELSE 3 END"
GROUPS = ("LANDSAT", "SENTINEL-1", "SENTINEL-2")
GROUP_SQL = "CASE WHEN mission LIKE 'LANDSAT-%' THEN 'LANDSAT' ELSE mission END"
FRAME_SQL = "frame AS (SELECT * FROM (VALUES ('LANDSAT'), ('SENTINEL-1'), ('SENTINEL-2')) m(mission_group), (VALUES (0), (1), (2), (3)) b(duration_bin))"


def _frame(spark: SparkSession) -> DataFrame:
    """All missions with all bins: constants, so cells without observations keep a row."""
    return spark.createDataFrame([(g, b) for g in GROUPS for b in range(len(BINS) + 1)], "mission_group string, duration_bin int")


def _binned(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).filter("same_mission")
    return rows.withColumn("mission_group", F.when(F.col("mission").startswith("LANDSAT-"), "LANDSAT").otherwise(F.col("mission"))).withColumn("duration_bin", cov.duration_bin(F.col("pair_days"), BINS))


@query("duration_bins_by_mission", f"{CELLS_SQL}, {FRAME_SQL}, n AS (SELECT {GROUP_SQL} AS mission_group, {BIN_SQL} AS duration_bin, count(*) AS n FROM cells WHERE same_mission GROUP BY ALL) SELECT mission_group, duration_bin, CAST(coalesce(n, 0) AS BIGINT) AS selected_observations FROM frame LEFT JOIN n USING (mission_group, duration_bin)")
def duration_bins_by_mission(spark, d):
    n = _binned(spark, d).groupBy("mission_group", "duration_bin").agg(F.count("*").alias("n"))
    return _frame(spark).join(n, ["mission_group", "duration_bin"], "left").select("mission_group", "duration_bin", F.coalesce("n", F.lit(0)).cast("long").alias("selected_observations"))


@query(
    "duration_comparison_map",
    f"""{CELLS_SQL}, {FRAME_SQL}, {PIXELS_SQL},
    c AS (SELECT {GROUP_SQL} AS mission_group, {BIN_SQL} AS duration_bin, y, x, count(*) FILTER (valid) AS n FROM cells WHERE same_mission AND {BOX_SQL} GROUP BY ALL),
    g AS (SELECT mission_group, duration_bin, y, x, CAST(coalesce(n, 0) AS BIGINT) AS valid_count
      FROM (SELECT * FROM frame, pixels WHERE {BOX_SQL}) LEFT JOIN c USING (mission_group, duration_bin, y, x))
    SELECT mission_group, duration_bin, {STATISTICS_SQL} FROM g GROUP BY mission_group, duration_bin""",
)
def duration_comparison_map(spark, d):
    """All maps from one pass: counts by mission, bin and pixel, then statistics over the full grid of each."""
    region = cov.in_box(*BOX)
    n = _binned(spark, d).filter(region & _is_valid()).groupBy("mission_group", "duration_bin", "y", "x").agg(F.count("*").alias("n"))
    grid = _pixels(spark, d).filter(region).crossJoin(F.broadcast(_frame(spark)))
    full = grid.join(n, ["mission_group", "duration_bin", "y", "x"], "left").withColumn("valid_count", F.coalesce("n", F.lit(0)).cast("long"))
    return cov.statistics(full, ["mission_group", "duration_bin"]).withColumn("mean_count", F.round("mean_count", 8))


@query("validity_declared_missing", f"{CELLS_SQL} SELECT cube_id, count(*) AS n_cells, count(*) FILTER (valid) AS n_valid FROM cells GROUP BY cube_id")
def validity_declared_missing(spark, d):
    return cells(spark, d).groupBy("cube_id").agg(F.count("*").alias("n_cells"), F.count_if(_is_valid()).alias("n_valid"))


@query("roi_box_mask", f"WITH {PIXELS_SQL} SELECT y, x, ({BOX_SQL}) AS in_region FROM pixels")
def roi_box_mask(spark, d):
    return _pixels(spark, d).select("y", "x", cov.in_box(*BOX).alias("in_region"))


def _polygon_sql() -> str:
    sides = [f"(({x1 - x0}) * (y - ({y0})) - ({y1 - y0}) * (x - ({x0})) >= 0)" for (x0, y0), (x1, y1) in zip(POLYGON, POLYGON[1:], strict=False)]
    return " AND ".join(sides)


@query("roi_polygon_mask", f"WITH {PIXELS_SQL} SELECT y, x FROM pixels WHERE {_polygon_sql()}")
def roi_polygon_mask(spark, d):
    p = _pixels(spark, d)
    return p.filter(geo.in_rings(F.col("x").cast("double"), F.col("y").cast("double"), [POLYGON]))


@query("full_grid_zero_fill", f"{CELLS_SQL}, {PIXELS_SQL}, n AS (SELECT y, x, count(*) AS n FROM cells WHERE pair_days <= 12 AND valid GROUP BY y, x) SELECT y, x, CAST(coalesce(n, 0) AS BIGINT) AS valid_count FROM pixels LEFT JOIN n USING (y, x)")
def full_grid_zero_fill(spark, d):
    return cov.coverage(cells(spark, d).filter("pair_days <= 12"), _pixels(spark, d), _is_valid(), F.lit(True))


KEY_SQL = f"""{CELLS_SQL}, keyed AS (SELECT *, CASE WHEN trim(image_pair_id) <> '' THEN trim(image_pair_id) ELSE 'metadata:' ||
  strftime(mid_date, '%Y-%m-%d %H:%M:%S') || '|' || strftime(date_img1, '%Y-%m-%d %H:%M:%S') || '|' || strftime(date_img2, '%Y-%m-%d %H:%M:%S') || '|' ||
  pair_days || '|' || m1 || '|' || m2 || '|' || satellite_img1 || '|' || satellite_img2 END AS observation_key FROM cells)"""
DEDUP_SQL = f"""{KEY_SQL}, dedup AS (SELECT observation_key, min(struct_pack(a := cube_id, b := observation_index)) AS f, CAST(count(DISTINCT cube_id) AS BIGINT) AS cube_count,
  array_to_string(list_sort(list_distinct(list(cube_id))), ';') AS cube_ids,
  '[' || array_to_string(['{{"cube_id":"' || s.a || '","observation_index":' || s.b || '}}' FOR s IN list_sort(list(struct_pack(a := cube_id, b := observation_index)))], ',') || ']' AS cube_observations
  FROM keyed GROUP BY observation_key)"""


@query("observation_dedup", f"{DEDUP_SQL} SELECT observation_key, f.a AS source_cube_id, f.b AS observation_index, cube_count, cube_ids, cube_observations FROM dedup")
def observation_dedup(spark, d):
    return obs.deduplicated(cells(spark, d))


@query("observation_cube_nunique", f"{KEY_SQL}, n AS (SELECT observation_key, count(DISTINCT cube_id) AS cube_count FROM keyed GROUP BY observation_key) SELECT cube_id, cube_count, count(*) AS n_observations FROM keyed JOIN n USING (observation_key) GROUP BY cube_id, cube_count")
def observation_cube_nunique(spark, d):
    return obs.cubes_per_key(cells(spark, d)).groupBy("cube_id", "cube_count").agg(F.count("*").alias("n_observations"))


PLACES_SQL = f"{KEY_SQL}, places AS (SELECT cube_id, observation_index, min(observation_key) AS observation_key FROM keyed GROUP BY cube_id, observation_index)"


@query("replay_explode_json", f"{PLACES_SQL} SELECT cube_id, observation_index, observation_key FROM places")
def replay_explode_json(spark, d):
    return obs.replay_places(obs.deduplicated(cells(spark, d)))


@query(
    "replay_validate",
    f"""{PLACES_SQL}, own AS (SELECT cube_id, observation_index, min(observation_key) AS lo, max(observation_key) AS hi FROM keyed WHERE y <= 40 GROUP BY ALL)
    SELECT cube_id, count(*) AS requested, count(lo) AS found, count(*) FILTER (lo IS NULL) AS out_of_range,
    count(*) FILTER (lo IS NOT NULL AND NOT observation_key BETWEEN lo AND hi) AS mismatched FROM places LEFT JOIN own USING (cube_id, observation_index) GROUP BY cube_id""",
)
def replay_validate(spark, d):
    c = cells(spark, d)
    return obs.replay_check(obs.replay_places(obs.deduplicated(c)), c.filter("y <= 40"))


@query("missing_anti_join", "SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_anti_join(spark, d):
    o = read(spark, d, "orders")
    expected = o.select(F.col("o_custkey").alias("custkey")).distinct()
    return expected.join(o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")), "custkey", "left_anti")


SIZES_SQL = """s AS (SELECT event_type, count(*) AS asset_count, count(size) AS known_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS known_bytes, CAST(trunc(quantile_cont(size, 0.5)) AS BIGINT) AS median_bytes FROM granules GROUP BY event_type)"""


@query("inventory_size_summary", f"{GRANULES_SQL}, {SIZES_SQL} SELECT event_type, asset_count, known_count, known_bytes, median_bytes, known_bytes + (asset_count - known_count) * median_bytes AS estimated_bytes FROM s")
def inventory_size_summary(spark, d):
    return inv.size_summary(granules(spark, d), ["event_type"]).select("event_type", "asset_count", "known_count", "known_bytes", "median_bytes", "estimated_bytes")


@query("inventory_valid_percent_stats", f"{GRANULES_SQL} SELECT count(*) AS n_records, count(valid_percent) AS n_known, min(valid_percent) AS min_percent, CAST(median(valid_percent) AS DOUBLE) AS median_percent, max(valid_percent) AS max_percent, array_to_string(list_sort(list_distinct(list(platform))), ',') AS platforms FROM granules")
def inventory_valid_percent_stats(spark, d):
    p = F.col("percent_valid_pixels").try_cast("double")
    return granules(spark, d).agg(
        F.count("*").alias("n_records"), F.count(p).alias("n_known"), F.min(p).alias("min_percent"), F.percentile(p, 0.5).alias("median_percent"), F.max(p).alias("max_percent"),
        F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"),
    )


@query(
    "inventory_platform_filter",
    f"""{GRANULES_SQL} SELECT item_id, platform FROM granules WHERE coalesce(datetime, mid_datetime) >= '2024-01-05' AND coalesce(datetime, mid_datetime) < '2024-01-21'
    AND regexp_matches(upper(platform), '^L[CETOM]') AND abs(pair_days) <= 40 AND valid_percent >= 25""",
)
def inventory_platform_filter(spark, d):
    return inv.matching(granules(spark, d), "2024-01-05", "2024-01-20", "LANDSAT", most_days=40, least_valid=25).select("item_id", "platform")


@query("asset_coalesce", "SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), nullif(regexp_extract(url, '#([a-z]+)', 1), ''), 'none') AS chosen FROM pages")
def asset_coalesce(spark, d):
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return read(spark, d, "pages").select("page_id", F.coalesce(part("[?&]page=([0-9]+)"), part("#([a-z]+)"), F.lit("none")).alias("chosen"))


@query(
    "human_bytes",
    """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(round(o_totalprice) AS BIGINT) * (1 + (o_orderkey % 9) * (o_orderkey % 9) * 1000) END AS n FROM orders),
    p AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM b), q AS (SELECT *, n / pow(1024.0::DOUBLE, k) AS v FROM p)
    SELECT o_orderkey, CASE WHEN n IS NULL THEN 'unknown' WHEN k = 0 OR v >= 100 THEN printf('%.0f', v) WHEN v >= 10 THEN printf('%.1f', v) ELSE printf('%.2f', v) END ||
    CASE WHEN n IS NULL THEN '' ELSE ' ' || list_extract(['B', 'KiB', 'MiB', 'GiB', 'TiB'], k + 1) END AS size FROM q""",
)
def human_bytes(spark, d):
    n = F.round("o_totalprice").cast("long") * (1 + (F.col("o_orderkey") % 9) * (F.col("o_orderkey") % 9) * 1000)
    n = F.when(F.col("o_orderkey") % 50 != 0, n)
    return read(spark, d, "orders").select("o_orderkey", text.human_bytes(n).alias("size"))


@query("url_filename", "SELECT page_id, CASE WHEN n <> '' THEN n ELSE page_id || '.nc' END AS name FROM (SELECT page_id, regexp_extract(rtrim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/'), '([^/]*)$', 1) AS n FROM pages)")
def url_filename(spark, d):
    return read(spark, d, "pages").select("page_id", text.destination_name(F.col("page_id"), F.col("url")).alias("name"))


@query("content_range_total", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE CAST(trunc(value * 100) AS BIGINT) END AS total FROM events")
def content_range_total(spark, d):
    known = F.concat(F.lit("bytes 0-0/"), (F.col("value") * 100).cast("long").cast("string"), F.lit(" "))
    header = F.when(F.col("event_id") % 4 == 0, F.lit("bytes 0-0/*")).otherwise(known)
    return read(spark, d, "events").select("event_id", F.coalesce(text.content_range_total(header), F.lit(-1)).cast("long").alias("total"))


@query(
    "scene_pair_extract",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_scenes, 'S1B_IW_SLC__1SSH_' || strftime(o_orderdate, '%Y%m%d') AS first_scene FROM orders""",
)
def scene_pair_extract(spark, d):
    def scene(day):
        return F.concat(F.lit("S1B_IW_SLC__1SSH_"), F.date_format(day, "yyyyMMdd"), F.lit("T101112_"), F.date_format(day, "yyyyMMdd"), F.lit("T101139_025012_02FA3C_B1C2"))

    two = F.concat(scene("o_orderdate"), F.lit("_X_"), scene(F.date_add("o_orderdate", 12)), F.lit("_G0120V02_P094.nc"))
    pair = F.when(F.col("o_orderkey") % 10 == 0, scene("o_orderdate")).otherwise(two)
    found = read(spark, d, "orders").select("o_orderkey", mission.scenes(pair).alias("s"))
    return found.select("o_orderkey", F.size("s").alias("n_scenes"), F.substring(F.get("s", F.lit(0)), 1, 25).alias("first_scene"))


@query("orbit_direction", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 2 ELSE 3 END AS TINYINT) AS orbit FROM lineitem")
def orbit_direction(spark, d):
    first = F.when(F.col("l_returnflag") == "A", " ASCENDING").when(F.col("l_returnflag") == "N", "desc")
    second = F.when(F.col("l_linestatus") == "F", "asc").otherwise("Descending")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", mission.orbit_direction(first, second).alias("orbit"))


#: Half-open boxes with an overlap: the later id owns it.
TILES = (("t0", 0.0, 0.0, 6.0, 60.0), ("t1", 5.0, 0.0, 10.0, 60.0), ("t2", 10.0, 0.0, 15.0, 30.0), ("t3", 10.0, 25.0, 15.0, 60.0), ("t4", 15.0, 0.0, 25.0, 60.0))
TILES_SQL = "tiles(tile_id, xmin, ymin, xmax, ymax) AS (VALUES " + ", ".join(f"('{t[0]}', {t[1]}, {t[2]}, {t[3]}, {t[4]})" for t in TILES) + ")"
OWNED_SQL = "owned AS (SELECT y, x, max(tile_id) AS tile_id FROM pixels JOIN tiles ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax GROUP BY y, x)"


def _tiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TILES), "tile_id string, xmin double, ymin double, xmax double, ymax double")


@query("tile_ownership_mosaic", f"WITH {PIXELS_SQL}, {TILES_SQL}, {OWNED_SQL} SELECT y, x, tile_id FROM owned")
def tile_ownership_mosaic(spark, d):
    return mos.owned(_pixels(spark, d), _tiles(spark), 5.0)


NEAREST_SQL = "spot AS (SELECT y, x, tile_id, least(greatest(CAST(round_even((x - xmin - 0.9) / 1.8, 0) AS BIGINT), 0), 3) AS col, least(greatest(CAST(round_even((y - ymin - 1.3) / 2.6, 0) AS BIGINT), 0), 19) AS row FROM owned JOIN tiles USING (tile_id))"


@query("nearest_sample_mosaic", f"""{CELLS_SQL}, {PIXELS_SQL}, {TILES_SQL}, {OWNED_SQL}, {NEAREST_SQL}, src AS (SELECT 't' || (x % 5) AS tile_id, y % 20 AS row, x % 4 AS col, count(*) FILTER (valid) AS value FROM cells GROUP BY ALL)
    SELECT spot.y, spot.x, tile_id, row, col, value FROM spot LEFT JOIN src USING (tile_id, row, col)""")
def nearest_sample_mosaic(spark, d):
    source = cells(spark, d).groupBy(F.concat(F.lit("t"), (F.col("x") % 5).cast("string")).alias("tile_id"), (F.col("y") % 20).alias("row"), (F.col("x") % 4).alias("col")).agg(F.count_if(_is_valid()).alias("value"))
    shape = _tiles(spark).select("tile_id", (F.col("xmin") + 0.9).alias("x0"), (F.col("ymin") + 1.3).alias("y0"), F.lit(1.8).alias("dx"), F.lit(2.6).alias("dy"), F.lit(4).alias("nx"), F.lit(20).alias("ny"))
    return mos.sampled(tile_ownership_mosaic(spark, d), shape, source)


@query("smallest_container_top1", "WITH c AS (SELECT 'c' || s_suppkey AS cube_id, -(s_suppkey % 7)::DOUBLE AS xmin, -(s_suppkey % 5)::DOUBLE AS ymin, 20.0 + s_suppkey % 11 AS xmax, 30.0 + s_suppkey % 3 AS ymax FROM supplier), a AS (SELECT *, (xmax - xmin) * (ymax - ymin) AS area FROM c WHERE xmin <= 0 AND ymin <= -1 AND xmax >= 22 AND ymax >= 30), m AS (SELECT min(area) AS least FROM a) SELECT min(cube_id) AS cube_id, CAST(min(area) AS DOUBLE) AS area, count(*) AS tied FROM a, m WHERE abs(area - least) <= 1e-9 * greatest(abs(area), abs(least))")
def smallest_container_top1(spark, d):
    k = F.col("s_suppkey")
    cubes = read(spark, d, "supplier").select(F.concat(F.lit("c"), k.cast("string")).alias("cube_id"), (-(k % 7)).cast("double").alias("xmin"), (-(k % 5)).cast("double").alias("ymin"), (F.lit(20.0) + k % 11).alias("xmax"), (F.lit(30.0) + k % 3).alias("ymax"))
    return mos.smallest_container(cubes, 0, -1, 22, 30)


@query("time_sorted_stack", 'SELECT user_id AS "group", event_id AS name, ts AS time, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS time_index FROM events')
def time_sorted_stack(spark, d):
    return runs.stack(read(spark, d, "events").select(F.col("user_id").alias("group"), F.col("event_id").alias("name"), F.col("ts").alias("time")))


@query(
    "resample_bilinear",
    f"""{CELLS_SQL}, src AS (SELECT x AS ix, y AS iy, CAST(count(*) FILTER (valid) AS DOUBLE) AS value FROM cells GROUP BY ALL),
    t AS (SELECT p_partkey AS target_id, (p_partkey % 97) / 4.0::DOUBLE AS fx, (p_partkey % 211) / 4.0::DOUBLE AS fy FROM part),
    k AS (SELECT target_id, CAST(floor(fx) AS BIGINT) + i AS ix, CAST(floor(fy) AS BIGINT) + j AS iy, (CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w
      FROM t, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
    SELECT target_id, CASE WHEN count(value) = count(*) THEN round(sum(w * value), 8) END AS value FROM k LEFT JOIN src USING (ix, iy) WHERE w > 0 GROUP BY target_id""",
)
def resample_bilinear(spark, d):
    source = cells(spark, d).groupBy(F.col("x").alias("ix"), F.col("y").alias("iy")).agg(F.count_if(_is_valid()).cast("double").alias("value"))
    k = F.col("p_partkey")
    targets = read(spark, d, "part").select(k.alias("target_id"), ((k % 97) / F.lit(4.0)).alias("fx"), ((k % 211) / F.lit(4.0)).alias("fy"))
    return mos.bilinear(targets, source).withColumn("value", F.round("value", 8))


def _opportunity(spark: SparkSession, d: str) -> DataFrame:
    """Footprints are boxes by supplier; a pair is two neighbouring ones."""
    k = F.col("s_suppkey")
    x0, y0 = (k % 18).cast("double"), (k % 37).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(x0, y0), corner(x0 + 6, y0), corner(x0 + 6, y0 + 9), corner(x0, y0 + 9), corner(x0, y0))
    s = read(spark, d, "supplier")
    scenes = s.select(k.cast("string").alias("scene"), ring.alias("ring"))
    pairs = s.select(F.concat_ws("-", k, k + 1).alias("pair_id"), k.cast("string").alias("scene1"), (k + 1).cast("string").alias("scene2"))
    return footprints.opportunities(footprints.pair_overlaps(pairs, scenes), _pixels(spark, d), 1.5, 8.0)


OPPORTUNITY_SQL = f"""b AS (SELECT s_suppkey AS k, (s_suppkey % 18)::DOUBLE AS x0, (s_suppkey % 37)::DOUBLE AS y0 FROM supplier),
  o AS (SELECT greatest(p.x0, q.x0) AS xa, least(p.x0, q.x0) + 6 AS xb, greatest(p.y0, q.y0) AS ya, least(p.y0, q.y0) + 9 AS yb FROM b p JOIN b q ON q.k = p.k + 1),
  opp AS (SELECT y, x, count(*) AS opportunity_count FROM pixels JOIN o ON xa <= xb AND ya <= yb
    AND pow(greatest(xa - x, x - xb, 0), 2) + pow(greatest(ya - y, y - yb, 0), 2) <= 2.25 GROUP BY y, x)"""


@query("opportunity_count", f"WITH {PIXELS_SQL}, {OPPORTUNITY_SQL} SELECT y, x, opportunity_count FROM opp")
def opportunity_count(spark, d):
    return _opportunity(spark, d)


@query("opportunity_violations", f"{COUNT_SQL}, {OPPORTUNITY_SQL} SELECT count(*) AS pixels, count(*) FILTER (valid_count > coalesce(opportunity_count, 0)) AS violations, CAST(max(valid_count - coalesce(opportunity_count, 0)) AS BIGINT) AS max_excess, CAST(sum(coalesce(opportunity_count, 0)) AS BIGINT) AS opportunities FROM cover LEFT JOIN opp USING (y, x)")
def opportunity_violations(spark, d):
    return footprints.violations(_coverage(spark, d), _opportunity(spark, d))


YEAR_SQL = "(year({0}) + (epoch_us({0}) - epoch_us(make_timestamp(year({0}), 1, 1, 0, 0, 0.0)))::DOUBLE / (epoch_us(make_timestamp(year({0}) + 1, 1, 1, 0, 0, 0.0)) - epoch_us(make_timestamp(year({0}), 1, 1, 0, 0, 0.0)))::DOUBLE)"


@query("decimal_year", f"SELECT event_id, round({YEAR_SQL.format('ts')}, 9) AS decimal_year FROM events")
def decimal_year(spark, d):
    return read(spark, d, "events").select("event_id", F.round(dates.decimal_year(F.col("ts")), 9).alias("decimal_year"))


#: Template times: steps of a twelfth of a year, from 1995 to 2003.
TEMPLATE_SQL = """template AS (SELECT t, (t - 1998) AS g1, (t - 1998) * (t - 1998) AS g2 FROM (SELECT DISTINCT 1995 + i / 12.0::DOUBLE AS t FROM range(0, 97) r(i)))"""
TEMPLATE_YEARS = [1995 + i / 12.0 for i in range(97)]


def _template(spark: SparkSession, degree: int = 2) -> DataFrame:
    return inversion.build_template(spark, TEMPLATE_YEARS, degree, reference=1998.0)


def _columns(df: DataFrame, k: int, digits: int = 9) -> DataFrame:
    return df.select(F.round("t", 9).alias("t"), *[(F.round(F.get("g", F.lit(i)), digits) + 0.0).alias(f"g{i}") for i in range(k)])


CUMULATIVE_SQL = f"""{TEMPLATE_SQL}, s AS (SELECT t, coalesce((t - lag(t) OVER w), 0) AS s0, coalesce(0.5 * (g1 + lag(g1) OVER w) * (t - lag(t) OVER w), 0) AS s1, coalesce(0.5 * (g2 + lag(g2) OVER w) * (t - lag(t) OVER w), 0) AS s2 FROM template WINDOW w AS (ORDER BY t)),
  cum AS (SELECT t, sum(s0) OVER v AS g0, sum(s1) OVER v AS g1, sum(s2) OVER v AS g2 FROM s WINDOW v AS (ORDER BY t))"""


@query("template_cumulative_trapezoid", f"WITH {CUMULATIVE_SQL} SELECT round(t, 9) AS t, round(g0, 9) + 0.0 AS g0, round(g1, 9) + 0.0 AS g1, round(g2, 9) + 0.0 AS g2 FROM cum")
def template_cumulative_trapezoid(spark, d):
    return _columns(inversion.cumulative(_template(spark)), 3)


@query("template_gradient", f"WITH {TEMPLATE_SQL} SELECT round(t, 9) AS t, 0.0::DOUBLE AS g0, 1.0::DOUBLE AS g1, round(2 * (t - 1998), 6) + 0.0 AS g2 FROM template")
def template_gradient(spark, d):
    """A second-order rule is exact for a quadratic, at the ends too."""
    g = inversion.gradient(_template(spark))
    tidy = lambda i, n: (F.round(F.get("g", F.lit(i)), n) + 0.0).alias(f"g{i}")
    return g.select(F.round("t", 9).alias("t"), tidy(0, 6), tidy(1, 6), tidy(2, 6))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d).filter("pair_days <= 365")
    return rows.withColumn("t1", dates.decimal_year(F.col("date_img1"))).withColumn("t2", dates.decimal_year(F.col("date_img2")))


DATED_SQL = f"dated AS (SELECT *, {YEAR_SQL.format('date_img1')} AS t1, {YEAR_SQL.format('date_img2')} AS t2 FROM cells WHERE pair_days <= 365)"


def _at_sql(source: str, query_: str, name: str, k: tuple[str, ...]) -> str:
    """An as-of join with linear interpolation between a time's two neighbours."""
    values = ", ".join(f"a.{g} + (a.n{g} - a.{g}) * (q.q - a.t) / (a.nt - a.t) AS {name}_{g}" for g in k)
    lead = ", ".join(f"lead({g}) OVER (ORDER BY t) AS n{g}" for g in k)
    return f"""{name}_b AS (SELECT * FROM (SELECT t, lead(t) OVER (ORDER BY t) AS nt, {", ".join(k)}, {lead} FROM {source}) WHERE nt IS NOT NULL),
  {name} AS (SELECT q.q, {values} FROM (SELECT DISTINCT {query_} AS q FROM dated) q ASOF JOIN {name}_b a ON q.q >= a.t)"""


def _design(spark: SparkSession, d: str, operator: str) -> DataFrame:
    made = inversion.design(_dated(spark, d), _template(spark), operator)
    return made.select("cube_id", "observation_index", "y", "x", *[(F.round(F.get("g", F.lit(i)), 9) + 0.0).alias(f"g{i}") for i in (1, 2)])


@query("design_midpoint", f"{CELLS_SQL}, {DATED_SQL}, {TEMPLATE_SQL}, {_at_sql('template', '0.5 * (t1 + t2)', 'm', ('g1', 'g2'))} SELECT cube_id, observation_index, y, x, round(m_g1, 9) + 0.0 AS g1, round(m_g2, 9) + 0.0 AS g2 FROM dated JOIN m ON m.q = 0.5 * (t1 + t2)")
def design_midpoint(spark, d):
    return _design(spark, d, "midpoint")


@query("design_interval_average", f"{CELLS_SQL}, {DATED_SQL}, {CUMULATIVE_SQL}, {_at_sql('cum', 't1', 'a', ('g1', 'g2'))}, {_at_sql('cum', 't2', 'b', ('g1', 'g2'))} SELECT cube_id, observation_index, y, x, round((b_g1 - a_g1) / (t2 - t1), 9) + 0.0 AS g1, round((b_g2 - a_g2) / (t2 - t1), 9) + 0.0 AS g2 FROM dated JOIN a ON a.q = t1 JOIN b ON b.q = t2")
def design_interval_average(spark, d):
    return _design(spark, d, "interval-average")


@query("design_endpoint_difference", f"{CELLS_SQL}, {DATED_SQL}, {TEMPLATE_SQL}, {_at_sql('template', 't1', 'a', ('g1', 'g2'))}, {_at_sql('template', 't2', 'b', ('g1', 'g2'))} SELECT cube_id, observation_index, y, x, round((b_g1 - a_g1) / (t2 - t1), 9) + 0.0 AS g1, round((b_g2 - a_g2) / (t2 - t1), 9) + 0.0 AS g2 FROM dated JOIN a ON a.q = t1 JOIN b ON b.q = t2")
def design_endpoint_difference(spark, d):
    return _design(spark, d, "endpoint-difference")


def _weighted(spark: SparkSession, d: str, degree: int) -> DataFrame:
    rows = inversion.design(_dated(spark, d), _template(spark, degree), "midpoint")
    return rows.select("y", "x", "g", F.greatest(F.abs("v_error"), F.lit(1.0)).alias("sigma"), _is_valid().alias("valid"))


NORMAL_SQL = f"""{CELLS_SQL}, {DATED_SQL}, {TEMPLATE_SQL}, {_at_sql('template', '0.5 * (t1 + t2)', 'm', ('g1', 'g2'))},
  w AS (SELECT y, x, 1 / pow(greatest(abs(v_error), 1.0), 2) AS w, m_g1 AS g1, m_g2 AS g2 FROM dated JOIN m ON m.q = 0.5 * (t1 + t2) WHERE valid),
  nm AS (SELECT y, x, count(*) AS n, sum(w) AS a, sum(w * g1) AS b, sum(w * g2) AS e, sum(w * g1 * g1) AS c, sum(w * g1 * g2) AS f, sum(w * g2 * g2) AS h FROM w GROUP BY y, x)"""


@query("normal_matrix", f"{NORMAL_SQL} SELECT y, x, n AS usable_observation_count, round(a, 6) AS m_0_0, round(b, 6) + 0.0 AS m_0_1, round(e, 6) AS m_0_2, round(c, 6) AS m_1_1, round(f, 6) + 0.0 AS m_1_2, round(h, 6) AS m_2_2 FROM nm")
def normal_matrix(spark, d):
    m = inversion.normal_matrix(_weighted(spark, d, 2), 3)
    return m.select("y", "x", "usable_observation_count", *[(F.round(c, 6) + 0.0).alias(c) for c in m.columns if c.startswith("m_")])


PRIOR = (0.01, 0.04)


@query(
    "posterior_k2_metrics",
    f"""{NORMAL_SQL}, p AS (SELECT *, a + {PRIOR[0]} AS pa, c + {PRIOR[1]} AS pc, (a + {PRIOR[0]}) * (c + {PRIOR[1]}) - b * b AS det FROM nm),
    r AS (SELECT *, abs(b) / sqrt(pa * pc) AS pr, CASE WHEN a > 0 AND c > 0 THEN abs(b) / sqrt(a * c) ELSE 1 END AS dr FROM p),
    s AS (SELECT y, x, avg(sqrt(greatest(0, (pc - 2 * g1 * b + g1 * g1 * pa) / det))) AS mean_std, max(sqrt(greatest(0, (pc - 2 * g1 * b + g1 * g1 * pa) / det))) AS max_std FROM r, template GROUP BY y, x)
    SELECT y, x, n AS usable_observation_count, CAST(CASE WHEN 1 - dr > (1 + dr) * 200 * 2.220446049250313e-16 THEN 2 ELSE 1 END AS BIGINT) AS data_rank,
    round((a * pc + c * pa - 2 * b * b) / det, 6) AS effective_dof, round(log10((1 + pr) / (1 - pr)), 6) AS log10_condition_number,
    round(0.5 * (ln(det) - ln({PRIOR[0]} * {PRIOR[1]})), 6) AS information_gain_nats, round(mean_std, 6) AS mean_prediction_std, round(max_std, 6) AS max_prediction_std FROM r JOIN s USING (y, x)""",
)
def posterior_k2_metrics(spark, d):
    normal = inversion.normal_matrix(_weighted(spark, d, 1), 2)
    points = _template(spark, 1).select(F.get("g", F.lit(0)).alias("p0"), F.get("g", F.lit(1)).alias("p1"))
    m = inversion.posterior_two(normal, PRIOR, points)
    return m.select("y", "x", "usable_observation_count", "data_rank", *[F.round(c, 6).alias(c) for c in m.columns[4:]])


def _general(spark: SparkSession, d: str, degree: int, prior: list[float]) -> DataFrame:
    t = np.array(TEMPLATE_YEARS) - 1998.0
    prediction = np.stack([t**p for p in range(degree + 1)], axis=1)
    return inversion.posterior_metrics(inversion.normal_matrix(_weighted(spark, d, degree), degree + 1), np.diag(prior), prediction)


@query("posterior_metrics_general")
def posterior_metrics_general(spark, d):
    m = _general(spark, d, 2, [0.01, 0.04, 0.25])
    return m.select("y", "x", *[F.round(c, 6).alias(c) for c in inversion.METRICS])


@query(
    "operator_ratio",
    f"""{CELLS_SQL}, k AS (SELECT y, x, CASE WHEN same_mission THEN 'same' ELSE 'mixed' END AS operator, count(*) FILTER (valid AND pair_days <= 365)::DOUBLE AS value FROM cells GROUP BY ALL)
    SELECT s.y, s.x, CASE WHEN m.value <> 0 THEN s.value / m.value END AS ratio FROM k s JOIN k m ON s.y = m.y AND s.x = m.x WHERE s.operator = 'same' AND m.operator = 'mixed'""",
)
def operator_ratio(spark, d):
    name = F.when(F.col("same_mission"), "same").otherwise("mixed")
    metric = cells(spark, d).groupBy("y", "x", name.alias("operator")).agg(F.count_if(_is_valid() & (F.col("pair_days") <= 365)).cast("double").alias("value"))
    return inversion.ratio(metric, "same", "mixed")


@query("robust_color_limits", f"{CELLS_SQL}, p AS (SELECT mission AS metric, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM cells WHERE valid GROUP BY mission) SELECT metric, round(CASE WHEN lo = hi THEN lo - greatest(abs(lo) * 0.01, 0.5) ELSE lo END, 6) AS lower, round(CASE WHEN lo = hi THEN hi + greatest(abs(lo) * 0.01, 0.5) ELSE hi END, 6) AS upper FROM p")
def robust_color_limits(spark, d):
    limits = inversion.color_limits(cells(spark, d).filter(_is_valid()).select(F.col("mission").alias("metric"), F.col("v").alias("value")))
    return limits.select("metric", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query(
    "export_preflight_estimate",
    f"""{CELLS_SQL} SELECT cube_id, count(DISTINCT observation_index) AS n_observations, min(y) AS min_y, max(y) AS max_y, min(x) AS min_x, max(x) AS max_x,
    count(DISTINCT y * 1000 + x) AS n_pixels, CAST(count(DISTINCT observation_index) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1) * 6 AS BIGINT) AS estimated_bytes FROM cells GROUP BY cube_id""",
)
def export_preflight_estimate(spark, d):
    c = cells(spark, d)
    return runs.export_plan(c, c.select("cube_id", "y", "x"), {"v": "smallint", "v_error": "float"}).drop("estimated_human")


@query("grid_regularity", "WITH s AS (SELECT p_brand AS series, CAST(p_size AS BIGINT) AS pos FROM part GROUP BY ALL), l AS (SELECT series, pos - lag(pos) OVER (PARTITION BY series ORDER BY pos) AS step FROM s) SELECT series, count(*) AS n_points, min(step) AS min_step, max(step) AS max_step, max(step) - min(step) <= 1e-9 * abs(max(step)) AS regular FROM l GROUP BY series")
def grid_regularity(spark, d):
    axis = read(spark, d, "part").select(F.col("p_brand").alias("series"), F.col("p_size").cast("long").alias("at")).distinct()
    return mos.spacing(axis, "series", "at")


@query("fingerprint_sha256", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}') AS fingerprint FROM orders""")
def fingerprint_sha256(spark, d):
    columns = ["o_orderkey", "o_custkey", "o_orderpriority"]
    return runs.with_fingerprint(read(spark, d, "orders").select(columns), columns).select("o_orderkey", "fingerprint")


# Further operators, each on whole tables.


@query("intersecting_cubes", "WITH c AS (SELECT 'c' || s_suppkey AS cube_id, (s_suppkey % 30)::DOUBLE AS xmin, (s_suppkey % 17)::DOUBLE AS ymin FROM supplier) SELECT cube_id FROM c WHERE xmin < 12 AND xmin + 4 > 2 AND ymin < 9 AND ymin + 3 > 5")
def intersecting_cubes(spark, d):
    k = F.col("s_suppkey")
    x, y = (k % 30).cast("double"), (k % 17).cast("double")
    cubes = read(spark, d, "supplier").select(F.concat(F.lit("c"), k.cast("string")).alias("cube_id"), x.alias("xmin"), y.alias("ymin"), (x + 4).alias("xmax"), (y + 3).alias("ymax"))
    return mos.intersecting(cubes, 2, 5, 12, 9).select("cube_id")


@query("mission_rollup", f"{CELLS_SQL} SELECT coalesce({GROUP_SQL}, 'all') AS mission_group, coalesce(mission, 'all') AS mission, count(*) AS n_observations FROM cells GROUP BY ROLLUP ({GROUP_SQL}, mission)")
def mission_rollup(spark, d):
    group = F.when(F.col("mission").startswith("LANDSAT-"), "LANDSAT").otherwise(F.col("mission"))
    rows = cells(spark, d).withColumn("mission_group", group).rollup("mission_group", "mission").agg(F.count("*").alias("n_observations"))
    return rows.select(F.coalesce("mission_group", F.lit("all")).alias("mission_group"), F.coalesce("mission", F.lit("all")).alias("mission"), "n_observations")


CELL_GRID_SQL = "src AS (SELECT x AS ix, y AS iy, CAST(count(*) FILTER (valid) AS DOUBLE) AS value FROM cells GROUP BY ALL), t AS (SELECT p_partkey AS target_id, (p_partkey % 97) / 4.0::DOUBLE AS fx, (p_partkey % 211) / 4.0::DOUBLE AS fy FROM part)"


def _resampled(spark: SparkSession, d: str, method) -> DataFrame:
    source = cells(spark, d).groupBy(F.col("x").alias("ix"), F.col("y").alias("iy")).agg(F.count_if(_is_valid()).cast("double").alias("value"))
    k = F.col("p_partkey")
    targets = read(spark, d, "part").select(k.alias("target_id"), ((k % 97) / F.lit(4.0)).alias("fx"), ((k % 211) / F.lit(4.0)).alias("fy"))
    return method(targets, source).withColumn("value", F.round("value", 8))


@query("resample_nearest", f"{CELLS_SQL}, {CELL_GRID_SQL} SELECT target_id, round(value, 8) AS value FROM t LEFT JOIN src ON ix = CAST(round_even(fx, 0) AS BIGINT) AND iy = CAST(round_even(fy, 0) AS BIGINT)")
def resample_nearest(spark, d):
    return _resampled(spark, d, mos.nearest_order)


@query(
    "resample_cubic",
    f"""{CELLS_SQL}, {CELL_GRID_SQL}, o AS (SELECT target_id, CAST(floor(fx) AS BIGINT) + i AS ix, CAST(floor(fy) AS BIGINT) + j AS iy, abs(fx - floor(fx) - i) AS a, abs(fy - floor(fy) - j) AS b
      FROM t, (SELECT unnest(range(-1, 3)) AS i), (SELECT unnest(range(-1, 3)) AS j)),
    k AS (SELECT target_id, ix, iy, (CASE WHEN a <= 1 THEN 1.5 * a * a * a - 2.5 * a * a + 1 WHEN a < 2 THEN -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2 ELSE 0 END)
      * (CASE WHEN b <= 1 THEN 1.5 * b * b * b - 2.5 * b * b + 1 WHEN b < 2 THEN -0.5 * b * b * b + 2.5 * b * b - 4 * b + 2 ELSE 0 END) AS w FROM o)
    SELECT target_id, CASE WHEN count(value) = count(*) THEN round(sum(w * value), 8) END AS value FROM k LEFT JOIN src USING (ix, iy) WHERE w <> 0 GROUP BY target_id""",
)
def resample_cubic(spark, d):
    return _resampled(spark, d, mos.cubic)


@query("pending_blocks", f"WITH {PIXELS_SQL}, b AS (SELECT DISTINCT CAST(y // 10 AS BIGINT) || ':' || CAST(x // 10 AS BIGINT) AS block_id FROM pixels) SELECT block_id FROM b WHERE block_id NOT LIKE '%:0'")
def pending_blocks(spark, d):
    wanted = runs.blocks(_pixels(spark, d).withColumn("cube_id", F.lit("all")), 10).withColumn("fingerprint", F.lit("f"))
    done = wanted.filter("block_id LIKE '%:0'").withColumn("status", F.lit("complete"))
    stale = wanted.withColumn("status", F.lit("complete")).withColumn("fingerprint", F.lit("older"))
    return runs.pending(wanted, done.unionByName(stale)).select("block_id")


@query(
    "download_plan",
    """WITH e AS (SELECT event_id, event_id % 9 = 0 AS none, 1000 + event_id % 500 AS size, CASE event_id % 4 WHEN 1 THEN 1000 + event_id % 500 WHEN 2 THEN 10 END AS have FROM events)
    SELECT event_id AS item_id, CASE WHEN none THEN 'NO_ASSET' WHEN have >= size THEN 'SKIP' WHEN have > 0 THEN 'RESUME' ELSE 'GET' END AS action, CAST(CASE WHEN none THEN 0 ELSE coalesce(have, 0) END AS BIGINT) AS from_byte FROM e""",
)
def download_plan(spark, d):
    i = F.col("event_id")
    e = read(spark, d, "events")
    name = F.concat(F.lit("f"), i.cast("string"), F.lit(".nc"))
    records = e.select(i.alias("item_id"), F.when(i % 9 != 0, F.concat(F.lit("https://h/x/"), name)).alias("data_href"), (1000 + i % 500).alias("asset_size_bytes"))
    present = e.select(name.alias("name"), F.when(i % 4 == 1, 1000 + i % 500).when(i % 4 == 2, F.lit(10)).alias("bytes")).filter("bytes IS NOT NULL")
    return inv.download_plan(records, present).select("item_id", "action", F.col("from_byte").cast("long").alias("from_byte"))


@query("probed_sizes", f"{GRANULES_SQL} SELECT CASE WHEN size IS NOT NULL THEN 'stac' WHEN item_id % 2 = 0 THEN 'http' ELSE 'none' END AS source, count(*) AS n_records, CAST(sum(CASE WHEN size IS NOT NULL THEN size WHEN item_id % 2 = 0 THEN 7 ELSE 0 END) AS BIGINT) AS total_bytes FROM granules GROUP BY 1")
def probed_sizes(spark, d):
    g = granules(spark, d).withColumn("asset_size_bytes", text.whole_number(F.col("asset_size_bytes"))).withColumn("asset_size_source", F.when(F.col("asset_size_bytes").isNotNull(), "stac"))
    probed = read(spark, d, "events").filter("event_id % 2 = 0").select(F.col("event_id").alias("item_id"), F.lit(7).cast("long").alias("probed_bytes"))
    rows = inv.with_probed_sizes(g, probed)
    return rows.groupBy(F.coalesce("asset_size_source", F.lit("none")).alias("source")).agg(F.count("*").alias("n_records"), F.sum(F.coalesce("asset_size_bytes", F.lit(0))).cast("long").alias("total_bytes"))


def _polar_sql() -> str:
    import math

    e, lat0 = geo.ECCENTRICITY, math.radians(geo.TRUE_SCALE_LATITUDE)
    tf = math.tan(math.pi / 4 + lat0 / 2) / ((1 + e * math.sin(lat0)) / (1 - e * math.sin(lat0))) ** (e / 2)
    mf = math.cos(lat0) / math.sqrt(1 - (e * math.sin(lat0)) ** 2)
    return f"""WITH c AS (SELECT c_custkey, (c_custkey % 360) - 180 AS lon, -60 - (c_custkey % 30) / 1.01::DOUBLE AS lat FROM customer),
    r AS (SELECT *, {geo.SEMI_MAJOR * mf / tf!r} * tan(pi() / 4 + radians(lat) / 2) / pow((1 + {e!r} * sin(radians(lat))) / (1 - {e!r} * sin(radians(lat))), {e / 2!r}) AS rho FROM c)
    SELECT c_custkey, round(rho * sin(radians(lon)), 3) + 0.0 AS x, round(rho * cos(radians(lon)), 3) + 0.0 AS y, round(lat, 6) AS lat_back FROM r"""


@query("polar_projection", _polar_sql())
def polar_projection(spark, d):
    """To the grid and back: the latitude returns."""
    k = F.col("c_custkey")
    x, y = geo.to_polar((k % 360 - 180).cast("double"), -60 - (k % 30) / F.lit(1.01))
    rows = read(spark, d, "customer").select("c_custkey", x.alias("x"), y.alias("y"))
    return rows.select("c_custkey", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"), F.round(geo.from_polar(F.col("x"), F.col("y"))[1], 6).alias("lat_back"))


@query("buffer_distance", f"WITH {PIXELS_SQL} SELECT y, x, round(sqrt(pow(greatest(4 - x, x - 11, 0), 2) + pow(greatest(6 - y, y - 30, 0), 2)), 9) AS distance FROM pixels")
def buffer_distance(spark, d):
    ring = geo.densified_ring(4, 6, 11, 30, 1)
    return _pixels(spark, d).withColumn("distance", F.round(geo.distance_to_ring(F.col("x").cast("double"), F.col("y").cast("double"), ring), 9))


@query("usable_observations", f"{CELLS_SQL} SELECT cube_id, count(*) FILTER (valid AND v_error > 0) AS n_usable, round(sum(CASE WHEN valid AND v_error > 0 THEN 1 / (v_error * v_error) END), 6) AS weight FROM cells GROUP BY cube_id")
def usable_observations(spark, d):
    ok = inversion.usable(_is_valid(), F.col("v_error"))
    return cells(spark, d).groupBy("cube_id").agg(F.count_if(ok).alias("n_usable"), F.round(F.sum(F.when(ok, 1 / (F.col("v_error") * F.col("v_error")))), 6).alias("weight"))


@query("validity_components", "SELECT l_returnflag, count(*) AS n_cells, count(*) FILTER (l_tax <> 0 AND l_discount <> 0) AS n_valid FROM lineitem GROUP BY l_returnflag")
def validity_components(spark, d):
    """A speed that is absent: both components must be valid, zero being declared missing here."""
    ok = cov.valid([F.col("l_tax"), F.col("l_discount")], [0.0])
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n_cells"), F.count_if(ok).alias("n_valid"))


@query("renumbered_observations", f"{CELLS_SQL}, o AS (SELECT DISTINCT cube_id, observation_index FROM cells WHERE {SELECTED_SQL}) SELECT cube_id, observation_index, CAST(row_number() OVER (PARTITION BY cube_id ORDER BY observation_index) - 1 AS INTEGER) AS new_index FROM o")
def renumbered_observations(spark, d):
    return obs.renumbered(obs.selected(cells(spark, d), SELECT).select("cube_id", "observation_index").distinct())


@query("unassigned_pixels", f"WITH {PIXELS_SQL}, {TILES_SQL}, {OWNED_SQL} SELECT count(*) AS pixels, count(*) FILTER (tile_id IS NULL) AS unassigned FROM pixels LEFT JOIN owned USING (y, x) WHERE x <= 12")
def unassigned_pixels(spark, d):
    p = _pixels(spark, d).filter("x <= 12")
    return p.join(mos.owned(p, _tiles(spark), 5.0), ["y", "x"], "left").agg(F.count("*").alias("pixels"), F.count_if(F.col("tile_id").isNull()).alias("unassigned"))


@query("constant_count_map", f"WITH {PIXELS_SQL} SELECT y, x, CASE WHEN {BOX_SQL} THEN 7.0::DOUBLE END AS selected_count FROM pixels")
def constant_count_map(spark, d):
    return _pixels(spark, d).withColumn("selected_count", F.when(cov.in_box(*BOX), 7.0))


@query("raster_rows", f"WITH {PIXELS_SQL} SELECT y, x, CAST(dense_rank() OVER (ORDER BY y DESC) - 1 AS INTEGER) AS row, CAST(dense_rank() OVER (ORDER BY x) - 1 AS INTEGER) AS col FROM pixels")
def raster_rows(spark, d):
    """North-up places of a raster's cells, by joins with the two short axes rather than a window over all cells."""
    from pyspark.sql import Window

    p = _pixels(spark, d)
    axis = lambda c, order, name: p.select(c).distinct().withColumn(name, F.row_number().over(Window.orderBy(order)) - 1)
    return p.join(axis("y", F.col("y").desc(), "row"), "y").join(axis("x", F.col("x").asc(), "col"), "x").select("y", "x", "row", "col")


@query("coordinate_summary", "SELECT 'x' AS axis, CAST(min(s_nationkey) AS BIGINT) AS low, CAST(max(s_nationkey) AS BIGINT) AS high, array_to_string(list_sort(list_distinct(list(s_nationkey)))[1:8], ',') AS first_values FROM supplier UNION ALL SELECT 'y', min(p_size), max(p_size), array_to_string(list_sort(list_distinct(list(p_size)))[1:8], ',') FROM part")
def coordinate_summary(spark, d):
    def axis(name, table, column):
        c = F.col(column).cast("long")
        rows = read(spark, d, table).select(c.alias("c"))
        head = rows.filter("c IS NOT NULL").distinct().orderBy("c").limit(8).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("first_values"))
        return rows.agg(F.lit(name).alias("axis"), F.min("c").alias("low"), F.max("c").alias("high")).crossJoin(F.broadcast(head))

    return axis("x", "supplier", "s_nationkey").unionByName(axis("y", "part", "p_size"))


@query("posterior_effective_dof_map", f"{NORMAL_SQL} SELECT y, x, round((a * (c + {PRIOR[1]}) + c * (a + {PRIOR[0]}) - 2 * b * b) / ((a + {PRIOR[0]}) * (c + {PRIOR[1]}) - b * b), 6) AS effective_dof FROM nm")
def posterior_effective_dof_map(spark, d):
    """One metric of the general path, batched numpy, against the closed form."""
    return _general(spark, d, 1, list(PRIOR)).select("y", "x", F.round("effective_dof", 6).alias("effective_dof"))


@query("template_summary", f"WITH {TEMPLATE_SQL}, s AS (SELECT t, t - lag(t) OVER (ORDER BY t) AS step FROM template) SELECT count(*) AS n_times, min(t) AS first, max(t) AS last, round(CAST(quantile_cont(step, 0.5) AS DOUBLE), 9) AS median_step, max(step) - min(step) <= 1e-6 * max(step) AS uniform FROM s")
def template_summary(spark, d):
    return inversion.template_summary(_template(spark)).withColumn("median_step", F.round("median_step", 9))
