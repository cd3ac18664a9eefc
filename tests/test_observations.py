"""Coverage cube facts: missions, filters, funnels, keys and replay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pairfield.functions import mission
from pairfield.operators import coverage as cov
from pairfield.operators import observations as obs
from pairfield.sources.schema import renamed, resolve

ROWS = [
    (0, "2020-01-01", "2019-12-26", "2020-01-07", 12.0, "S1", "S1", "C-SAR", "C-SAR"),
    (1, "2020-01-02", "2019-12-27", "2020-01-08", 12.0, "S1", "L8", "C-SAR", "OLI"),
    (2, "2020-01-03", "2019-12-20", "2020-01-17", 28.0, "L8", "L8", "OLI", "OLI"),
    (3, "2021-01-01", "2020-12-25", "2021-01-08", 14.0, "S1", "S1", "C-SAR", "C-SAR"),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.createDataFrame(ROWS, "observation_index long, mid string, d1 string, d2 string, pair_days double, mission_img1 string, mission_img2 string, sensor_img1 string, sensor_img2 string")
    dated = rows.select("*", F.to_timestamp_ntz("mid").alias("mid_date"), F.to_timestamp_ntz("d1").alias("date_img1"), F.to_timestamp_ntz("d2").alias("date_img2"), F.lit(None).cast("string").alias("satellite_img1"), F.lit(None).cast("string").alias("satellite_img2"))
    return obs.observation_table(dated.drop("mid", "d1", "d2"))


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(o, float(y), float(x), -32767.0 if (o, y, x) == (0, 10, 10) else o + 1.0) for o in range(4) for y in (20, 10, 0) for x in (0, 10, 20, 30)]
    return spark.createDataFrame(rows, "observation_index long, y double, x double, v double")


def ids(df):
    return sorted(r["observation_index"] for r in df.collect())


def test_missions(table):
    assert [r["mission"] for r in table.orderBy("observation_index").collect()] == ["SENTINEL-1", "MIXED", "LANDSAT-8", "SENTINEL-1"]


def test_filter_and_funnel(table):
    s = obs.Selection("2020-01-01", "2020-01-03", mission="SENTINEL-1", most_days=12)
    assert ids(obs.selected(table, s)) == [0]
    assert obs.funnel(table, s).first().asDict() == {"observations_in_cube": 4, "within_time_range": 3, "matching_mission": 1, "matching_sensor": 1, "matching_pair_duration": 1}
    assert ids(obs.selected(table, obs.Selection("2020-01-01", "2020-01-03", mission="LANDSAT"))) == [2]
    assert ids(obs.selected(table, obs.Selection("2030-01-01", "2030-01-03"))) == []
    assert ids(obs.selected(table, obs.Selection("2020-01-01", "2021-12-31", sensor=" c-sar "))) == [0, 3]


def test_selection_that_cannot_be_answered(table):
    with pytest.raises(ValueError):
        obs.check_selection(table.withColumn("pair_days", F.lit(None).cast("double")), obs.Selection("2020-01-01", "2020-01-03", most_days=3))
    obs.check_selection(table, obs.Selection("2020-01-01", "2020-01-03", mission="S1", sensor="OLI", most_days=3))


def test_coverage(cells):
    region, is_valid = cov.in_box(-1, -1, 10, 10), cov.valid([F.col("v")], [-32767])
    made = cov.coverage(cells.filter("observation_index = 0"), cells, is_valid, region)
    assert sorted(r["valid_count"] for r in made.collect()) == [0, 1, 1, 1]
    stats = cov.statistics(made).first()
    assert (stats["pixel_count"], stats["min_count"], stats["max_count"], stats["median_count"], stats["p25_count"]) == (4, 0, 1, 1.0, 0.75)


def test_fraction_of_none_is_null(spark, cells):
    none = spark.createDataFrame([(0,)], "n long")
    pixels = cov.coverage(cells.filter("false"), cells, F.lit(True), F.lit(True))
    assert {(r["valid_count"], r["valid_fraction"]) for r in cov.fraction(pixels, none).collect()} == {(0, None)}


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (-32767.0,)], "v double")
    assert [r[0] for r in df.select(cov.valid([F.col("v")], [-32767])).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("codes,name", [(("S", "1A"), "SENTINEL-1"), (("S", "1B"), "SENTINEL-1"), (("S", "2A"), "SENTINEL-2"), (("L", "8"), "LANDSAT-8"), ((None, None), "UNKNOWN")])
def test_mission_codes(spark, codes, name):
    df = spark.createDataFrame([codes], "m string, s string")
    assert df.select(mission.normalize_pair_mission(F.col("m"), F.col("s"))).first()[0] == name


def test_scenes(spark):
    one, two = ("S1B_IW_SLC__1SSH_20210104T101112_20210104T101139_025012_02FA3C_B1C2", "S1B_IW_SLC__1SSH_20210116T101112_20210116T101139_025187_02FFCD_0ABC")
    df = spark.createDataFrame([(f"{one}_X_{two}_G0120V02_P094.nc",), ("nothing",)], "p string")
    assert [r[0] for r in df.select(mission.scenes(F.col("p"))).collect()] == [[one, two], []]


def test_orbits(spark):
    df = spark.createDataFrame([("asc", "ASC"), ("desc", "desc"), ("asc", "desc"), ("asc", None)], "a string, b string")
    assert [r[0] for r in df.select(mission.orbit_direction(F.col("a"), F.col("b"))).collect()] == [1, 2, 3, 0]


def test_dedup_and_replay(spark, table):
    base = table.filter("observation_index < 2").withColumn("image_pair_id", F.when(F.col("observation_index") == 0, " p "))
    both = base.withColumn("cube_id", F.lit("a")).unionByName(base.withColumn("cube_id", F.lit("b")).withColumn("observation_index", F.col("observation_index") + 7))
    made = {r["observation_key"]: r for r in obs.deduplicated(both).collect()}
    assert len(made) == 2 and made["p"]["cube_count"] == 2 and made["p"]["cube_ids"] == "a;b"
    assert made["p"]["cube_observations"] == '[{"cube_id":"a","observation_index":0},{"cube_id":"b","observation_index":7}]'
    other = next(k for k in made if k != "p")
    assert other.startswith("metadata:2020-01-02 00:00:00|") and other.endswith("SENTINEL-1|LANDSAT-8||")
    places = obs.replay_places(obs.deduplicated(both))
    assert sorted((r["cube_id"], r["observation_index"]) for r in places.collect()) == [("a", 0), ("a", 1), ("b", 7), ("b", 8)]
    check = {r["cube_id"]: r for r in obs.replay_check(places, both.filter("observation_index <> 8")).collect()}
    assert (check["a"]["out_of_range"], check["b"]["out_of_range"], check["b"]["mismatched"]) == (0, 1, 0)
    legacy = spark.createDataFrame([("pair-a", "a", 4), ("pair-b", "b", 7)], "observation_key string, source_cube_id string, observation_index long")
    assert sorted((r["cube_id"], r["observation_index"]) for r in obs.replay_places(legacy).collect()) == [("a", 4), ("b", 7)]


def test_renumbered(table):
    made = obs.renumbered(table.filter("observation_index > 1").withColumn("cube_id", F.lit("a")))
    assert [r["new_index"] for r in made.orderBy("observation_index").collect()] == [0, 1]


def test_duration_bins(spark):
    df = spark.createDataFrame([(12.0,), (12.1,), (36.0,), (400.0,), (None,)], "d double")
    assert [r[0] for r in df.select(cov.duration_bin(F.col("d"), (12.0, 36.0))).collect()] == [0, 1, 1, 2, None]


def test_schema_resolver(spark):
    df = spark.createDataFrame([(1.0, dt.datetime(2020, 1, 1))], "Velocity double, DATE_CENTER timestamp")
    found = resolve(df)
    assert (found["v"], found["mid_date"], found["vx"]) == ("Velocity", "DATE_CENTER", None) and found.velocity() == ("Velocity",)
    assert renamed(df).select("v", "mid_date", "pair_days").first()["pair_days"] is None
    with pytest.raises(ValueError):
        resolve(df, {"v": "absent"})
    with pytest.raises(ValueError):
        resolve(spark.createDataFrame([(1.0,)], "vx double")).velocity()
