"""The programs, end to end on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from pairfield import api
from pairfield.__main__ import main
from pairfield.operators.observations import Selection


@pytest.fixture(scope="module")
def cells(spark):
    days = {0: ("2020-01-01", "2020-01-13"), 1: ("2020-03-01", "2020-04-20"), 2: ("2020-01-01", "2020-12-31"), 3: ("2020-06-01", "2020-06-07")}
    rows = [("a", o, 10.0 * j, 10.0 * i, *days[o], "S1" if o < 3 else "L8", -32767.0 if (o, i, j) == (0, 1, 1) else o + 1.0, 1.0 + o) for o in days for i in range(4) for j in range(3)]
    df = spark.createDataFrame(rows, "cube_id string, obs long, y double, x double, date_1 string, date_2 string, mission_img1 string, v double, v_error double")
    df = df.withColumn("mission_img2", F.col("mission_img1")).withColumn("date_1", F.to_timestamp_ntz("date_1")).withColumn("date_2", F.to_timestamp_ntz("date_2"))
    return api.observations(df)


OPTIONS = api.CoverageOptions(Selection("2020-01-01", "2020-12-31", "SENTINEL-1"), api.Region(-1, -1, 10, 10), (-32767,))


def test_coverage(cells):
    made = api.coverage(cells, cells, OPTIONS)
    assert {(r["x"], r["y"]): (r["valid_count"], round(r["valid_fraction"], 4)) for r in made.pixels.collect()} == {(0, 0): (3, 1.0), (10, 0): (3, 1.0), (0, 10): (3, 1.0), (10, 10): (2, 0.6667)}
    assert made.funnel.first().asDict()["matching_mission"] == 3 and made.selected.count() == 3
    assert made.statistics.first()["min_count"] == 2


def test_options_are_checked():
    for bad in (lambda: api.Region(1, 0, 0, 1), lambda: api.CoverageOptions(Selection("2020-01-02", "2020-01-01"), OPTIONS.region), lambda: api.CoverageOptions(Selection("2020-01-01", "2020-02-01", least_days=9, most_days=3), OPTIONS.region)):
        with pytest.raises(ValueError):
            bad()
    assert OPTIONS.fingerprint() == api.CoverageOptions(OPTIONS.selection, OPTIONS.region, (-32767,)).fingerprint()
    assert api.json_safe({"a": float("inf"), 1: (1, None)}) == {"a": "inf", "1": [1, None]}


def test_lonlat_region(spark):
    from pairfield.functions import geo

    x, y = geo.to_polar(F.col("lon"), F.col("lat"))
    df = spark.createDataFrame([(100.0, -68.0), (103.0, -68.0), (179.5, -70.0), (-179.5, -70.0)], "lon double, lat double").select("lon", x.alias("x"), y.alias("y"))
    assert [r["lon"] for r in df.filter(api.Region(99, -69, 101, -67, lonlat=True).contains()).collect()] == [100.0]
    across = api.Region(179, -71, -179, -69, lonlat=True)
    assert [r["lon"] for r in df.filter(across.contains()).collect()] == [179.5, -179.5]
    assert json.loads(across.geojson())["geometry"]["type"] == "MultiPolygon"


def test_multi_coverage(spark, cells):
    two = cells.withColumn("row", (F.col("y") / 10).cast("long")).withColumn("col", (F.col("x") / 10).cast("long"))
    two = two.unionByName(two.withColumn("cube_id", F.lit("b")).withColumn("x", F.col("x") + 30))
    tiles = spark.createDataFrame([("a", -5.0, -5.0, 25.0, 25.0, 0.0, 0.0, 10.0, 10.0, 4, 3), ("b", 25.0, -5.0, 65.0, 25.0, 30.0, 0.0, 10.0, 10.0, 4, 3)], "cube_id string, xmin double, ymin double, xmax double, ymax double, x0 double, y0 double, dx double, dy double, nx int, ny int")
    pixels = spark.createDataFrame([(10.0 * i, 10.0 * j) for i in range(8) for j in range(3)], "x double, y double")
    options = api.CoverageOptions(OPTIONS.selection, api.Region(0, 0, 70, 20), (-32767,))
    mosaic, dedup = api.multi_coverage(two, tiles, pixels, options, 20.0)
    made = {(r["x"], r["y"]): r["valid_count"] for r in mosaic.collect()}
    assert made[(10.0, 10.0)] == 2 and made[(40.0, 10.0)] == 2 and made[(0.0, 0.0)] == 3 and made[(70.0, 0.0)] is None
    assert api.unassigned(mosaic) == 3 and dedup.count() == 3 and dedup.first()["cube_count"] == 2
    assert api.replay(two, dedup).count() == 2 * 3 * 12
    with pytest.raises(ValueError):
        api.replay(two.filter("cube_id = 'a'"), dedup)


def test_compare(cells):
    rows = {(r["mission_group"], r["duration_bin"]): r for r in api.compare_durations(cells, cells, OPTIONS.region, "2020-01-01", "2020-12-31", missing=(-32767,)).collect()}
    assert len(rows) == 8 and rows[("SENTINEL-1", 0)]["min_count"] == 0 and rows[("SENTINEL-1", 0)]["mean_count"] == 0.75
    assert rows[("LANDSAT", 0)]["selected_observations"] == 1 and rows[("LANDSAT", 3)]["selected_observations"] == 0 == rows[("LANDSAT", 3)]["max_count"]


def test_diagnostics(spark, cells):
    spec = api.TemplateOptions("2020-01-01", "2021-01-01", 5, prior_std={"poly": 10.0})
    template = api.build_template(spark, spec)
    made = api.diagnostics(cells, template, spec, missing=(-32767,)).collect()
    assert len(made) == 24 and {r["operator"] for r in made} == {"midpoint", "interval-average"}
    assert all(r["data_rank"] == 2 and 0 < r["effective_dof"] < 2 for r in made)
    assert spec.names() == ["000_poly_0", "001_poly_1"] and spec.precision()[0, 0] == pytest.approx(0.01)
    with pytest.raises(ValueError):
        api.diagnostics(cells, api.build_template(spark, api.TemplateOptions("2020-02-01", "2021-01-01", 5)), spec)
    with pytest.raises(ValueError):
        api.error_column(cells, "vx")


def test_cube_url(spark):
    df = spark.createDataFrame([({"vx": {"href": "x"}, "v": {"href": "v"}},), ({"q": {"href": "a/b.zarr"}},), ({"q": {"href": "c"}},)], "assets map<string,struct<href:string>>")
    assert [r[0] for r in df.select(api.cube_url(F.col("assets"))).collect()] == ["v", "a/b.zarr", None]


def test_command_line(spark, cells, tmp_path):
    cells.write.parquet(str(tmp_path / "cells"))
    common = ["--input", str(tmp_path / "cells"), "--start", "2020-01-01", "--end", "2020-12-31", "--bbox", "-1", "-1", "10", "10", "--missing", "-32767"]
    assert main(["coverage", *common, "--output", str(tmp_path / "o"), "--mission", "SENTINEL-1"]) == 0
    assert spark.read.parquet(str(tmp_path / "o/pixels")).count() == 4
    assert main(["export", *common, "--output", str(tmp_path / "e"), "--variables", "v", "--dry-run"]) == 0
    assert spark.read.parquet(str(tmp_path / "e/plan")).first()["n_pixels"] == 4
    assert main(["compare", *common, "--output", str(tmp_path / "c")]) == 0
    assert main(["diagnostics", *common, "--output", str(tmp_path / "d"), "--step-days", "10", "--prior-std", "10"]) == 0
    assert spark.read.parquet(str(tmp_path / "d/metrics")).count() == 8
    assert main(["export", *common, "--output", str(tmp_path / "x"), "--variables", "absent"]) == 2
