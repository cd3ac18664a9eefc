"""Tiles: ownership, nearest samples, resampling, containers, spacing."""

import pytest
from pyspark.sql import functions as F

from pairfield.operators import mosaic as mos


def test_two_tile_mosaic(spark):
    tiles = spark.createDataFrame([("left", 0.0, 0.0, 100.0, 100.0), ("right", 100.0, 0.0, 200.0, 100.0)], "tile_id string, xmin double, ymin double, xmax double, ymax double")
    pixels = spark.createDataFrame([(6.0 + 12 * j, 6.0 + 12 * i) for i in range(8) for j in range(16)], "x double, y double")
    owned = mos.owned(pixels, tiles, 50.0)
    shape = spark.createDataFrame([("left", 8.0, 92.0, 12.0, -12.0, 8, 8), ("right", 108.0, 92.0, 12.0, -12.0, 8, 8)], "tile_id string, x0 double, y0 double, dx double, dy double, nx int, ny int")
    source = spark.createDataFrame([(t, r, c, v) for t, v in (("left", 10), ("right", 20)) for r in range(8) for c in range(8)], "tile_id string, row long, col long, value int")
    rows = mos.sampled(owned, shape, source).collect()
    assert len(rows) == 128 and all(r["value"] == (10 if r["x"] < 100 else 20) for r in rows)


def test_later_tile_owns_overlap(spark):
    tiles = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0), ("b", 5.0, 0.0, 15.0, 10.0)], "tile_id string, xmin double, ymin double, xmax double, ymax double")
    pixels = spark.createDataFrame([(4.0, 1.0), (5.0, 1.0), (10.0, 1.0), (15.0, 1.0)], "x double, y double")
    assert {r["x"]: r["tile_id"] for r in mos.owned(pixels, tiles, 3.0).collect()} == {4.0: "a", 5.0: "b", 10.0: "b"}


@pytest.fixture(scope="module")
def plane(spark):
    return spark.createDataFrame([(i, j, 2.0 * i + 3.0 * j) for i in range(6) for j in range(6)], "ix long, iy long, value double")


def test_resampling_orders(spark, plane):
    targets = spark.createDataFrame([(0, 2.25, 2.5), (1, 5.0, 5.0), (2, 5.5, 1.0), (3, 2.0, 2.0)], "target_id long, fx double, fy double")
    linear = {r["target_id"]: r["value"] for r in mos.bilinear(targets, plane).collect()}
    assert linear == {0: pytest.approx(12.0), 1: 25.0, 2: None, 3: 10.0}
    smooth = {r["target_id"]: r["value"] for r in mos.cubic(targets, plane).collect()}
    assert smooth[0] == pytest.approx(12.0) and smooth[2] is None and smooth[3] == pytest.approx(10.0)
    near = {r["target_id"]: r["value"] for r in mos.nearest_order(targets, plane).collect()}
    assert near[0] == 10.0 and near[2] is None


def test_containers(spark):
    cubes = spark.createDataFrame([("b", 0.0, 0.0, 10.0, 10.0), ("a", 0.0, 0.0, 10.0, 10.0), ("c", 0.0, 0.0, 20.0, 20.0), ("d", 10.0, 0.0, 20.0, 10.0)], "cube_id string, xmin double, ymin double, xmax double, ymax double")
    r = mos.smallest_container(cubes, 1, 1, 9, 9).first()
    assert (r["cube_id"], r["area"], r["tied"]) == ("a", 100.0, 2)
    assert [r["cube_id"] for r in mos.intersecting(cubes, 0, 0, 10, 10).collect()] == ["a", "b", "c"]


def test_spacing(spark):
    axis = spark.createDataFrame([("r", 0.0), ("r", 120.0), ("r", 240.0), ("o", 0.0), ("o", 1.0), ("o", 3.0)], "s string, at double")
    assert {r["s"]: r["regular"] for r in mos.spacing(axis, "s", "at").collect()} == {"r": True, "o": False}
    assert axis.filter(F.lit(False)).count() == 0
