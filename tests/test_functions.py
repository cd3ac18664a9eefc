"""Dates, sizes, links, rings and projection."""

import math

import pytest
from pyspark.sql import functions as F

from pairfield.functions import geo, mission, text
from pairfield.functions import time as dates


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_bounds():
    first, beyond = dates.bounds("2020-11-30", "2020-12-31")
    assert (first.isoformat(), beyond.isoformat()) == ("2020-11-30T00:00:00", "2021-01-01T00:00:00")
    assert dates.bounds("2020-01-01", "2020-01-01T01:00:00Z")[1].isoformat() == "2020-01-01T01:00:00.000001"
    with pytest.raises(ValueError):
        dates.bounds("2020-01-02", "2020-01-01T00:00:00")


def test_decimal_year(spark):
    year = lambda t: one(spark, dates.decimal_year(F.lit(t).cast("timestamp_ntz")))
    assert year("2020-01-01 00:00:00") == 2020.0 and year("2021-07-02 12:00:00") == pytest.approx(2021.5)
    assert year("2020-07-02 00:00:00") == pytest.approx(2020.5)


def test_template_dates():
    assert [d.day for d in dates.template_dates("2020-01-01", "2020-01-08", 3)] == [1, 4, 7, 8]


@pytest.mark.parametrize("n,shown", [(None, "unknown"), (0, "0 B"), (1023, "1023 B"), (1024, "1.00 KiB"), (39 * 1024 + 256, "39.2 KiB"), (150 * 1024**2, "150 MiB"), (3 * 1024**5, "3.00 PiB")])
def test_human_bytes(spark, n, shown):
    assert one(spark, text.human_bytes(F.lit(n).cast("long"))) == shown


def test_human_bytes_fixed(spark):
    assert one(spark, text.human_bytes(F.lit(150 * 1024**2), fixed=True)) == "150.00 MiB"


def test_headers_and_names(spark):
    assert one(spark, text.content_range_total(F.lit("bytes 0-0/12345678"))) == 12345678
    assert one(spark, text.content_range_total(F.lit("bytes 0-0/*"))) is None
    assert one(spark, text.destination_name(F.lit("i"), F.lit("https://a.b/c/d.nc?x=1"))) == "d.nc"
    assert one(spark, text.destination_name(F.lit("i"), F.lit("https://a.b"))) == "i.nc"
    assert one(spark, text.destination_name(F.lit("i"), F.lit(None).cast("string"))) == "i.nc"
    assert one(spark, text.whole_number(F.lit("3.0"))) is None and one(spark, text.whole_number(F.lit("-5"))) is None


def test_polygon_boundary_is_inside(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    points = [(0, 0), (5, 5), (5, 0), (0, 3), (2, 2), (6, 6), (-1, 0), (11, 0)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    assert [r[0] for r in df.select(geo.in_rings(F.col("x"), F.col("y"), [ring])).collect()] == [True] * 5 + [False] * 3


def test_distance_and_overlap(spark):
    box = geo.densified_ring(0, 0, 2, 2, 1)
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (5.0, 6.0)], "x double, y double")
    assert [r[0] for r in df.select(geo.distance_to_ring(F.col("x"), F.col("y"), box)).collect()] == [0.0, 1.0, 5.0]
    assert geo.ring_area(geo.convex_overlap(box, geo.densified_ring(1, 1, 4, 4, 3))) == pytest.approx(1.0)
    assert geo.convex_overlap(box, geo.densified_ring(2, 0, 3, 2, 1)) and not geo.convex_overlap(box, geo.densified_ring(3, 0, 4, 2, 1))


def test_rings():
    assert len(geo.densified_ring(0, 0, 1, 1, 25)) == 101
    assert len(geo.lonlat_rings(170, -70, -170, -60)) == 2 and len(geo.lonlat_rings(10, -70, 20, -60)) == 1
    with pytest.raises(ValueError):
        geo.lonlat_rings(10, 70, 20, 60)
    assert geo.aligned(1, 23, 10) == (0, 30) and geo.aligned(1, 23, 10, 5) == (-5, 25)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(100.0, -68.0), (-45.5, -80.0), (0.0, -71.0)], "lon double, lat double")
    x, y = geo.to_polar(F.col("lon"), F.col("lat"))
    rows = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_polar(F.col("x"), F.col("y"))
    for r in rows.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert r["lon2"] == pytest.approx(r["lon"], abs=1e-8) and r["lat2"] == pytest.approx(r["lat"], abs=1e-8)
    r = rows.filter("lon = 0").first()
    # on the latitude of true scale the radius is that of the parallel, on the ellipsoid
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    lat = math.radians(-71)
    assert math.hypot(r["x"], r["y"]) == pytest.approx(6378137 * math.cos(lat) / math.sqrt(1 - e2 * math.sin(lat) ** 2) , rel=1e-9)


def test_nearest_index_halves_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-4.0,), (99.0,)], "v double")
    assert [r[0] for r in df.select(geo.nearest_index(F.col("v"), F.lit(0.0), F.lit(1.0), F.lit(8))).collect()] == [0, 2, 0, 7]


def test_areas_and_envelopes(spark):
    quarter = geo.densified_ring(0, 0, 90, 90, 50)
    assert geo.spherical_area(quarter) == pytest.approx(math.pi / 2 * 6_371_007.2**2, rel=1e-3)
    x, y = geo.to_polar(F.lit(100.0), F.lit(-68.0))
    assert geo.polar_point(100.0, -68.0) == pytest.approx((one(spark, x), one(spark, y)))
    west, south, east, north = geo.projected_envelope(99, -69, 101, -67)
    assert west < one(spark, x) < east and south < one(spark, y) < north


def test_two_scenes_or_an_error(spark):
    one = "S1B_IW_SLC__1SSH_20210104T101112_20210104T101139_025012_02FA3C_B1C2"
    d = spark.createDataFrame([(f"{one}_X_{one.replace('0104', '0116')}_G0120V02_P094.nc", one)], "pair string, single string")
    assert len(d.select(mission.two_scenes(F.col("pair"))).first()[0]) == 2
    with pytest.raises(Exception, match="exactly two scenes"):
        d.select(mission.two_scenes(F.col("single"))).collect()
