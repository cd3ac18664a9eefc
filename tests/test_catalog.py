"""Catalogue records, filters, sizes and downloads."""

import json

from pairfield.operators import inventory as inv
from pairfield.sources import catalog

DAY = "2020-12-20T12:00:00Z"


def records(spark):
    rows = [("a", DAY, "S1A", 12.0), ("b", DAY, "LC08", 12.0), ("c", DAY, "S1B", 24.0), ("d", "2020-12-31T23:59:59Z", "S1B", -12.0), ("e", "2021-01-01T00:00:00Z", "S1A", 12.0), ("f", "when?", "S1A", 12.0), ("g", None, "S1A", 12.0)]
    df = spark.createDataFrame(rows, "item_id string, datetime string, platform string, pair_interval_days double")
    return df.selectExpr("*", "cast(null as string) mid_datetime", "cast(null as string) percent_valid_pixels")


def test_matching(spark):
    kept = inv.matching(records(spark), "2020-11-30", "2020-12-31", "SENTINEL-1", most_days=12)
    assert sorted(r["item_id"] for r in kept.collect()) == ["a", "d"]
    assert inv.matching(records(spark), "2020-11-30", "2020-12-31", "LANDSAT-8").count() == 0
    assert inv.matching(records(spark), "2020-11-30", "2020-12-31", "LANDSAT-8", strict=False).count() == 1
    assert inv.matching(records(spark), "2020-11-30", "2020-12-31", "LANDSAT").count() == 1


def test_search_filter():
    assert catalog.search_filter("SENTINEL-1", most_days=12) == {"op": "and", "args": [{"op": "in", "args": [{"property": "platform"}, ["S1A", "S1B"]]}, {"op": "<=", "args": [{"property": "date_dt"}, 12]}]}
    assert catalog.search_filter() is None and catalog.search_filter("S1A")["op"] == "="


def test_items(spark, tmp_path):
    items = [
        {"id": "i1", "bbox": [1.0, 2.0, 3.0, 4.0], "properties": {"datetime": DAY, "sat:platform": "S1A", "date_dt": "12"}, "assets": {"thumb": {"href": "t.png"}, "data": {"href": "https://h/a.nc", "type": "x", "file:size": "2048", "alternate": {"s3": {"href": "s3://b/a"}}}}},
        {"id": "i2", "bbox": [1.0], "properties": {}, "assets": {"q": {"href": "q.png"}, "r": {"href": "R.NC4", "size": "-1", "content-length": "7"}}},
        {"id": "i3", "properties": {}, "assets": {}},
    ]
    path = tmp_path / "items.ndjson"
    path.write_text("\n".join(map(json.dumps, items)))
    rows = {r["item_id"]: r for r in catalog.granules(spark.read.schema(catalog.ITEM).json(str(path))).collect()}
    a, b, c = rows["i1"], rows["i2"], rows["i3"]
    assert (a["platform"], a["asset_key"], a["asset_size_bytes"], a["asset_size_mib"], a["data_s3_href"], a["bbox_north"]) == ("S1A", "data", 2048, 2048 / 1024**2, "s3://b/a", 4.0)
    assert (b["asset_key"], b["asset_size_bytes"], b["bbox_west"]) == ("r", 7, None)
    assert (c["asset_key"], c["data_href"], c["asset_size_source"]) == (None, None, None)


def test_source_pushes_filters(spark, tmp_path):
    path = tmp_path / "page.ndjson"
    path.write_text("\n".join(json.dumps({"id": str(i), "properties": {"platform": "S1A" if i % 2 else "LC08", "date_dt": i}}) for i in range(10)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(catalog.CatalogSource)
    found = spark.read.format("catalog_pages").load(str(path)).filter("platform = 'S1A' AND date_dt <= 5")
    assert sorted(r["id"] for r in found.collect()) == ["1", "3", "5"]


def test_sizes_and_downloads(spark):
    df = spark.createDataFrame([("a", 10, "stac", "h/a.nc"), ("b", 21, "stac", "h/b.nc"), ("c", None, None, "h/c.nc"), ("d", None, None, None)], "item_id string, asset_size_bytes long, asset_size_source string, data_href string")
    s = inv.size_summary(df).first()
    assert (s["median_bytes"], s["estimated_bytes"], s["estimate_method"].split("_")[0]) == (15, 61, "known")
    assert inv.size_summary(df.filter("asset_size_bytes is null")).first()["estimated_bytes"] is None
    probed = inv.with_probed_sizes(df, spark.createDataFrame([("c", 5)], "item_id string, probed_bytes long"))
    assert {r["item_id"]: r["asset_size_source"] for r in probed.collect()} == {"a": "stac", "b": "stac", "c": "http", "d": None}
    plan = inv.download_plan(df, spark.createDataFrame([("a.nc", 10), ("b.nc", 3)], "name string, bytes long"))
    assert {r["item_id"]: r["action"] for r in plan.collect()} == {"a": "SKIP", "b": "RESUME", "c": "GET", "d": "NO_ASSET"}
