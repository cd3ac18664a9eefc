"""Footprints, resumable blocks, exports, stacks and the stream."""

import pytest
from pyspark.sql import functions as F

from pairfield.functions import geo
from pairfield.plans import footprints, runs
from pairfield.sources import tables
from pairfield.streaming import ingest


def ring(*box):
    return [{"x": x, "y": y} for x, y in geo.densified_ring(*box, 1)]


def test_opportunities(spark):
    scenes = spark.createDataFrame([("s", ring(0.0, 0.0, 4.0, 4.0)), ("t", ring(2.0, 0.0, 6.0, 4.0)), ("u", ring(4.0, 0.0, 9.0, 4.0)), ("w", ring(20.0, 0.0, 22.0, 4.0))], f"scene string, ring {footprints.POINTS}")
    pairs = spark.createDataFrame([("st", "s", "t"), ("su", "s", "u"), ("sw", "s", "w")], "pair_id string, scene1 string, scene2 string")
    overlaps = footprints.pair_overlaps(pairs, scenes)
    assert {r["pair_id"]: r["area"] for r in overlaps.collect()} == {"st": 8.0, "su": 0.0}
    pixels = spark.createDataFrame([(1, x) for x in range(8)], "y long, x long")
    made = {r["x"]: r["opportunity_count"] for r in footprints.opportunities(overlaps, pixels, 1.0, 3.0).collect()}
    assert made == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2}
    cover = spark.createDataFrame([(1, 4, 3), (1, 7, 1), (1, 1, 0)], "y long, x long, valid_count long")
    r = footprints.violations(cover, footprints.opportunities(overlaps, pixels, 1.0, 3.0)).first()
    assert (r["violations"], r["max_excess"], r["opportunities"]) == (2, 1, 3)
    assert [r["scene"] for r in footprints.unresolved(pairs, scenes.filter("scene < 't'")).collect()] == ["t", "u", "w"]


def test_pending_blocks(spark):
    places = spark.createDataFrame([("a", y, x) for y in range(4) for x in range(4)], "cube_id string, y long, x long")
    wanted = runs.with_fingerprint(runs.blocks(places, 2).withColumn("size", F.lit(2)), ["size"]).drop("size")
    assert wanted.count() == 4
    done = wanted.limit(3).withColumn("status", F.lit("complete"))
    assert runs.pending(wanted, done).count() == 1
    assert runs.pending(wanted, done.withColumn("fingerprint", F.lit("other"))).count() == 4


def test_export(spark, tmp_path):
    cells = spark.createDataFrame([("a", o, y, x, float(y * 4 + x)) for o in range(2) for y in range(3) for x in range(4)], "cube_id string, observation_index long, y long, x long, v double")
    plan = runs.export_plan(cells, cells, {"v": "double"})
    assert plan.first()["estimated_bytes"] == 2 * 12 * 8 and runs.enforce_size(plan) == 192
    with pytest.raises(ValueError):
        runs.enforce_size(plan, limit=100)
    runs.export(cells, F.col("x") < 2, ["v", "v"], str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.count() == 24 and back.filter("v is not null").count() == 12
    with pytest.raises(Exception, match="exist"):
        runs.export(cells, F.lit(True), ["v"], str(tmp_path / "e"))


def test_stack(spark):
    df = spark.createDataFrame([(1, "2020-01-02", "b"), (1, "2020-01-01", "c"), (1, "2020-01-02", "a")], "group int, time string, name string")
    assert {r["name"]: r["time_index"] for r in runs.stack(df).collect()} == {"c": 0, "a": 1, "b": 2}


def test_tables(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 5, 1), ("b", 1, 250, 3)], "cube_id string, observation_index long, y long, x long")
    tables.write_cells(cells, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("cube_id = 'b'").count() == 1
    tables.write_csv(cells, str(tmp_path / "v"), ["y", "x"])
    assert tables.read_csv(spark, str(tmp_path / "v"), "y long, x long").count() == 2
    assert [r["y"] for r in tables.north_up(cells).collect()] == [250, 5]
    assert {r["name"]: r["max"] for r in tables.describe(cells).collect()}["y"] == "250"
    with pytest.raises(ValueError):
        tables.require(cells, "y > 100", "too far")
    assert [r["y"] for r in tables.missing(cells.select("y"), cells.filter("x = 1"), "y").collect()] == [250]


def test_stream_equals_batch(spark, tmp_path):
    cells = spark.createDataFrame([(i % 3, i % 2, None if i % 5 == 0 else float(i)) for i in range(40)], "y int, x int, v double")
    cells.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ingest.cell_stream(spark, str(tmp_path / "in"), "y int, x int, v double", 1)
    ingest.run_available(ingest.running_counts(stream), "cells_so_far", str(tmp_path / "ck")).awaitTermination()
    key = lambda r: (r["y"], r["x"], r["valid_count"])
    assert sorted(map(key, spark.table("cells_so_far").collect())) == sorted(map(key, ingest.running_counts(cells).collect()))


def test_cell_cache(spark, tmp_path):
    cells = spark.createDataFrame([("a", 3, 4, 1, True, 1.0), ("a", 8, 4, 2, False, -4.0), ("a", 8, 4, 3, True, None)], "cube_id string, observation_index long, y long, x long, valid boolean, sigma double")
    path = str(tmp_path / "cache")
    assert runs.open_cell_cache(cells, path, "f")[1] == "absent"
    with pytest.raises(ValueError):
        runs.open_cell_cache(cells, path, "f", mode="require")
    runs.write_cell_cache(cells, path, "f")
    rows, why = runs.open_cell_cache(cells, path, "f", floor=1.5)
    assert why == "used" and sorted((r["x"], r["sigma"]) for r in rows.collect()) == [(1, 1.5), (2, 4.0), (3, None)]
    assert runs.open_cell_cache(cells, path, "other")[1] == "of another run" and runs.open_cell_cache(cells, path, "f", mode="off")[1] == "off"


def test_footprint_summary(spark):
    pairs = spark.createDataFrame([("p", "s", "t"), ("q", "s", "u")], "pair_id string, scene1 string, scene2 string")
    assert footprints.summary(pairs, pairs.filter("pair_id = 'p'")).first().asDict() == {"unique_pairs": 2, "unique_scenes": 3, "nonempty_overlaps": 1}


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    assert tables.file_digests(spark, str(tmp_path / "f.bin")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    tables.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert tables.read_json(spark, str(tmp_path / "j"), "a int, b string").first()["a"] == 1
