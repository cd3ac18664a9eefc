"""How often each pixel could have been seen: pairs' overlapping footprints, widened, counted per pixel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import convex_overlap, ring_area

POINTS = "array<struct<x:double,y:double>>"


def pair_overlaps(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """(pair_id, ring) for pairs (pair_id, scene1, scene2) whose footprints meet; scenes: (scene, ring).

    Each ring is convex and closed. A touching overlap has an area of 0 but counts. Scenes that aren't known are an error
    for the caller: see unresolved().
    """
    one, two = (scenes.select(F.col("scene").alias(f"scene{i}"), F.col("ring").alias(f"ring{i}")) for i in (1, 2))
    rows = pairs.join(one, "scene1").join(two, "scene2").select("pair_id", "ring1", "ring2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = lambda ring: [(p["x"], p["y"]) for p in ring]
        for b in batches:
            made = [convex_overlap(points(r1), points(r2)) for r1, r2 in zip(b["ring1"], b["ring2"], strict=True)]
            yield pd.DataFrame({"pair_id": b["pair_id"], "ring": [[{"x": x, "y": y} for x, y in r] for r in made], "area": [ring_area(r) for r in made]})

    return rows.mapInPandas(run, f"pair_id string, ring {POINTS}, area double").filter(F.size("ring") > 0)


def unresolved(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scenes of pairs without a footprint, in order."""
    asked = pairs.select(F.explode(F.array("scene1", "scene2")).alias("scene")).distinct()
    return asked.join(scenes.select("scene"), "scene", "left_anti").orderBy("scene")


def _squared_distance() -> str:
    """SQL for the least squared distance of (px, py) to the edges of ring."""
    along = "greatest(0D, least(1D, coalesce(try_divide((px - a.x) * (b.x - a.x) + (py - a.y) * (b.y - a.y), pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 0D)))"
    edge = f"pow(px - a.x - {along} * (b.x - a.x), 2) + pow(py - a.y - {along} * (b.y - a.y), 2)"
    return f"array_min(zip_with(slice(ring, 1, size(ring) - 1), slice(ring, 2, size(ring) - 1), (a, b) -> {edge}))"


def _inside() -> str:
    """SQL for whether (px, py) is on one side of all edges of a convex ring."""
    turn = "zip_with(slice(ring, 1, size(ring) - 1), slice(ring, 2, size(ring) - 1), (a, b) -> (b.x - a.x) * (py - a.y) - (b.y - a.y) * (px - a.x))"
    return f"(forall({turn}, s -> s >= 0) OR forall({turn}, s -> s <= 0)) AND exists({turn}, s -> s <> 0)"


def opportunities(overlaps: DataFrame, pixels: DataFrame, buffer: float, cell: float) -> DataFrame:
    """(y, x, opportunity_count): how many overlaps lie within buffer of each pixel that has any.

    Overlaps and pixels meet by equality on square cells of a given size, then by exact distance, so no pair of far
    places is ever made. Distance is Euclidean: rounded corners are true arcs.
    """
    low = lambda axis: F.array_min(F.transform("ring", lambda p: p[axis])) - buffer
    high = lambda axis: F.array_max(F.transform("ring", lambda p: p[axis])) + buffer
    span = lambda axis: F.explode(F.sequence(F.floor(low(axis) / cell), F.floor(high(axis) / cell)))
    spread = overlaps.withColumn("__cx", span("x")).withColumn("__cy", span("y"))
    places = pixels.select("y", "x", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    places = places.withColumn("__cx", F.floor(F.col("px") / cell)).withColumn("__cy", F.floor(F.col("py") / cell))
    near = F.expr(f"({_inside()}) OR {_squared_distance()} <= {float(buffer) ** 2!r}D")
    return spread.join(places, ["__cx", "__cy"]).filter(near).groupBy("y", "x").agg(F.count("*").alias("opportunity_count"))


def violations(coverage: DataFrame, opportunity: DataFrame) -> DataFrame:
    """One row: pixels counted more often than they could have been seen, the greatest excess, and the totals."""
    rows = coverage.join(opportunity, ["y", "x"], "left").withColumn("o", F.coalesce("opportunity_count", F.lit(0)))
    over = F.col("valid_count") - F.col("o")
    return rows.agg(F.count("*").alias("pixels"), F.count_if(over > 0).alias("violations"), F.coalesce(F.max(over), F.lit(0)).cast("long").alias("max_excess"), F.sum("o").cast("long").alias("opportunities"))


def summary(pairs: DataFrame, overlaps: DataFrame) -> DataFrame:
    """One row: distinct pairs and scenes, and pairs whose footprints meet."""
    scenes = pairs.select(F.explode(F.array("scene1", "scene2")).alias("scene"))
    left = pairs.agg(F.count_distinct("pair_id").alias("unique_pairs"))
    middle = scenes.agg(F.count_distinct("scene").alias("unique_scenes"))
    return left.crossJoin(middle).crossJoin(overlaps.agg(F.count_distinct("pair_id").alias("nonempty_overlaps")))  # one row each
