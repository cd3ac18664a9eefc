"""Tiles put together on one grid: ownership, nearest samples, resampling, containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import nearest_index
from ..sources.tables import broadcast_if_small


def owned(pixels: DataFrame, tiles: DataFrame, step: float) -> DataFrame:
    """Each pixel with the tile whose half-open box holds its centre; of several the last by id.

    Boxes meet pixels by equality on strips of x of a given width, then by range: no nested loop over all tiles, and no
    shuffle of pixels by tile while tiles are few. tiles: (tile_id, xmin, ymin, xmax, ymax).
    """
    strips = F.sequence(F.floor(F.col("xmin") / step), F.floor(F.col("xmax") / step))
    spread = tiles.withColumn("__strip", F.explode(strips))
    rows = pixels.withColumn("__strip", F.floor(F.col("x") / step))
    hit = (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") < F.col("ymax"))
    return rows.join(broadcast_if_small(spread), "__strip").filter(hit).groupBy("y", "x").agg(F.max("tile_id").alias("tile_id"))


def sampled(owned_pixels: DataFrame, tiles: DataFrame, source: DataFrame) -> DataFrame:
    """The value of the nearest source cell of the owning tile, for each pixel; indices beyond a tile give its edge.

    tiles: (tile_id, x0, y0, dx, dy, nx, ny); source: (tile_id, row, col, value). Pixels without a value are left null.
    """
    t = owned_pixels.join(broadcast_if_small(tiles), "tile_id")
    at = t.withColumn("col", nearest_index(F.col("x"), F.col("x0"), F.col("dx"), F.col("nx"))).withColumn("row", nearest_index(F.col("y"), F.col("y0"), F.col("dy"), F.col("ny")))
    return at.join(source, ["tile_id", "row", "col"], "left").select("y", "x", "tile_id", "row", "col", "value")


def bilinear(targets: DataFrame, source: DataFrame) -> DataFrame:
    """Bilinear values at fractional places (fx, fy) of a grid of (ix, iy, value); null unless all needed corners exist.

    Four corner rows per target meet the source by equality.
    """
    x0, y0 = F.floor(F.col("fx")), F.floor(F.col("fy"))
    wx, wy = F.col("fx") - x0, F.col("fy") - y0
    corner = lambda i, j, w: F.struct((x0 + i).alias("ix"), (y0 + j).alias("iy"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - wx) * (1 - wy)), corner(1, 0, wx * (1 - wy)), corner(0, 1, (1 - wx) * wy), corner(1, 1, wx * wy))
    parts = targets.select("target_id", F.explode(F.filter(four, lambda c: c["w"] > 0)).alias("c")).select("target_id", "c.*")
    joined = parts.join(source, ["ix", "iy"], "left").groupBy("target_id")
    return joined.agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def nearest_order(targets: DataFrame, source: DataFrame) -> DataFrame:
    """The value of the nearest grid cell; null outside."""
    rows = targets.withColumn("ix", F.rint("fx").cast("long")).withColumn("iy", F.rint("fy").cast("long"))
    return rows.join(source, ["ix", "iy"], "left").select("target_id", "value")


def cubic(targets: DataFrame, source: DataFrame) -> DataFrame:
    """Cubic convolution (a = -1/2) over 16 neighbours; null unless all with weight exist."""
    x0, y0 = F.floor(F.col("fx")), F.floor(F.col("fy"))

    def kernel(d: Column) -> Column:
        t = F.abs(d)
        return F.when(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1).when(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2).otherwise(0.0)

    cells = [F.struct((x0 + i).alias("ix"), (y0 + j).alias("iy"), (kernel(F.col("fx") - x0 - i) * kernel(F.col("fy") - y0 - j)).alias("w")) for i in range(-1, 3) for j in range(-1, 3)]
    parts = targets.select("target_id", F.explode(F.filter(F.array(*cells), lambda c: c["w"] != 0)).alias("c")).select("target_id", "c.*")
    return parts.join(source, ["ix", "iy"], "left").groupBy("target_id").agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def smallest_container(cubes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """The smallest box that contains the region, by area then id, with the number of equally small ones.

    More than one within a billionth is an ambiguity for the caller to report.
    """
    inside = (F.col("xmin") <= west) & (F.col("ymin") <= south) & (F.col("xmax") >= east) & (F.col("ymax") >= north)
    rows = cubes.filter(inside).withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    least = rows.agg(F.min("area").alias("least"))
    tied = F.abs(F.col("area") - F.col("least")) <= 1e-9 * F.greatest(F.abs("area"), F.abs("least"))
    return rows.crossJoin(F.broadcast(least)).filter(tied).agg(F.min("cube_id").alias("cube_id"), F.min("area").alias("area"), F.count("*").alias("tied"))


def intersecting(cubes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Boxes that share a positive area with the region, by id."""
    return cubes.filter((F.col("xmin") < east) & (F.col("xmax") > west) & (F.col("ymin") < north) & (F.col("ymax") > south)).orderBy("cube_id")


def spacing(axis: DataFrame, by: str, at: str) -> DataFrame:
    """For each series: points, least and greatest step, and whether steps are equal within a billionth."""
    step = F.col(at) - F.lag(at).over(Window.partitionBy(by).orderBy(at))
    rows = axis.withColumn("__step", step)
    low, high = F.min("__step"), F.max("__step")
    return rows.groupBy(by).agg(F.count("*").alias("n_points"), low.alias("min_step"), high.alias("max_step"), (high - low <= 1e-9 * F.abs(high)).alias("regular"))


#: Resampling methods by name.
RESAMPLING = {"nearest": nearest_order, "bilinear": bilinear, "cubic": cubic}
