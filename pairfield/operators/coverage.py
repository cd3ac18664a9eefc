"""Counts of valid measurements per pixel inside a region, their fractions and statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = (1, 5, 10, 20, 50)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def valid(velocity: Iterable[Column], missing: Iterable[float] = ()) -> Column:
    """Every component is finite and none of the values declared missing."""
    out = F.lit(True)
    for c in velocity:
        d = c.cast("double")
        out = out & finite(d)
        for m in missing:
            out = out & (d != float(m))
    return out


def in_box(west: float, south: float, east: float, north: float) -> Column:
    """The closed box; as ranges, so it reaches the scan."""
    return F.col("x").between(west, east) & F.col("y").between(south, north)


def grid(pixels: DataFrame, region: Column) -> DataFrame:
    """The distinct pixels of a table of places within a region."""
    return pixels.filter(region).select("y", "x").distinct()


def counts(cells: DataFrame, is_valid: Column, region: Column) -> DataFrame:
    """Valid cells per pixel that has any; partial counts come before the shuffle."""
    return cells.filter(region & is_valid).groupBy("y", "x").agg(F.count("*").alias("valid_count"))


def coverage(cells: DataFrame, places: DataFrame, is_valid: Column, region: Column) -> DataFrame:
    """(y, x, valid_count) for all pixels of the region; those without a valid cell have a genuine 0.

    The grid holds pixels, not observations, so restoring it costs one row per pixel.
    """
    return grid(places, region).join(counts(cells, is_valid, region), ["y", "x"], "left").select("y", "x", F.coalesce("valid_count", F.lit(0)).cast("long").alias("valid_count"))


def fraction(pixels: DataFrame, n_selected: DataFrame) -> DataFrame:
    """Adds valid_fraction: the count over the number of selected observations, present at the pixel or not.

    n_selected has the one column n of one row. Without observations the fraction is null.
    """
    return pixels.crossJoin(F.broadcast(n_selected)).withColumn("valid_fraction", F.when(F.col("n") > 0, F.col("valid_count") / F.col("n"))).drop("n")


def statistics(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    c = F.col("valid_count")
    return pixels.groupBy(*(by or [])).agg(
        F.count("*").alias("pixel_count"),
        F.min(c).alias("min_count"),
        F.max(c).alias("max_count"),
        F.avg(c).alias("mean_count"),
        F.percentile(c, 0.5).alias("median_count"),
        F.percentile(c, 0.25).alias("p25_count"),
        F.percentile(c, 0.75).alias("p75_count"),
    )


def shares(pixels: DataFrame, thresholds: Iterable[int] = THRESHOLDS) -> DataFrame:
    """The share of pixels with at least so many valid cells."""
    return pixels.agg(*[F.avg((F.col("valid_count") >= t).cast("double")).alias(f"share_ge_{t}") for t in thresholds])


def duration_bin(days: Column, edges: tuple[float, ...]) -> Column:
    """The number of the half-open bin: above one edge, up to the next; beyond the last one is a bin too; null has none."""
    out = None
    for i, e in enumerate(edges):
        out = F.when(days <= e, i) if out is None else out.when(days <= e, i)
    return F.when(days.isNotNull(), out.otherwise(len(edges)))
