"""The engine's programs as functions: inventory, coverage, multi-cube coverage, comparison, export, stack, diagnostics.

Each takes DataFrames and options, checks the options, and returns lazy DataFrames; only what an answer needs to be
checked (an ambiguity, a guard, a fingerprint) runs at once.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .functions.text import fingerprint
from .functions.time import bounds, decimal_year, template_dates
from .operators import coverage as cov
from .operators import inventory as inv
from .operators import mosaic as mos
from .operators import observations as obs
from .plans import inversion, runs
from .sources.schema import numeric_columns, renamed, resolve


@dataclass(frozen=True)
class Region:
    """A closed box in grid coordinates, or in longitude and latitude; the latter is tested on inverse-projected places."""

    west: float
    south: float
    east: float
    north: float
    lonlat: bool = False
    edge_points: int = 41

    def __post_init__(self):
        if not self.south < self.north or not self.lonlat and not self.west < self.east:
            raise ValueError("a region needs west < east and south < north")
        if self.lonlat:
            geo.lonlat_rings(self.west, self.south, self.east, self.north)

    def contains(self, x: Column | None = None, y: Column | None = None) -> Column:
        x, y = F.col("x") if x is None else x, F.col("y") if y is None else y
        if not self.lonlat:
            return x.between(self.west, self.east) & y.between(self.south, self.north)
        lon, lat = geo.from_polar(x, y)
        across = (lon >= self.west) | (lon <= self.east) if self.west > self.east else lon.between(self.west, self.east)
        return across & lat.between(self.south, self.north)

    def geojson(self) -> str:
        """The region's outline, densified, as a feature; two polygons across the antimeridian."""
        if self.lonlat:
            rings = geo.lonlat_rings(self.west, self.south, self.east, self.north)
        else:
            rings = [geo.densified_ring(self.west, self.south, self.east, self.north, self.edge_points)]
        kind, places = ("Polygon", [rings[0]]) if len(rings) == 1 else ("MultiPolygon", [[r] for r in rings])
        return json.dumps({"type": "Feature", "properties": {"lonlat": self.lonlat}, "geometry": {"type": kind, "coordinates": places}}, sort_keys=True)


@dataclass(frozen=True)
class CoverageOptions:
    selection: obs.Selection
    region: Region
    missing: tuple[float, ...] = ()
    block: int = 100

    def __post_init__(self):
        bounds(self.selection.start, self.selection.end)
        low, high = self.selection.least_days, self.selection.most_days
        if (low is not None and low < 0) or (low is not None and high is not None and low > high) or self.block < 1:
            raise ValueError("durations are not negative and rise; a block has a pixel at least")

    def fingerprint(self) -> str:
        """SHA-256 of the options in canonical form; runs with the same one may share results."""
        import hashlib

        return hashlib.sha256(json.dumps(json_safe(asdict(self)), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def json_safe(value):
    """Values for JSON: numbers that aren't finite, and what JSON has no form for, become text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if value is None or isinstance(value, (str, int, bool)):
        return value
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    return str(value)


@dataclass
class Coverage:
    """What a coverage run gives."""

    pixels: DataFrame
    statistics: DataFrame
    shares: DataFrame
    funnel: DataFrame
    selected: DataFrame
    options: CoverageOptions = field(repr=False)


def inventory(records: DataFrame, start: str, end: str, mission: str | None = None, least_days: float | None = None, most_days: float | None = None, least_valid: float | None = None, max_items: int | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Matching granule records and their size summary. max_items limits what the catalogue gives, before local filters."""
    if max_items is not None and max_items < 1 or least_valid is not None and not 0 <= least_valid <= 100:
        raise ValueError("a limit is at least 1 and a share between 0 and 100")
    found = records if max_items is None else records.limit(max_items)
    kept = inv.matching(found, start, end, mission, least_days, most_days, least_valid, strict)
    return kept, inv.size_summary(kept)


def velocity(cells: DataFrame) -> list[Column]:
    """The speed, or both components where there is none."""
    return [F.col(c) for c in resolve(cells).velocity()]


def coverage(cells: DataFrame, places: DataFrame, options: CoverageOptions) -> Coverage:
    """Valid counts and fractions per pixel of the region, from cells that carry their observation's metadata.

    places: the pixels of the grid (y, x), which need not all have a cell. The fraction's denominator is the number of
    selected observations, counted over the whole cube. Where cells have a cube_id, an index is one observation per cube.
    """
    chosen = obs.selected(cells, options.selection)
    key = [c for c in ("cube_id", "observation_index") if c in cells.columns]
    region = options.region.contains()
    n = chosen.agg(F.count_distinct(F.struct(*key)).alias("n"))
    pixels = cov.fraction(cov.coverage(chosen, places, cov.valid(velocity(cells), options.missing), region), n)
    observations = cells.dropDuplicates(key)
    return Coverage(pixels, cov.statistics(pixels), cov.shares(pixels), obs.funnel(observations, options.selection), chosen.dropDuplicates(key), options)


def multi_coverage(cells: DataFrame, tiles: DataFrame, pixels: DataFrame, options: CoverageOptions, strip: float) -> tuple[DataFrame, DataFrame]:
    """Per-tile counts mosaicked to one grid, and the de-duplicated inventory of the selected observations.

    cells and tiles share cube_id; tiles: (cube_id, xmin, ymin, xmax, ymax, x0, y0, dx, dy, nx, ny); cells have row and
    col within their tile. All tiles are one job. A pixel of the region that no tile owns keeps a null count.
    """
    chosen = obs.selected(cells, options.selection)
    ok = cov.valid(velocity(cells), options.missing)
    source = chosen.groupBy(F.col("cube_id").alias("tile_id"), "row", "col").agg(F.count_if(ok).alias("value"))
    shaped = tiles.withColumnRenamed("cube_id", "tile_id")
    inside = pixels.filter(options.region.contains())
    owned = mos.owned(inside, shaped.select("tile_id", "xmin", "ymin", "xmax", "ymax"), strip)
    made = mos.sampled(owned, shaped.select("tile_id", "x0", "y0", "dx", "dy", "nx", "ny"), source)
    full = inside.select("y", "x").join(made, ["y", "x"], "left")
    count = F.when(F.col("tile_id").isNotNull(), F.coalesce("value", F.lit(0)))
    return full.select("y", "x", "tile_id", count.alias("valid_count")), obs.deduplicated(chosen.dropDuplicates(["cube_id", "observation_index"]))


def unassigned(mosaic: DataFrame) -> int:
    """Pixels of the region that no tile owns; a complete mosaic has none."""
    return mosaic.filter("valid_count IS NULL").count()


def compare_durations(cells: DataFrame, places: DataFrame, region: Region, start: str, end: str, edges: tuple[float, ...] = (12.0, 36.0, 96.0), missing: tuple[float, ...] = ()) -> DataFrame:
    """Statistics per mission and duration bin over the full grid, from one pass; the run's other filters are ignored."""
    ok = cov.valid(velocity(cells), missing)
    rows = obs.selected(cells, obs.Selection(start, end)).filter("same_mission")
    group = F.when(F.col("mission").startswith("LANDSAT-"), "LANDSAT").otherwise(F.col("mission"))
    rows = rows.withColumn("mission_group", group).withColumn("duration_bin", cov.duration_bin(F.col("pair_days"), edges))
    counts = rows.filter(region.contains() & ok & F.col("duration_bin").isNotNull()).groupBy("mission_group", "duration_bin", "y", "x").agg(F.count("*").alias("n"))
    selected = rows.groupBy("mission_group", "duration_bin").agg(F.count_distinct("observation_index").alias("selected_observations"))
    groups = rows.select("mission_group").distinct().crossJoin(F.broadcast(rows.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("duration_bin"))))
    grid = cov.grid(places, region.contains()).crossJoin(F.broadcast(groups))  # missions and bins are a dozen rows
    full = grid.join(counts, ["mission_group", "duration_bin", "y", "x"], "left").withColumn("valid_count", F.coalesce("n", F.lit(0)))
    return cov.statistics(full, ["mission_group", "duration_bin"]).join(selected, ["mission_group", "duration_bin"], "left").fillna(0, ["selected_observations"])


def export(cells: DataFrame, options: CoverageOptions, variables: list[str], path: str, dry_run: bool = False, allow_large: bool = False, overwrite: bool = False) -> DataFrame:
    """Plans, guards and writes an export of the selected cells; returns the plan."""
    names = numeric_columns(cells, variables)
    chosen = obs.selected(cells, options.selection)
    kinds = dict(cells.dtypes)
    inside = chosen.filter(options.region.contains())
    plan = runs.export_plan(inside, inside.select("cube_id", "y", "x"), {n: kinds[n] for n in names})
    runs.enforce_size(plan, allow_large)
    if not dry_run:
        runs.export(chosen, options.region.contains(), names, path, overwrite)
    return plan


def replay(cells: DataFrame, dedup: DataFrame) -> DataFrame:
    """The cells of a finished run's observations; raises unless all are found under the same keys."""
    places = obs.replay_places(dedup)
    bad = obs.replay_check(places, cells).filter("out_of_range > 0 OR mismatched > 0").orderBy("cube_id").limit(5).collect()
    if bad:
        raise ValueError(f"the inventory doesn't fit the cubes: {', '.join(r['cube_id'] for r in bad)}")
    return cells.join(places.select("cube_id", "observation_index"), ["cube_id", "observation_index"], "left_semi")


def error_column(cells: DataFrame, velocity_name: str = "v", choice: str = "auto") -> Column:
    """The error of a velocity: by its usual name, a named column, or 1 everywhere (unit)."""
    if choice == "unit":
        return F.lit(1.0)
    name = f"{velocity_name}_error" if choice == "auto" else choice
    if name not in cells.columns:
        raise ValueError(f"there is no error column {name}; name one")
    return F.col(name).cast("double")


@dataclass(frozen=True)
class TemplateOptions:
    """Dates and basis of a temporal model, with prior standard deviations by group; inf means no prior."""

    start: str
    end: str
    step_days: int = 1
    degree: int = 1
    periods: tuple[float, ...] = ()
    quantity: str = "velocity"
    prior_std: dict[str, float] = field(default_factory=dict)
    ridge_groups: tuple[str, ...] = ()

    def names(self) -> list[str]:
        rest = [n for p in self.periods for n in (f"seasonal_sin_{p:g}", f"seasonal_cos_{p:g}")]
        return [f"{i:03d}_{n}" for i, n in enumerate([*(f"poly_{d}" for d in range(self.degree + 1)), *rest])]

    def precision(self, ridge: float = 0.0) -> np.ndarray:
        group = ["poly"] * (self.degree + 1) + ["seasonal"] * (2 * len(self.periods))
        std = [self.prior_std.get(g, math.inf) for g in group]
        return inversion.prior_precision([s * s for s in std], [float(g in self.ridge_groups) for g in group], ridge)


def build_template(spark: SparkSession, options: TemplateOptions) -> DataFrame:
    dates = spark.createDataFrame([(d,) for d in template_dates(options.start, options.end, options.step_days)], "d timestamp_ntz")
    years = sorted(r["t"] for r in dates.select(decimal_year(F.col("d")).alias("t")).collect())  # a row per date
    template = inversion.build_template(spark, years, options.degree, options.periods)
    inversion.check_template(template)
    return template


def diagnostics(cells: DataFrame, template: DataFrame, options: TemplateOptions, operators: list[str] | None = None, ridge: float = 0.0, error: str = "auto", floor: float = 0.0, missing: tuple[float, ...] = ()) -> DataFrame:
    """The seven metrics per pixel and observation operator, in rows (operator, y, x, metrics...)."""
    names = inversion.operators_for(options.quantity, operators)
    sigma = F.abs(error_column(cells, "v", error))
    sigma = F.when(sigma.isNotNull(), F.greatest(sigma, F.lit(float(floor))))
    dated = cells.withColumn("t1", decimal_year(F.col("date_img1"))).withColumn("t2", decimal_year(F.col("date_img2")))
    bad, outside = dated.crossJoin(F.broadcast(template.agg(F.min("t").alias("__lo"), F.max("t").alias("__hi")))).agg(
        F.count_if(F.col("t2") <= F.col("t1")), F.count_if((F.col("t1") < F.col("__lo")) | (F.col("t2") > F.col("__hi")))
    ).first()
    if bad or outside:
        raise ValueError(f"{bad} pairs have no positive duration, {outside} leave the template")
    basis = template if options.quantity == "velocity" else inversion.gradient(template)
    prediction = np.array([r["g"] for r in basis.orderBy("t").collect()])  # a row per template date
    ok, k, parts = cov.valid([F.col("v")], missing), prediction.shape[1], []
    for name in names:
        rows = inversion.design(dated, template, name).select("y", "x", "g", sigma.alias("sigma"), ok.alias("valid"))
        made = inversion.posterior_metrics(inversion.normal_matrix(rows, k), options.precision(ridge), prediction)
        parts.append(made.select(F.lit(name).alias("operator"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cube_url(assets: Column) -> Column:
    """A cube's link: of the assets zarr, v, vx, vy the first that is there, else the first link to a Zarr store."""
    named = F.coalesce(*[assets[n]["href"] for n in ("zarr", "v", "vx", "vy")])
    other = F.get(F.filter(F.map_values(assets), lambda a: a["href"].contains(".zarr")), F.lit(0))["href"]
    return F.coalesce(named, other)


def manifest(spark: SparkSession, options: CoverageOptions, cubes: DataFrame) -> DataFrame:
    """A row per cube with the run's and the cube's fingerprints, to be written beside results and compared on resuming."""
    run = F.lit(options.fingerprint())
    return cubes.select("cube_id", run.alias("run_fingerprint")).withColumn("fingerprint", fingerprint(F.col("cube_id"), F.col("run_fingerprint")))


def observations(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """A table of any accepted spelling as observations with midpoint, duration and missions."""
    return obs.observation_table(renamed(df, overrides))
