"""Resumable runs, export plans and granule stacks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, human_bytes

SIZE_LIMIT = 50 * 1024**3
#: Bytes of a value by type.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def with_fingerprint(settings: DataFrame, columns: list[str]) -> DataFrame:
    return settings.withColumn("fingerprint", fingerprint(*[F.col(c) for c in sorted(columns)]))


def pending(wanted: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Blocks of (cube_id, block_id, fingerprint) without a completed checkpoint of the same fingerprint."""
    done = checkpoints.filter("status = 'complete'").select("cube_id", "block_id", "fingerprint")
    return wanted.join(done, ["cube_id", "block_id", "fingerprint"], "left_anti")


def blocks(places: DataFrame, size: int) -> DataFrame:
    """The distinct blocks of a cube's pixels."""
    name = F.format_string("%d:%d", F.floor(F.col("y") / size), F.floor(F.col("x") / size))
    return places.select("cube_id", name.alias("block_id")).distinct()


def export_plan(observations: DataFrame, places: DataFrame, variables: dict[str, str]) -> DataFrame:
    """Per cube: observations, extent, pixels and uncompressed bytes. variables: types by name."""
    width = sum(WIDTHS[t] for t in variables.values())
    n = observations.groupBy("cube_id").agg(F.count_distinct("observation_index").alias("n_observations"))
    box = places.groupBy("cube_id").agg(F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.count_distinct("y", "x").alias("n_pixels"))
    area = (F.col("max_y") - F.col("min_y") + 1) * (F.col("max_x") - F.col("min_x") + 1)
    rows = n.join(box, "cube_id").withColumn("estimated_bytes", (F.col("n_observations") * area * width).cast("long"))
    return rows.withColumn("estimated_human", human_bytes(F.col("estimated_bytes"), fixed=True))


def enforce_size(plan: DataFrame, allow_large: bool = False, limit: int = SIZE_LIMIT) -> int:
    total = plan.agg(F.coalesce(F.sum("estimated_bytes"), F.lit(0)).alias("n")).first()["n"]
    if total > limit and not allow_large:
        raise ValueError(f"the export is estimated at {total} bytes, above the limit of {limit}; narrow it or allow it")
    return int(total)


def export(cells: DataFrame, region, variables: list[str], path: str, overwrite: bool = False) -> None:
    """Writes selected variables of all cells by cube; values outside the region become null."""
    masked = [F.when(region, F.col(v)).alias(v) for v in dict.fromkeys(variables)]
    rows = cells.select("cube_id", "observation_index", "y", "x", region.alias("in_region"), *masked)
    rows.write.partitionBy("cube_id").parquet(path, mode="overwrite" if overwrite else "error")


def stack(granules: DataFrame) -> DataFrame:
    """Numbers granules by time, then name, from 0, within each group."""
    return granules.withColumn("time_index", F.row_number().over(Window.partitionBy("group").orderBy("time", "name")) - 1)


def write_cell_cache(cells: DataFrame, path: str, run: str, overwrite: bool = False) -> None:
    """Validity and error of selected cells, with the run's fingerprint, for later plans over the same selection."""
    rows = cells.select("cube_id", "observation_index", "y", "x", "valid", F.col("sigma").cast("float").alias("sigma"))
    rows.withColumn("fingerprint", F.lit(run)).write.partitionBy("cube_id").parquet(path, mode="overwrite" if overwrite else "error")


def open_cell_cache(cells: DataFrame, path: str, run: str, floor: float = 0.0, mode: str = "auto") -> tuple[DataFrame, str]:
    """Cached cells if they are of this run, else those given (valid and sigma), and why; errors raised to a floor.

    mode: auto, require (a cache that doesn't fit is an error) or off.
    """
    if mode not in ("auto", "require", "off"):
        raise ValueError("a cache is auto, require or off")
    spark, why, rows = cells.sparkSession, "off", cells
    if mode != "off":
        try:
            cached = spark.read.parquet(path)
            other = cached.filter(F.col("fingerprint") != run).limit(1).count()
            why = "of another run" if other else "used"
            rows = cells if other else cached.drop("fingerprint")
        except AnalysisException:
            why = "absent"
        if mode == "require" and why != "used":
            raise ValueError(f"the cell cache is {why}")
    sigma = F.when(F.col("sigma").isNotNull(), F.greatest(F.abs("sigma"), F.lit(float(floor))))
    return rows.withColumn("sigma", sigma), why
