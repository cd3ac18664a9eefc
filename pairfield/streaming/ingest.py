"""Incremental coverage from a stream of cell files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.coverage import valid


def cell_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(cells: DataFrame, missing: tuple[float, ...] = ()) -> DataFrame:
    """Valid cells per pixel so far; the state is one row per pixel, whatever the number of observations."""
    return cells.filter(valid([F.col("v")], missing)).groupBy("y", "x").agg(F.count("*").alias("valid_count"))


def windowed_counts(cells: DataFrame, late: str = "30 days", width: str = "30 days") -> DataFrame:
    """Observations per mission and window of their midpoint; windows end once the watermark has passed them."""
    return cells.withWatermark("mid_date", late).groupBy(F.window("mid_date", width), "mission").agg(F.count("*").alias("n_observations"))


def run_available(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Processes what has arrived into a memory table and ends; run again with the same checkpoint to go on."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
