"""Reads, checks and writes tables of cells, observations, manifests and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An inventory with a header row and a given schema; no inference, so no second read."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=not lines)


#: Rows above which a table is never broadcast.
BROADCAST_ROWS = 50_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where at most so many rows were counted; a larger table stays as it is and is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def require(df: DataFrame, bad: str, message: str) -> DataFrame:
    """Fails if any row satisfies bad; otherwise returns df. The check is one aggregation."""
    if n := df.agg(F.count_if(F.expr(bad)).alias("n")).first()["n"]:
        raise ValueError(f"{message}: {n} rows")
    return df


def missing(expected: DataFrame, available: DataFrame, on: str | list[str]) -> DataFrame:
    """Expected rows that aren't available, in order."""
    return expected.join(available.select(on).distinct(), on, "left_anti").orderBy(on)


def write_csv(df: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    df.select(columns).write.csv(path, header=True, mode="overwrite" if overwrite else "error")


def write_cells(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Cells by cube, clustered by place, so that readers skip other cubes and far rows by statistics."""
    rows = df.repartition("cube_id", F.floor(F.col("y") / 100), F.floor(F.col("x") / 100)).sortWithinPartitions("cube_id", "y", "x")
    rows.write.partitionBy("cube_id").parquet(path, mode="overwrite" if overwrite else "error")


def north_up(df: DataFrame) -> DataFrame:
    """Rows as a raster is written: from the top, left to right."""
    return df.orderBy(F.col("y").desc(), F.col("x").asc())


def describe(df: DataFrame, sample: int = 8) -> DataFrame:
    """One row per column: type, count, distinct-free range, and first values in order."""
    stats = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct", "binary", "variant")):
            continue
        first = F.slice(F.sort_array(F.collect_set(c)), 1, sample) if kind in ("boolean", "tinyint") else F.array(F.min(c), F.max(c))
        stats.append(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.count(c).alias("n"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), first.cast("array<string>").alias("values")))
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.json(path, mode="overwrite" if overwrite else "error", ignoreNullFields=False)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, worked out where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
