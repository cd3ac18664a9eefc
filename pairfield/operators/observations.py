"""Observation tables: built from metadata, filtered, counted, keyed, de-duplicated and replayed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mission import mission_matches, normalize_pair_mission
from ..functions.time import days_between, midpoint, within


@dataclass(frozen=True)
class Selection:
    """What to keep: dates of the midpoint, mission of both images, sensor of both images, days between them."""

    start: str
    end: str
    mission: str | None = None
    sensor: str | None = None
    least_days: float | None = None
    most_days: float | None = None


def observation_table(df: DataFrame) -> DataFrame:
    """Adds midpoint, duration and missions to observations whose columns have their own names (sources.schema.renamed).

    A missing midpoint lies between the images; a missing duration is the time between them; pairs of one mission have
    that mission, others are MIXED. What can't be read becomes null, which no range takes.
    """
    first, second = normalize_pair_mission(F.col("mission_img1"), F.col("satellite_img1")), normalize_pair_mission(F.col("mission_img2"), F.col("satellite_img2"))
    days = F.abs(F.col("pair_days").try_cast("double")) if "pair_days" in df.columns else F.lit(None).cast("double")
    middle = F.col("mid_date").cast("timestamp_ntz") if "mid_date" in df.columns else F.lit(None).cast("timestamp_ntz")
    rest = [c for c in df.columns if c not in ("mid_date", "pair_days")]
    return (
        df.withColumn("mission_img1_normalized", first)
        .withColumn("mission_img2_normalized", second)
        .select(
            *rest,
            F.coalesce(middle, midpoint(F.col("date_img1"), F.col("date_img2"))).alias("mid_date"),
            F.coalesce(days, days_between(F.col("date_img1"), F.col("date_img2"))).alias("pair_days"),
            "mission_img1_normalized",
            "mission_img2_normalized",
            F.when(F.col("mission_img1_normalized") == F.col("mission_img2_normalized"), F.col("mission_img1_normalized")).otherwise("MIXED").alias("mission"),
            (F.col("mission_img1_normalized") == F.col("mission_img2_normalized")).alias("same_mission"),
        )
    )


def stages(s: Selection) -> list[tuple[str, Column]]:
    """The filters in their order, each by itself."""
    sensor = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    days = F.lit(True)
    if s.least_days is not None:
        days = days & (F.col("pair_days") >= float(s.least_days))
    if s.most_days is not None:
        days = days & (F.col("pair_days") <= float(s.most_days))
    wanted = (s.sensor or "").strip().upper()
    return [
        ("within_time_range", within(F.col("mid_date"), s.start, s.end)),
        ("matching_mission", F.col("same_mission") & mission_matches(F.col("mission"), s.mission) if s.mission else F.lit(True)),
        ("matching_sensor", (sensor("sensor_img1") == wanted) & (sensor("sensor_img2") == wanted) if s.sensor else F.lit(True)),
        ("matching_pair_duration", days),
    ]


def selected(observations: DataFrame, s: Selection) -> DataFrame:
    """The observations that pass every filter."""
    for _, keep in stages(s):
        observations = observations.filter(keep)
    return observations


def funnel(observations: DataFrame, s: Selection) -> DataFrame:
    """One row: how many observations there are and remain after each filter, from one scan.

    Each row becomes the number of filters that it passes in a row, so a filter is worked out once and only as far as needed.
    """
    names = [name for name, _ in stages(s)]
    passed = F.lit(len(names))
    for i, (_, keep) in reversed(list(enumerate(stages(s)))):
        passed = F.when(keep, passed).otherwise(i)
    return observations.select(passed.alias("__n")).agg(F.count("*").alias("observations_in_cube"), *[F.count_if(F.col("__n") > i).alias(name) for i, name in enumerate(names)])


def check_selection(observations: DataFrame, s: Selection) -> None:
    """Raises where a filter was asked for that the metadata can't answer, from one aggregation."""
    in_range = within(F.col("mid_date"), s.start, s.end) & F.col("same_mission")
    row = observations.agg(
        F.count_if(in_range).alias("known"),
        F.count_if(in_range & (F.col("mission") != "UNKNOWN")).alias("named"),
        F.count("sensor_img1").alias("s1"),
        F.count("sensor_img2").alias("s2"),
        F.count("pair_days").alias("days"),
    ).first()
    if s.mission and row["known"] and not row["named"]:
        raise ValueError("no mission can be read from the metadata")
    if s.sensor and not (row["s1"] and row["s2"]):
        raise ValueError("a sensor was asked for, but pairs have no sensors")
    if (s.least_days is not None or s.most_days is not None) and not row["days"]:
        raise ValueError("a duration was asked for, but none can be resolved")


def mission_inventory(observations: DataFrame, start: str, end: str) -> DataFrame:
    """Observations per mission within a time range, the most frequent first."""
    counted = observations.filter(within(F.col("mid_date"), start, end)).groupBy("mission").agg(F.count("*").alias("n_observations"))
    return counted.orderBy(F.desc("n_observations"), "mission")


KEY_FIELDS = ("mid_date", "date_img1", "date_img2", "pair_days", "mission_img1_normalized", "mission_img2_normalized", "satellite_img1", "satellite_img2")


def observation_key() -> Column:
    """The pair's identifier, or its metadata with empty places for nulls."""
    pair = F.trim(F.coalesce(F.col("image_pair_id"), F.lit("")))
    fields = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY_FIELDS])
    return F.when(pair != "", pair).otherwise(F.concat(F.lit("metadata:"), fields))


def deduplicated(observations: DataFrame) -> DataFrame:
    """One row per observation key: its first index by cube and index, its cubes and all its places.

    A key's places are as many as the cubes that overlap there; they are sorted within the aggregate, so the result
    doesn't depend on how rows arrive.
    """
    keyed = observations.withColumn("observation_key", observation_key())
    place = F.struct("cube_id", "observation_index")
    return keyed.groupBy("observation_key").agg(
        F.min(place)["cube_id"].alias("source_cube_id"),
        F.min(place)["observation_index"].alias("observation_index"),
        F.size(F.collect_set("cube_id")).cast("long").alias("cube_count"),  # a distinct count would shuffle once more
        F.array_join(F.sort_array(F.collect_set("cube_id")), ";").alias("cube_ids"),
        F.to_json(F.sort_array(F.collect_list(place))).alias("cube_observations"),
    )


def cubes_per_key(observations: DataFrame) -> DataFrame:
    """Each observation with the number of cubes that hold its key; counted once per key, then joined back."""
    keyed = observations.withColumn("observation_key", observation_key())
    counts = keyed.groupBy("observation_key").agg(F.size(F.collect_set("cube_id")).cast("long").alias("cube_count"))
    return keyed.join(counts, "observation_key")


def replay_places(inventory: DataFrame) -> DataFrame:
    """(cube_id, observation_index, position): the places of an inventory in order, each once.

    Rows have cube_observations as JSON, or, in older inventories, source_cube_id and observation_index.
    """
    if "cube_observations" in inventory.columns:
        places = F.from_json("cube_observations", "array<struct<cube_id:string,observation_index:bigint>>")
        rows = inventory.select("observation_key", F.posexplode(places).alias("i", "p")).select("observation_key", "i", "p.*")
    else:
        rows = inventory.select("observation_key", F.lit(0).alias("i"), F.col("source_cube_id").alias("cube_id"), "observation_index")
    return rows.groupBy("cube_id", "observation_index").agg(F.min(F.struct("observation_key", "i")).alias("position")).select("cube_id", "observation_index", F.col("position.observation_key").alias("observation_key"))


def replay_check(places: DataFrame, observations: DataFrame) -> DataFrame:
    """Per cube: places asked for, found, out of range, and found under another key."""
    own = observations.select("cube_id", "observation_index", observation_key().alias("__key")).groupBy("cube_id", "observation_index").agg(F.min("__key").alias("__low"), F.max("__key").alias("__high"))
    joined = places.join(own, ["cube_id", "observation_index"], "left")
    return joined.groupBy("cube_id").agg(
        F.count("*").alias("requested"),
        F.count("__low").alias("found"),
        F.count_if(F.col("__low").isNull()).alias("out_of_range"),
        F.count_if(F.col("__low").isNotNull() & ~F.col("observation_key").between(F.col("__low"), F.col("__high"))).alias("mismatched"),
    )


def renumbered(observations: DataFrame) -> DataFrame:
    """New indices from 0 within each cube, in the order of the old ones."""
    order = Window.partitionBy("cube_id").orderBy("observation_index")
    return observations.withColumn("new_index", F.row_number().over(order) - 1)
