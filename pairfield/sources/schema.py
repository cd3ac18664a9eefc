"""Resolves the columns of an observation or cell table by name, whatever their spelling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accepted names in order of preference.
CANDIDATES: dict[str, tuple[str, ...]] = {
    "x": ("x", "projection_x_coordinate", "easting"),
    "y": ("y", "projection_y_coordinate", "northing"),
    "v": ("v", "velocity", "speed"),
    "vx": ("vx", "v_x", "velocity_x"),
    "vy": ("vy", "v_y", "velocity_y"),
    "mid_date": ("date_center", "mid_date", "time"),
    "date_img1": ("acquisition_date_img1", "date_img1", "date_1"),
    "date_img2": ("acquisition_date_img2", "date_img2", "date_2"),
    "pair_days": ("date_dt", "pair_dt", "pair_interval", "pair_days"),
    "mission_img1": ("mission_img1",),
    "mission_img2": ("mission_img2",),
    "satellite_img1": ("satellite_img1",),
    "satellite_img2": ("satellite_img2",),
    "sensor_img1": ("sensor_img1",),
    "sensor_img2": ("sensor_img2",),
    "image_pair_id": ("image_pair_id", "granule_url", "pair_id"),
    "observation_index": ("observation_index", "obs", "observation"),
    "v_error": ("v_error", "velocity_error"),
}


@dataclass(frozen=True)
class Resolved:
    """The actual column for each known name; None where the table has none."""

    columns: dict[str, str | None]

    def __getitem__(self, name: str) -> str | None:
        return self.columns[name]

    def velocity(self) -> tuple[str, ...]:
        """The speed, or both its components."""
        if self["v"]:
            return (self["v"],)
        if self["vx"] and self["vy"]:
            return (self["vx"], self["vy"])
        raise ValueError("neither a speed nor both components of velocity were found")


def resolve(df: DataFrame, overrides: dict[str, str] | None = None) -> Resolved:
    """Case-insensitive first match over the candidates; an override must exist."""
    by_lower = {c.lower(): c for c in df.columns}
    found: dict[str, str | None] = {}
    for name, options in CANDIDATES.items():
        wanted = (overrides or {}).get(name)
        if wanted and wanted.lower() not in by_lower:
            raise ValueError(f"there is no column {wanted}")
        found[name] = next((by_lower[o] for o in ((wanted.lower(),) if wanted else options) if o in by_lower), None)
    return Resolved(found)


def renamed(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """The table with known columns under their own names; metadata that are missing become nulls."""
    found = resolve(df, overrides)
    known = [F.col(f"`{actual}`").alias(name) if actual else F.lit(None).cast("string").alias(name) for name, actual in found.columns.items()]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in set(found.columns.values())]
    return df.select(*known, *rest)


def numeric_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Requested columns in order, each once; a missing or non-numeric one is an error."""
    kinds = dict(df.dtypes)
    wanted = list(dict.fromkeys(names))
    if missing := [n for n in wanted if n not in kinds]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if odd := [n for n in wanted if kinds[n].split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "decimal")]:
        raise ValueError(f"not numeric: {', '.join(odd)}")
    return wanted
