"""Sizes, links, headers and fingerprints as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def human_bytes(n: Column, fixed: bool = False) -> Column:
    """A size in binary units: adaptive decimals, or always two; null is unknown."""
    units = UNITS[:-1] if fixed else UNITS
    value = n.cast("double")
    power, out = F.lit(0), F.lit(None)
    for i in range(1, len(units)):
        power = F.when(F.abs(value) >= 1024.0**i, i).otherwise(power)
    scaled = value / F.pow(F.lit(1024.0), power.cast("double"))
    unit = F.element_at(F.array(*map(F.lit, units)), (power + 1).cast("int"))
    whole, one, two = (F.format_string(f"%.{d}f %s", F.bround(scaled, d), unit) for d in (0, 1, 2))  # halves to even
    if fixed:
        out = F.when(power == 0, whole).otherwise(two)
    else:
        out = F.when((power == 0) | (scaled >= 100), whole).when(scaled >= 10, one).otherwise(two)
    return F.when(n.isNull(), "unknown").otherwise(out)


def content_range_total(header: Column) -> Column:
    """The total in a header such as 'bytes 0-0/12345'; null if there is none."""
    return F.regexp_extract(header, r"/(\d+)\s*$", 1).try_cast("bigint")


def destination_name(item_id: Column, href: Column) -> Column:
    """The last part of a link's path, else the item's id with .nc."""
    path = F.regexp_replace(F.regexp_extract(href, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    name = F.substring_index(path, "/", -1)
    return F.when(name != "", name).otherwise(F.concat(item_id.cast("string"), F.lit(".nc")))


def whole_number(value: Column) -> Column:
    """A non-negative whole number of a text or number; null for anything else."""
    n = value.try_cast("bigint")
    return F.when(n >= 0, n)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as canonical JSON; give them in order of name."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
