"""Mission, platform, scene and orbit names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other spellings of missions.
MISSION_ALIASES = {
    "S1": "SENTINEL-1", "SENTINEL1": "SENTINEL-1", "S2": "SENTINEL-2", "SENTINEL2": "SENTINEL-2",
    "L4": "LANDSAT-4", "L5": "LANDSAT-5", "L7": "LANDSAT-7", "L8": "LANDSAT-8", "L9": "LANDSAT-9",
}
#: Short platform codes of missions.
PLATFORM_ALIASES = {"SENTINEL1": "S1", "SENTINEL2": "S2", "LANDSAT4": "L4", "LANDSAT5": "L5", "LANDSAT7": "L7", "LANDSAT8": "L8", "LANDSAT9": "L9"}
#: Fixed value: a scene identifier of the radar mission, by mode, product, polarisation, times, orbit, take, checksum.
SCENE = r"S1[AB]_[A-Z]{2}_SLC_{1,2}1S[A-Z]{2}_\d{8}T\d{6}_\d{8}T\d{6}_\d{6}_[0-9A-F]{6}_[0-9A-F]{4}"


def _lookup(value: Column, mapping: dict[str, str], default: Column) -> Column:
    """A chain of equality tests; mappings here have a handful of entries."""
    out = None
    for k, v in mapping.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(default)


def normalize_mission(value: Column) -> Column:
    """Upper case with dashes for what isn't a letter or digit; aliases resolved; null is UNKNOWN."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(value)), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    numbered = F.regexp_extract(s, "^LANDSAT-?([45789])$", 1)
    named = _lookup(s, MISSION_ALIASES, F.when(numbered != "", F.concat(F.lit("LANDSAT-"), numbered)).otherwise(s))
    return F.coalesce(named, F.lit("UNKNOWN"))


def normalize_pair_mission(mission: Column, satellite: Column) -> Column:
    """Compact mission and satellite codes as mission names: S with 1A is SENTINEL-1, L with 8 is LANDSAT-8.

    The usual codes come first, by equality alone, so that patterns are only matched for what remains.
    """
    usual = F.when((mission == "S") & satellite.isin("1A", "1B"), "SENTINEL-1").when((mission == "S") & satellite.isin("2A", "2B"), "SENTINEL-2")
    usual = usual.when((mission == "L") & satellite.isin("4", "5", "7", "8", "9"), F.concat(F.lit("LANDSAT-"), satellite))
    return usual.otherwise(_normalize_pair(mission, satellite))


def _normalize_pair(mission: Column, satellite: Column) -> Column:
    name = normalize_mission(mission)
    code = F.regexp_replace(F.upper(F.coalesce(satellite, F.lit(""))), "[^A-Z0-9]+", "")
    digit = F.regexp_extract(code, "^([45789])", 1)
    return (
        F.when(name.isin("S", "SENTINEL") & code.rlike("^1[A-Z]?$"), "SENTINEL-1")
        .when(name.isin("S", "SENTINEL") & code.rlike("^2[A-Z]?$"), "SENTINEL-2")
        .when(name.isin("L", "LANDSAT"), F.when(digit != "", F.concat(F.lit("LANDSAT-"), digit)).otherwise("LANDSAT"))
        .when((name == "UNKNOWN") & (code != ""), normalize_mission(code))
        .otherwise(name)
    )


def mission_matches(mission: Column, requested: str) -> Column:
    """Equality with the requested mission; LANDSAT stands for all that begin with LANDSAT-."""
    wanted = normalize_mission(F.lit(requested))
    return F.when(wanted == "LANDSAT", mission.startswith("LANDSAT-")).otherwise(mission == wanted)


def platform_matches(platform: Column, requested: str | None, strict: bool = True) -> Column:
    """Whether a catalogue's platform belongs to the requested mission.

    LANDSAT takes every sensor letter. A single Landsat, as L8, takes the letters followed by its bare digit, as LC8;
    with strict off also by its padded number, as LC08.
    """
    import re

    if not requested:
        return F.lit(True)
    value = F.regexp_replace(F.upper(F.coalesce(platform, F.lit(""))), "[^A-Z0-9]", "")
    wanted = re.sub("[^A-Z0-9]", "", requested.upper())
    wanted = PLATFORM_ALIASES.get(wanted, wanted)
    if wanted == "LANDSAT":
        starts = ["LC", "LE", "LT", "LO", "LM"]
    elif re.fullmatch(r"L\d", wanted):
        starts = [f"L{letter}{wanted[1]}" for letter in "CETO"]
        starts += [] if strict else [f"L{letter}0{wanted[1]}" for letter in "CETO"]
    else:
        starts = [wanted]
    out = F.lit(False)
    for s in starts:
        out = out | value.startswith(s)
    return out


def scenes(pair_id: Column) -> Column:
    """All scene identifiers in a pair's identifier; a valid pair has two."""
    return F.regexp_extract_all(pair_id, F.lit(SCENE), F.lit(0))


def two_scenes(pair_id: Column) -> Column:
    """The two scene identifiers of a pair; any other number of them is an error."""
    found = scenes(pair_id)
    return F.when(F.size(found) == 2, found).otherwise(F.raise_error(F.concat(F.lit("a pair needs exactly two scenes: "), F.coalesce(pair_id, F.lit("null")))))


def orbit_direction(first: Column, second: Column) -> Column:
    """1 if both images ascend, 2 if both descend, 3 if they differ, 0 if either is unknown."""
    up = lambda c: F.lower(F.trim(c)).startswith("asc")
    down = lambda c: F.lower(F.trim(c)).startswith("desc")
    known = (up(first) | down(first)) & (up(second) | down(second))
    code = F.when(known & up(first) & up(second), 1).when(known & down(first) & down(second), 2).when(known, 3).otherwise(0)
    return code.cast("tinyint")
