"""Catalogue items as flat granule records, and their pushed-down search as a data source."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

from ..functions.text import whole_number

ASSET = "struct<href:string,type:string,`file:size`:string,size:string,content_length:string,`content-length`:string,alternate:struct<s3:struct<href:string>>>"
#: A catalogue item's schema; properties and assets stay maps because their keys vary.
ITEM = f"id string, bbox array<double>, properties map<string,string>, assets map<string,{ASSET}>"

#: Property names in order of preference.
PROPERTIES = {
    "platform": ("platform", "sat:platform", "mission", "constellation"),
    "pair_interval_days": ("date_dt", "pair_interval_days", "img_pair_dt", "temporal_baseline_days"),
    "percent_valid_pixels": ("percent_valid_pixels", "roi_valid_percentage", "valid_pixel_percent", "valid_pixels_percent"),
    "proj_code": ("proj:code", "proj:epsg"),
}
#: Platforms that a mission's search asks the catalogue for.
SEARCHED = {"SENTINEL1": ("S1A", "S1B"), "S1": ("S1A", "S1B"), "SENTINEL2": ("S2A", "S2B"), "S2": ("S2A", "S2B"), "LANDSAT8": ("LC08", "LO08"), "L8": ("LC08", "LO08"), "LANDSAT9": ("LC09", "LO09"), "L9": ("LC09", "LO09")}
SINGLE = ("S1A", "S1B", "S2A", "S2B", "LC08", "LC09")


def first_present(mapping: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[mapping[n] for n in names])


def chosen_asset(assets: Column) -> Column:
    """(key, value) of the asset data, else of the first that looks like NetCDF, else of the first; null if none."""
    entries = F.map_entries(assets)
    href = lambda e: F.lower(F.coalesce(e["value"]["href"], F.lit("")))
    looks = lambda e: href(e).rlike(r"\.(nc|nc4|netcdf)$") | F.lower(F.coalesce(e["value"]["type"], F.lit(""))).contains("netcdf")
    return F.coalesce(F.get(F.filter(entries, lambda e: e["key"] == "data"), F.lit(0)), F.get(F.filter(entries, looks), F.lit(0)), F.get(entries, F.lit(0)))


def granules(items: DataFrame) -> DataFrame:
    """Items of the ITEM schema as flat records, one each."""
    rows = items.withColumn("__a", chosen_asset(F.col("assets")))
    p, a = F.col("properties"), F.col("__a.value")
    size = F.coalesce(*[whole_number(a[k]) for k in ("file:size", "size", "content_length", "content-length")])
    box = F.when(F.size("bbox") == 4, F.col("bbox"))
    return rows.select(
        F.col("id").alias("item_id"),
        *[p[k].alias(k) for k in ("datetime", "start_datetime", "end_datetime", "mid_datetime")],
        *[first_present(p, names).alias(k) for k, names in PROPERTIES.items()],
        *[F.get(box, F.lit(i)).alias(f"bbox_{side}") for i, side in enumerate(("west", "south", "east", "north"))],
        F.col("__a.key").alias("asset_key"),
        a["type"].alias("asset_type"),
        size.alias("asset_size_bytes"),
        (size / F.lit(1024.0**2)).alias("asset_size_mib"),
        F.when(size.isNotNull(), "stac").alias("asset_size_source"),
        a["href"].alias("data_href"),
        a["alternate"]["s3"]["href"].alias("data_s3_href"),
    )


def search_filter(mission: str | None = None, least_days: float | None = None, most_days: float | None = None) -> dict | None:
    """The predicate tree that a catalogue can evaluate; records are filtered again after the search."""
    wanted = re.sub("[^A-Z0-9]", "", (mission or "").upper())
    parts: list[dict] = []
    if wanted in SEARCHED:
        parts.append({"op": "in", "args": [{"property": "platform"}, list(SEARCHED[wanted])]})
    elif wanted in SINGLE:
        parts.append({"op": "=", "args": [{"property": "platform"}, wanted]})
    for op, days in ((">=", least_days), ("<=", most_days)):
        if days is not None:
            parts.append({"op": op, "args": [{"property": "date_dt"}, days]})
    return parts[0] if len(parts) == 1 else {"op": "and", "args": parts} if parts else None


class _Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes equality, membership and ranges on platform and date_dt; all are left for Spark to check again."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThanOrEqual, LessThanOrEqual)) and f.attribute in (("platform",), ("date_dt",)):
                self.tests.append((type(f).__name__, f.attribute[0], list(f.value) if isinstance(f, In) else f.value))
            yield f

    def partitions(self):
        return [_Page(p) for p in self.paths]

    def read(self, partition: _Page) -> Iterator[tuple]:
        ops = {"EqualTo": lambda a, b: a == b, "In": lambda a, b: a in b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThanOrEqual": lambda a, b: a <= b}
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                item = json.loads(line)
                p = item.get("properties", {})
                row = {"id": item.get("id"), "platform": p.get("platform"), "date_dt": float(p["date_dt"]) if p.get("date_dt") is not None else None}
                if all(row[a] is not None and ops[op](row[a], v) for op, a, v in self.tests):
                    yield (row["id"], row["platform"], row["date_dt"], line)


class CatalogSource(DataSource):
    """Lines of catalogue items, a partition per page file, with filters pushed down to the reader."""

    @classmethod
    def name(cls) -> str:
        return "catalog_pages"

    def schema(self) -> str:
        return "id string, platform string, date_dt double, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
