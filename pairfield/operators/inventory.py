"""Catalogue records: local filters, sizes and their summary, download plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mission import platform_matches
from ..functions.text import destination_name, human_bytes, whole_number
from ..functions.time import within


def matching(records: DataFrame, start: str, end: str, mission: str | None = None, least_days: float | None = None, most_days: float | None = None, least_valid: float | None = None, strict: bool = True) -> DataFrame:
    """Records whose midpoint, platform, absolute duration and valid share pass; what can't be read fails a filter."""
    when = F.try_to_timestamp(F.coalesce("datetime", "mid_datetime").cast("string")).cast("timestamp_ntz")
    days, share = F.abs(F.col("pair_interval_days").try_cast("double")), F.col("percent_valid_pixels").try_cast("double")
    keep = within(when, start, end) & platform_matches(F.col("platform"), mission, strict)
    keep = keep & (days >= least_days) if least_days is not None else keep
    keep = keep & (days <= most_days) if most_days is not None else keep
    return records.filter(keep & (share >= least_valid) if least_valid is not None else keep)


def size_summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Known and estimated total size: unknown sizes count as the median of the known ones, cut to a whole number."""
    size = whole_number(F.col("asset_size_bytes"))
    s = records.groupBy(*(by or [])).agg(
        F.count("*").alias("asset_count"),
        F.count(size).alias("known_count"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("known_bytes"),
        F.percentile(size, 0.5).cast("long").alias("median_bytes"),
    )
    unknown = F.col("asset_count") - F.col("known_count")
    total = F.when(unknown == 0, F.col("known_bytes")).when(F.col("median_bytes").isNotNull(), F.col("known_bytes") + unknown * F.col("median_bytes"))
    method = (
        F.when(unknown == 0, "exact_sum_of_known_asset_sizes")
        .when(F.col("median_bytes").isNotNull(), "known_sizes_plus_median_known_size_for_unknown_assets")
        .otherwise("unavailable")
    )
    s = s.withColumn("estimated_bytes", total).withColumn("estimate_method", method)
    return s.withColumn("known_human", human_bytes(F.col("known_bytes"))).withColumn("estimated_human", human_bytes(F.col("estimated_bytes")))


def with_probed_sizes(records: DataFrame, probed: DataFrame) -> DataFrame:
    """Fills sizes that the catalogue lacks from (item_id, probed_bytes); says where each size is from."""
    own = F.col("asset_size_bytes")
    joined = records.join(probed, "item_id", "left")
    source = F.when(own.isNotNull(), F.col("asset_size_source")).when(F.col("probed_bytes").isNotNull(), "http")
    return joined.withColumn("asset_size_source", source).withColumn("asset_size_bytes", F.coalesce(own, "probed_bytes")).drop("probed_bytes")


def download_plan(records: DataFrame, present: DataFrame) -> DataFrame:
    """What to do for each record, given (name, bytes) of files that are there: NO_ASSET, SKIP, RESUME or GET."""
    rows = records.withColumn("name", destination_name(F.col("item_id"), F.col("data_href"))).join(present, "name", "left")
    done = F.col("bytes").isNotNull() & (F.col("asset_size_bytes").isNull() | (F.col("bytes") >= F.col("asset_size_bytes")))
    action = F.when(F.coalesce("data_href", F.lit("")) == "", "NO_ASSET").when(done, "SKIP").when(F.col("bytes") > 0, "RESUME").otherwise("GET")
    return rows.select("item_id", "name", action.alias("action"), F.coalesce("bytes", F.lit(0)).alias("from_byte"))
