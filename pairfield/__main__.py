"""Command line: python -m pairfield coverage|inventory|compare|export|diagnostics ... over Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators.observations import Selection


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pairfield")
    sub = top.add_subparsers(dest="program", required=True)

    def program(name: str, region: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--input", required=True, help="Parquet of cells, or of granule records for inventory")
        p.add_argument("--output", required=True)
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--start", required=True)
        p.add_argument("--end", required=True)
        p.add_argument("--mission")
        p.add_argument("--min-pair-days", type=float)
        p.add_argument("--max-pair-days", type=float)
        if region:
            box = p.add_mutually_exclusive_group(required=True)
            box.add_argument("--bbox", nargs=4, type=float, metavar=("WEST", "SOUTH", "EAST", "NORTH"))
            box.add_argument("--bbox-lonlat", nargs=4, type=float, metavar=("WEST", "SOUTH", "EAST", "NORTH"))
            p.add_argument("--sensor")
            p.add_argument("--missing", nargs="*", type=float, default=[])
        return p

    p = program("inventory", region=False)
    p.add_argument("--min-valid-percent", type=float)
    p.add_argument("--max-items", type=int)
    program("coverage")
    program("compare")
    p = program("export")
    p.add_argument("--variables", nargs="+", required=True)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--allow-large", action="store_true")
    p = program("diagnostics")
    p.add_argument("--step-days", type=int, default=1)
    p.add_argument("--degree", type=int, default=1)
    p.add_argument("--periods", nargs="*", type=float, default=[])
    p.add_argument("--operator", nargs="*")
    p.add_argument("--error-variable", default="auto")
    p.add_argument("--error-floor", type=float, default=0.0)
    p.add_argument("--prior-std", type=float, default=float("inf"))
    p.add_argument("--ridge", type=float, default=0.0)
    return top


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("pairfield").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    mode = "overwrite" if a.overwrite else "error"
    save = lambda df, name: df.write.parquet(f"{a.output}/{name}", mode=mode)
    rows: DataFrame = spark.read.parquet(a.input)
    try:
        if a.program == "inventory":
            kept, summary = api.inventory(rows, a.start, a.end, a.mission, a.min_pair_days, a.max_pair_days, a.min_valid_percent, a.max_items)
            save(kept, "records")
            save(summary, "summary")
            return 0
        region = api.Region(*(a.bbox or a.bbox_lonlat), lonlat=a.bbox is None)
        options = api.CoverageOptions(Selection(a.start, a.end, a.mission, a.sensor, a.min_pair_days, a.max_pair_days), region, tuple(a.missing))
        places = rows.select("y", "x").distinct()
        if a.program == "coverage":
            made = api.coverage(rows, places, options)
            for name in ("pixels", "statistics", "shares", "funnel", "selected"):
                save(getattr(made, name), name)
        elif a.program == "compare":
            save(api.compare_durations(rows, places, region, a.start, a.end, missing=tuple(a.missing)), "comparison")
        elif a.program == "export":
            save(api.export(rows, options, a.variables, f"{a.output}/cells", a.dry_run, a.allow_large, a.overwrite), "plan")
        else:
            spec = api.TemplateOptions(a.start, a.end, a.step_days, a.degree, tuple(a.periods), prior_std={"poly": a.prior_std, "seasonal": a.prior_std}, ridge_groups=("poly", "seasonal"))
            chosen = api.obs.selected(rows, options.selection).filter(region.contains())
            save(api.diagnostics(chosen, api.build_template(spark, spec), spec, a.operator, a.ridge, a.error_variable, a.error_floor, tuple(a.missing)), "metrics")
            save(spark.range(1).select(F.lit(region.geojson()).alias("region")), "region")
    except ValueError as e:
        print(f"error: {e}")
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
