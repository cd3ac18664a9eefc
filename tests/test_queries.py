"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from pairfield import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def tidy(rows):
    def one(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    made = queries.QUERIES[name](spark, DIR)
    columns = sorted(made.columns)
    ours = made.select(columns).collect()
    theirs = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({queries.SQL[name]})").fetchall()
    assert tidy(ours) == tidy(theirs)


def test_general_metrics_agree_with_the_closed_form(spark):
    general = {(r["y"], r["x"]): r for r in queries._general(spark, DIR, 1, list(queries.PRIOR)).collect()}
    for r in queries.posterior_k2_metrics(spark, DIR).collect():
        for m in ("data_rank", "effective_dof", "log10_condition_number", "information_gain_nats", "mean_prediction_std", "max_prediction_std"):
            assert general[(r["y"], r["x"])][m] == pytest.approx(r[m], abs=2e-6)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["y", "x", "valid_count", "valid_fraction"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
