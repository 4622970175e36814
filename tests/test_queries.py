"""Registered queries against their SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quantgrid.catalog import ORACLES, QUERIES

# A spread over all families; the whole catalogue is compared by the driver.
CHOSEN = (
    "median_cv", "missing_filter", "impute_knn", "state_pipeline", "association", "run_order_stratified", "sample_correlation",
    "dynamic_range", "ols_paired", "benjamini_hochberg", "welch_statistic", "discordance_by_class", "ratio_index", "slope_estimates",
    "detection_classes", "sharing_partners", "decompose_mass", "label_scores", "scan_feature_table", "reconcile_report", "independent_permutation_null", "combat_masked", "no_value_reasons", "child_summary",
)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not hasattr(v, "__float__"):
        return str(v)
    return round(float(v), 9)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda r: [str(x) for x in r]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == want and got


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200
