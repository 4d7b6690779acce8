"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ["device_distribution", "pad_concat", "bitmask_filters", "suitability", "balanced_resample", "balanced_pairs", "best_tau", "cluster_metrics", "dbscan_grid_best", "boost_round1", "op2_exact_dedup", "op7_secret_scan"]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
        return None
    try:
        return round(float(v), 6) if not isinstance(v, (str, bool)) else v
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    if name not in __spark_entry__.queries():
        pytest.skip("taken out")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(repr([cell(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
