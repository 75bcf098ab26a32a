"""Plans: what reaches the scan, what is scanned once, and where Python runs."""

import re

import pytest

from tremolo.catalog import QUERIES

SF = "/root/testdata/sf0.001"
WITH_PYTHON = {"txt19_difflib", "gat01_format_gate", "sim04_text"}
WRITES = {"stream_collapse", "agg22_exact_percentile", "agg01_incremental", "snk02_results", "gen01_attempts", "src02_csv", "src01_csv_intake", "src05_models", "src01_intake", "src03_rows"}


def plan(df, executed=False) -> str:
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cartesian_product_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert bool(re.search("Python|Pandas|Arrow", text)) == (name in WITH_PYTHON)


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["agg07_family_collapse"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,5.0)]" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)", text)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag"}


@pytest.mark.parametrize("name", ["agg07_family_collapse", "agg36_meta_by_model", "agg12_level_metrics", "agg13_survival_category", "agg18_composite"])
def test_one_scan(spark, name):
    assert plan(QUERIES[name](spark, SF), executed=True).count("FileScan") == 1
