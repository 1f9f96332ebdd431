"""What Catalyst makes of the queries: pushed filters, pruned columns, joins without products, no Python."""

import re

import pytest

from lakewright.plans import all_queries

QUERIES, _ = all_queries()
#: They run whole streams.
STREAMS = {n for n in QUERIES if n.startswith(("stream_", "state_"))}
#: Wikitext has no parser in Spark.
PARSERS = {"sql_templates"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    return {n: plan(q(spark, sf_dir)) for n, q in QUERIES.items() if n not in STREAMS}


def test_no_products_and_no_python(plans):
    for name, text in plans.items():
        found = re.findall("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas|InArrow", text)
        assert not found or name in PARSERS, (name, found)


@pytest.mark.parametrize("name", ["lateral_top1", "distinct_on", "topn_per_group", "display_price", "last_of_key"])
def test_groups_are_cut_before_the_shuffle(plans, name):
    assert "WindowGroupLimit" in plans[name]


@pytest.mark.parametrize(("name", "pushed"), [("page_keyset", "GreaterThan(o_orderkey,500)"), ("semi_exists", "GreaterThan(o_totalprice,400000.0)"), ("banned_impact", "GreaterThan(p_size,40)"), ("text_predicates", "StringStartsWith(p_brand,Brand#1)"), ("sync_cursor_page", "GreaterThan(event_id,250)")])
def test_filters_reach_the_scan(plans, name, pushed):
    assert pushed in plans[name]


@pytest.mark.parametrize(("name", "columns"), [("zone_counts", {"l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "p_partkey"}), ("page_keyset", {"o_orderkey", "o_totalprice"}), ("count_with_empty_groups", {"r_regionkey", "r_name", "n_nationkey", "n_regionkey"}), ("group_hash", {"c_custkey", "c_name", "c_nationkey", "c_mktsegment"})])
def test_scans_read_what_is_used(plans, name, columns):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plans[name]))))
    assert read == columns


@pytest.mark.parametrize("name", ["star_join", "lateral_top1", "unique_lookup_join"])
def test_small_sides_are_broadcast(plans, name):
    assert "BroadcastHashJoin" in plans[name]


@pytest.mark.parametrize("name", ["ordinal_page", "rank_by_aggregate", "page_offset"])
def test_pages_keep_only_the_top_of_each_partition(plans, name):
    assert "TakeOrderedAndProject" in plans[name]


def test_upserts_shuffle_each_side_once(plans):
    assert plans["upsert_hash_guard"].count("Exchange hashpartitioning") == 2
