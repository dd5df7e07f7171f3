"""Plans stay distributed: pushed-down scans, partial aggregation, no cross products, no unbounded window."""

import pytest

from scour.catalog.base import QUERIES, Tables
from scour.functions import stats
from scour.operators import duplicates, encode, features, impute, reshape, schema
from scour.questions import happenings as hp, series as qs

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def t(spark):
    return Tables(spark, FOLDER)


def test_only_needed_columns_are_read(t):
    plan = plan_of(features.aggregate(t.lineitem, "l_returnflag", "l_quantity", "mean"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
    assert "PushedFilters: [IsNotNull(l_returnflag)]" in plan and "partial_avg" in plan


def test_apply_steps_do_not_shuffle(t):
    fills = impute.fit_fills(t.gaps)
    assert "Exchange" not in plan_of(impute.apply_fills(t.gaps, fills))
    assert "Exchange" not in plan_of(features.fit_scale(t.lineitem, "l_tax").apply(t.lineitem))


def test_duplicates_combine_before_the_shuffle(t):
    plan = plan_of(duplicates.remove_duplicates(t.lineitem, ["l_partkey"], ["l_shipdate"]))
    assert "partial_min" in plan and "Window" not in plan


def test_samples_need_no_shuffle(t):
    assert "Exchange" not in plan_of(schema.sample_values(t.customer))


def test_top_rows_use_take_ordered(t):
    assert "TakeOrderedAndProject" in plan_of(schema.head_rows(t.orders, ["o_orderkey"]))


def test_large_code_tables_are_not_broadcast(t):
    codes = encode.frequency_codes(t.customer, "c_name", limit=10)
    assert not codes.small
    assert encode.frequency_codes(t.customer, "c_mktsegment", limit=10).small


def test_pivot_and_bars_reduce_first(t):
    assert "partial_avg" in plan_of(reshape.pivot(t.events, "user_id", "event_type", "value"))
    bars = qs.daily_bars(t.events, "ts", "value", ["ts"], ["user_id"])
    assert "partial_max" in plan_of(bars)
    assert "CartesianProduct" not in plan_of(hp.around_events(bars, bars, ["user_id"], 2))


LAZY = ["moving_average", "longest_streak", "around_events", "last_before", "pivot_mean", "merge_outer", "dedup_subset", "text_remove_stopwords"]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_products(spark, name):
    plan = plan_of(QUERIES[name].run(spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_profile_shuffles_no_text(spark):
    """Distinct counts and samples of long texts exchange hashes and single rows."""
    df = spark.createDataFrame([(i, "long text " * 200 + str(i % 7)) for i in range(500)], "i int, t string")
    assert stats.distinct_counts(df, ["i", "t"]) == {"i": 500, "t": 7}
    assert [r.value[-1] for r in schema.sample_values(df.select("t")).collect()] == ["0", "1", "2"]
