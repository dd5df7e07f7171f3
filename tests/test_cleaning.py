"""Missing values, outliers, duplicates on small frames with known answers."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from scour.functions import stats
from scour.operators import duplicates, impute, outliers
from scour.plans.stages import apply_stage
from tests.conftest import values


def statuses(log):
    return [e.status for e in log]


def test_dedup_and_impute_by_column_method(frame):
    df = frame([(1.0, "x"), (2.0, "y"), (None, "z"), (2.0, "y"), (5.0, "x")], "A double, B string")
    plan = {
        "A": [{"operation": "handle_missing_values", "method": "mean"}],
        "B": [{"operation": "handle_missing_values", "method": "mode"}],
        "global": [{"operation": "remove_duplicates"}],
    }
    out, log = apply_stage(df, plan, "cleaning")
    assert statuses(log) == ["completed"] * 3
    assert values(out, "A") == [1.0, 2.0, 2.5, 5.0]
    assert log[2].affected == 1


@pytest.mark.parametrize("method, expected", [("mean", 7 / 3), ("median", 2.0)])
def test_mean_and_median_keep_their_statistic(frame, method, expected):
    df = frame([(1.0, 5.0), (2.0, None), (None, 7.0), (4.0, 8.0)], "A double, B double")
    out = impute.impute_table(df, {"A": method, "B": method})
    assert out.where("A IS NULL OR B IS NULL").count() == 0
    got = values(out, "A")
    assert (statistics.mean if method == "mean" else statistics.median)(got) == pytest.approx(expected)


def test_empty_plan_keeps_the_table(frame):
    df = frame([(1, "x")], "A long, B string")
    out, log = apply_stage(df, None, "cleaning")
    assert out.collect() == df.collect() and log == []


def test_mode_tie_takes_the_smallest(frame):
    df = frame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert values(impute.impute(df, "c"), "c") == ["a", "a", "a", "b", "b"]


def test_nan_counts_as_missing(frame):
    df = frame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert impute.null_counts(df) == {"x": 1}
    assert values(impute.impute(df, "x", "mean"), "x") == [1.0, 2.0, 3.0]


def test_all_null_column_stays_and_is_skipped(frame):
    df = frame([(None,), (None,)], "x double")
    out, log = apply_stage(df, {"x": [{"operation": "handle_missing_values", "method": "mean"}]}, "cleaning")
    assert values(out, "x") == [None, None] and statuses(log) == ["skipped"]


def test_adaptive_imputation_looks_at_outliers_and_skew(frame):
    heavy = [float(i) for i in range(18)] + [1000.0, 1000.0, None]
    df = frame([(v,) for v in heavy], "x double")
    known = [v for v in heavy if v is not None]
    assert impute.fit_fills(df)[0].method == "median"
    assert impute.fit_fills(df)[0].value == statistics.median(known)
    assert impute.fit_fills(df, adaptive="skew")[0].method == "median"
    even = frame([(float(i),) for i in range(20)] + [(None,)], "x double")
    assert impute.fit_fills(even)[0].method == "mean"
    assert impute.fit_fills(even, {"x": "mode_imputation"}, adaptive="skew")[0].method == "mode"


def test_iqr_clip_keeps_null(frame):
    df = frame([(float(i),) for i in range(1, 21)] + [(1000.0,), (None,)], "v double")
    q1, q3 = np.percentile([*range(1, 21), 1000], [25, 75])
    got = values(outliers.iqr_clip(df, "v"), "v")
    assert got[-1] is None and got[-2] == q3 + 1.5 * (q3 - q1)
    assert outliers.iqr_clip(outliers.iqr_clip(df, "v"), "v").where("v > 40").count() == 0


def test_zscore_both_modes(frame):
    df = frame([(float(i),) for i in range(1, 21)] + [(1000.0,), (None,)], "v double")
    assert outliers.zscore_removal(df, "v").where("v IS NULL").count() == 2
    assert outliers.zscore_removal(df, "v", "drop_rows").count() == 21
    constant = frame([(5.0,), (5.0,)], "v double")
    assert values(outliers.zscore_removal(constant, "v"), "v") == [5.0, 5.0]


def test_isolation_forest_replaces_the_extreme(frame):
    df = frame([(v,) for v in (1, 2, 3, 4, 100, 5, 6)], "A long")
    out = outliers.isolation_forest(df, "A")
    assert 100.0 not in values(out, "A") and values(out, "A").count(4.0) == 2
    assert values(outliers.isolation_forest(df, "A"), "A") == values(out, "A")


def test_isolation_forest_flags_about_a_tenth(spark):
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.normal(0, 1, 5000), [50.0, -60.0]])
    df = spark.createDataFrame([(float(v),) for v in data], "x double")
    fit = outliers.fit_forest(df, "x")
    flagged = df.where(fit.steps.anomalous(F.col("x")))
    assert flagged.count() <= 0.1 * len(data) + 1
    assert flagged.where("x IN (50.0, -60.0)").count() == 2


def test_outlier_report_lists_only_columns_with_outliers(frame):
    df = frame([(float(i), 1.0) for i in range(20)] + [(500.0, 1.0), (500.0, 1.0), (-300.0, 1.0)], "a double, b double")
    rows = outliers.outlier_report(df).collect()
    assert [(r["column"], r["outliers"], r["sample"]) for r in rows] == [("a", 3, [-300.0, 500.0, 500.0])]


def test_operations_that_do_not_apply_are_skipped(frame):
    df = frame([("a", 1)], "s string, n int")
    plan = {
        "s": [{"operation": "handle_outliers"}, {"operation": "remove_duplicates", "subset": ["s"]}],
        "gone": [{"operation": "handle_outliers"}, {"operation": "handle_inconsistencies"}],
        "n": [{"operation": "nonsense"}],
        "ignored": "not a list",
    }
    out, log = apply_stage(df, plan, "cleaning")
    assert statuses(log) == ["skipped"] * 5 and out.collect() == df.collect()


def test_dedup_subset_keeps_the_first_by_order_and_is_idempotent(frame):
    rows = [(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (None, 5, "x"), (None, 4, "y"), (2, 1, None)]
    df = frame(rows, "k int, o int, v string")
    once = duplicates.remove_duplicates(df, ["k"], ["o"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted([(1, 1, "a"), (None, 4, "y"), (2, 1, None)], key=str)
    assert duplicates.remove_duplicates(once, ["k"], ["o"]).count() == 3
    census = duplicates.duplicate_census(df.select("k")).first()
    assert (census["members"], census["excess"]) == (5, 3)


SHAPES = {
    "even": lambda r: r.random(),
    "hot value": lambda r: 7.0 if r.random() < 0.6 else r.random() * 10,
    "few values": lambda r: float(r.randrange(5)),
    "heavy tail": lambda r: -math.exp(r.gauss(0, 2)),
}


@pytest.mark.parametrize("limit", [20_000, 15])
def test_exact_quantiles_equal_numpy(spark, limit):
    """The small limit forces the narrowing rounds."""
    r = random.Random(3)
    columns = {name: [shape(r) for _ in range(4000)] for name, shape in SHAPES.items()}
    # The rank falls on the border between many distinct values and one frequent value.
    columns["border"] = [i / 1990 for i in range(1990)] + [1.0] * 2010
    df = spark.createDataFrame(list(zip(*columns.values())), [*columns])
    qs = [0.0, 0.25, 0.4975, 0.5, 0.75, 1.0]
    got = stats.exact_quantiles(df, {c: qs for c in columns}, limit)
    for name, data in columns.items():
        assert got[name] == pytest.approx(list(np.quantile(data, qs)), rel=1e-12)


def test_quantile_brackets_from_samples_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(stats, "SAMPLE_ROWS", 2000)
    r = random.Random(8)
    data = [r.gauss(0, 1) if r.random() < 0.7 else 0.5 for _ in range(20_000)]
    df = spark.createDataFrame([(v, "g") for v in data], "x double, k string")
    qs = [0.25, 0.5, 0.75]
    assert stats.exact_quantiles(df, {"x": qs}, 3000)["x"] == pytest.approx(list(np.quantile(data, qs)), rel=1e-12)
    grouped = stats.grouped_quantile(df, ["k"], "x", 0.75, "m", 3000).first()["m"]
    assert grouped == pytest.approx(np.quantile(data, 0.75), rel=1e-12)


def test_quantile_sketches_see_samples_and_brackets_only(spark, monkeypatch):
    """The least and the largest value, which a sample may lack, cost no further rounds."""
    monkeypatch.setattr(stats, "SAMPLE_ROWS", 1000)
    seen, looked = [], stats._looked

    def spied(*args):
        rows, aggs = looked(*args)
        seen.append(rows.count())
        return rows, aggs

    monkeypatch.setattr(stats, "_looked", spied)
    data = [(i * 7919 % 40_009) / 7 for i in range(40_000)]
    df = spark.createDataFrame([(v,) for v in data], "x double")
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    assert stats.exact_quantiles(df, {"x": qs}, 2000)["x"] == pytest.approx(list(np.quantile(data, qs)), rel=1e-12)
    assert len(seen) == 2 and seen[0] < 2000 and seen[1] < 40_000 * 0.65


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_grouped_quantile_with_one_hot_group(spark, limit):
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.5 else f"k{r.randrange(20)}", r.gauss(0, 1)) for _ in range(12_000)]
    rows += [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x["k"]: x["m"] for x in stats.grouped_quantile(df, ["k"], "v", 0.5, "m", limit).collect()}
    for key in {k for k, _ in rows} - {"empty"}:
        assert got[key] == pytest.approx(statistics.median(v for k, v in rows if k == key), rel=1e-12)
    assert got["empty"] is None
