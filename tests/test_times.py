"""As-of lookups and windows around events against plain Python."""

import random
from datetime import date, datetime, timedelta

import pytest

from scour.questions import times as questions


def _last(known, key, at, strict, tolerance, keyed):
    found = [k for k in known if (not keyed or k[0] == key) and k[1] is not None and at is not None and (k[1] < at or k[1] == at and not strict)]
    best = max(found, key=lambda k: (k[1], k[2]), default=None)
    return None if best is None or tolerance is not None and at - best[1] > tolerance else best


@pytest.mark.parametrize("keys, strict, tolerance", [([], False, None), ([], True, 9), (["k"], False, None), (["k"], True, 30)])
def test_last_known_over_small_ranges(spark, frame, keys, strict, tolerance):
    """A key with most of the rows, keys that end at borders, a null key, null times and values, ties, long stretches without a known row."""
    rng = random.Random(5)
    keyed = lambda: rng.choice(["hot"] * 9 + ["a", "b", None])
    known = [(keyed(), rng.choice([None, *range(0, 120), *range(400, 440)]), i, rng.choice([None, i % 13])) for i in range(150)]
    asked = [(i, keyed(), rng.choice([None, *range(-5, 500)]), "x") for i in range(600)]
    got = questions.last_known(
        frame(asked, "id int, k string, at int, Previous_AT string"), frame(known, "k string, at int, n int, v int"), keys, "at", ["v"], ["n"], strict, tolerance, rows=11
    ).collect()
    assert len(got) == len(asked)
    for r in got:
        want = _last(known, r.k, r["at"], strict, tolerance, bool(keys))
        assert (r.Previous_AT, r.previous_at_2, r.previous_v) == ("x", *((want[1], want[3]) if want else (None, None)))


def test_last_known_of_empty_tables(spark, frame):
    none, some = frame([], "k int, at date, v int"), frame([(1, date(2024, 5, 3), 7)], "k int, at date, v int")
    assert questions.last_known(none, some, ["k"], "at", ["v"]).collect() == []
    assert [r.previous_v for r in questions.last_known(some, none, ["k"], "at", ["v"]).collect()] == [None]
    late = frame([(1, date(2024, 5, 6), 0)], "k int, at date, v int")
    for days, want in ((3, 7), (2, None)):
        assert [r.previous_v for r in questions.last_known(late, some, ["k"], "at", ["v"], tolerance=timedelta(days=days)).collect()] == [want]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_around_times_with_split_bins(spark, frame, keys):
    """A hot bin in parts, values at both ends of a window, at the time of the event, below zero; null keys, times and values."""
    rng = random.Random(8)
    keyed = lambda: rng.choice(["hot"] * 9 + ["a", None])
    place = lambda: rng.choice([None, *range(-40, 60), *[7] * 20, *range(300, 310)])
    series = [(keyed(), place(), rng.choice([None, *range(9)])) for _ in range(500)]
    events = [(keyed(), place()) for _ in range(120)]
    got = questions.around_times(frame(series, "k string, at int, v int"), frame(events, "k string, at int"), keys, "at", "v", 10, bin_times=4).collect()
    wanted = {(e[0] if keys else None, e[1]) for e in events if e[1] is not None}
    assert {(r.k if keys else None, r["at"]) for r in got} == wanted and len(got) == len(wanted)
    for r in got:
        mine = [(s[1] - r["at"], s[2]) for s in series if s[1] is not None and s[2] is not None and (not keys or s[0] == r.k)]
        before, after = [v for d, v in mine if -10 <= d < 0], [v for d, v in mine if 0 < d <= 10]
        assert (r.n_before, r.n_after) == (len(before), len(after))
        assert r.mean_before == (pytest.approx(sum(before) / len(before)) if before else None)
        assert r.mean_after == (pytest.approx(sum(after) / len(after)) if after else None)


def test_around_times_joins_on_equal_keys(spark, frame):
    at = datetime(2024, 1, 1, 12, 0, 0, 1)
    series = frame([(1, at - timedelta(seconds=2), 5.0), (1, at + timedelta(microseconds=1), 6.0)], "k int, at timestamp, v double")
    out = questions.around_times(series, frame([(1, at)], "k int, at timestamp"), ["k"], "at", "v", timedelta(seconds=2))
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [tuple(r)[2:6] for r in out.collect()] == [(1, 5.0, 1, 6.0)]
    with pytest.raises(ValueError):
        questions.around_times(series, series, ["k"], "at", "v", timedelta(0))
