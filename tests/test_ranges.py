"""Numbers and neighbours over ranges against plain Python."""

import random

from scour.functions.ranges import neighbours, numbered, ranged


def test_ranges_ascend(spark):
    df = spark.range(5000).selectExpr("hash(id) AS v")
    rows = ranged(df, ["v"], rows=100).collect()
    ends = {}
    for v, r in rows:
        low, high = ends.get(r, (v, v))
        ends[r] = (min(low, v), max(high, v))
    spans = [ends[r] for r in sorted(ends)]
    assert len(spans) > 30 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_numbers_equal_plain_counting(spark, frame):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i if i % 7 else None) for i in range(3000)]
    rng.shuffle(rows)
    got = numbered(frame(rows, "k string, v int"), ["k"], ["v"]).collect()
    for key in {"hot", "a", "b", None}:
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: r["idx"])
        assert [r["idx"] for r in mine] == list(range(sum(k == key for k, _ in rows)))
        order = [(r["v"] is not None, r["v"] or 0) for r in mine]
        assert order == sorted(order)


def test_neighbours_wrap_around(spark, frame):
    values = sorted(random.Random(1).sample(range(10**9), 700))
    got = neighbours(frame([(v,) for v in values * 2] + [(None,)], "v long"), "v", rows=50)
    assert sorted(map(tuple, got.collect())) == sorted(zip(values, values[1:] + values[:1]))
    assert neighbours(frame([(4,)], "v long"), "v").collect() == [(4, 4)]
    assert neighbours(frame([], "v long"), "v").collect() == []
