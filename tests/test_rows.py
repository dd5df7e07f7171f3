"""Windows of n rows over ranges with halo rows against plain Python."""

import random

import pytest

from scour.questions import rows as questions


@pytest.mark.parametrize("keys, size", [([], 5), (["k"], 5), (["k"], 40)])
def test_moving_average_over_small_ranges(spark, frame, keys, size):
    """Ranges of a few rows: windows reach over several of them; a hot key, small keys, a null key, null values."""
    rng = random.Random(9)
    data = [(rng.choice(["hot"] * 9 + ["a", "b", None]), i, rng.choice([None, *range(50)])) for i in range(700)]
    rng.shuffle(data)
    got = questions.moving_average(frame(data, "k string, at int, v int"), keys, ["at"], "v", [3, size], rows=7).collect()
    assert len(got) == len(data)
    for key in {d[0] for d in data} if keys else {None}:
        mine = sorted((d for d in data if not keys or d[0] == key), key=lambda d: d[1])
        found = sorted((r for r in got if not keys or r.k == key), key=lambda r: r["at"])
        for n in (3, size):
            for i, r in enumerate(found):
                known = [d[2] for d in mine[i - n + 1 : i + 1] if d[2] is not None] if i >= n - 1 else []
                want = sum(known) / len(known) if known else None
                assert r[f"ma_{n}"] == (None if want is None else pytest.approx(want))


def test_changes_without_a_key(spark, frame):
    rows = [(i, float((i * 37) % 11)) for i in range(200)]
    got = sorted(questions.changes(frame(rows, "at int, v double"), [], ["at"], "v", rows=9).collect(), key=lambda r: r["at"])
    assert [r.previous for r in got] == [None, *[v for _, v in rows[:-1]]]
    assert questions.changes(frame([], "at int, v double"), [], ["at"], "v").collect() == []


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_streaks_over_small_ranges(spark, frame, keys):
    """Runs longer than many ranges, runs that end at borders, null values, a hot key."""
    rng = random.Random(12)
    data, v = [], 0
    for i in range(600):
        v = None if i % 97 == 50 else (v or 0) + (1 if 100 < i < 180 else 0 if 300 < i < 340 else rng.choice([-1, 0, 1]))
        data.append((rng.choice(["hot"] * 9 + ["a", None]) if keys else "x", i, v))
    rng.shuffle(data)
    want = {}
    for key in {d[0] for d in data}:
        mine, best = sorted((d for d in data if d[0] == key), key=lambda d: d[1]), {}
        run = None
        for a, b in zip(mine, mine[1:]):
            sign = None if a[2] is None or b[2] is None else (b[2] > a[2]) - (b[2] < a[2])
            run = (sign, run[1] + 1, run[2], b[1]) if run and run[0] == sign else (sign, 1, b[1], b[1])
            if sign is not None and run[1] > best.get(sign, (0,))[0]:
                best[sign] = run[1:]
        want |= {(key if keys else None, {1: "rising", -1: "falling", 0: "equal"}[s]): b for s, b in best.items()}
    got = questions.longest_streaks(frame(data, "k string, at int, v int"), keys, ["at"], "v", rows=7).collect()
    assert {(r.k if keys else None, r.direction): (r.length, r.first_at, r.last_at) for r in got} == want
