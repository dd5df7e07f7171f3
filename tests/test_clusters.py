"""Greedy clusters, containment pairs and merging without a cap against the sequential rules."""

import random
from itertools import combinations

import pytest

from scour.functions import similarity as sim
from scour.operators import categories, contained
from scour.operators.clusters import greedy_clusters
from scour.operators.contained import contained_pairs
from tests.test_spelling import some_texts


def sequential(n, near):
    taken, out = set(), {}
    for i in range(n):
        if i in taken:
            continue
        for j in sorted(near.get(i, ())):
            if j not in taken and j > i:
                taken.add(j)
                out[j] = i
    return out


@pytest.mark.parametrize("seed, n, m", [(1, 300, 400), (2, 300, 1500)])
def test_rounds_equal_the_sequential_rule(spark, frame, seed, n, m):
    """Random graphs with a long chain, groups of equal forms, and linked groups."""
    rng = random.Random(seed)
    edges = {tuple(rng.sample(range(n), 2)) for _ in range(m)} | {(i, i + 1) for i in range(0, 60)}
    forms = {i: rng.choice([None, None, None, *"abcdefgh"]) for i in range(n)}
    links = {("a", "b"), ("c", "b"), ("g", "h")}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a, b in combinations(range(n), 2):
        f, g = forms[a], forms[b]
        if f and g and (f == g or (f, g) in links or (g, f) in links):
            near.setdefault(a, set()).add(b)
    found = greedy_clusters(frame(list(forms.items()), "id long, form string"), frame(list(edges), "a long, b long"), frame(list(links), "f string, g string"))
    assert dict(map(tuple, found.collect())) == sequential(n, near)


@pytest.mark.parametrize("above, hot", [(80, 20), (80, 10**9), (90, 20)])
def test_contained_pairs_equal_brute_force(frame, monkeypatch, above, hot):
    """Also where every common piece needs a second one."""
    monkeypatch.setattr(contained, "HOT_PAIRS", hot)
    texts = some_texts(21, 130, "abcd", 9) + some_texts(5, 60, "abcdefgh", 40) + ["Ä🙂b", "xÄ🙂bx", ""]
    texts = sorted(set(texts))
    random.Random(3).shuffle(texts)
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if sim.partial_ratios([texts[i]], [texts[j]])[0] > above}
    got = contained_pairs(frame(list(enumerate(texts)), "id long, value string"), above)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


@pytest.mark.parametrize("scorers", [("ratio",), ("ratio", "partial", "token_sort")])
def test_table_equals_the_dictionary(spark, frame, monkeypatch, scorers):
    texts = some_texts(33, 150, "abcdef", 14) + [f"{w} st {k}" for w in ("oak", "elm", "fir") for k in range(6)] + [f"{k} St. {w}" for w in ("oak", "elm") for k in range(6)] + ["!!", "??", ""]
    rng = random.Random(8)
    df = frame([(t,) for t in texts for _ in range(rng.randrange(1, 4))] + [(None,)], "c string")
    want = categories.fit_merge(df, "c", scorers=scorers)
    monkeypatch.setattr(categories, "FEW_VALUES", 10)
    found = categories.fit_merge(df, "c", scorers=scorers)
    assert dict(map(tuple, found.table.collect())) == want and len(want) > 40
    assert categories.fit_merge(df, "c", max_unique=20) is None
    merged = categories.apply_merge(df, "c", found)
    expect = sorted((want.get(r.c, r.c) for r in df.collect()), key=str)
    assert sorted((r.c for r in merged.collect()), key=str) == expect
