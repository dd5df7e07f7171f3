import random

import numpy as np
import pytest

from scour.llm import jaccard

from tests.llm.conftest import ODD


def shingles(text, words):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words, num, den):
    rows = [(i, shingles(t, words)) for i, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in rows), key=str)


def got(df, *args):
    return sorted((tuple(r) for r in jaccard.jaccard_components(df, *args).collect()), key=str)


@pytest.mark.parametrize("words,num,den", [(3, 9, 10), (5, 4, 5)])
def test_table_equals_brute_force(documents, texts, words, num, den):
    assert got(documents, words, num, den) == brute(texts.items(), words, num, den)


def family(seed, sizes, copies):
    rng, rows = random.Random(seed), []
    for size in sizes:
        base = [f"w{rng.randrange(500)}" for _ in range(size)]
        for _ in range(copies):
            new = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(new))
                new[at : at + 1] = rng.choice([[], ["new"], [f"w{rng.randrange(500)}", new[at]]])
            rows.append(" ".join(new) or "w")
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words,num,den,partners", [(1, 9, 10, 500), (3, 9, 10, 2), (2, 4, 5, 500), (5, 4, 5, 3)])
def test_edited_families(spark, monkeypatch, words, num, den, partners):
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    rows = family(words, [2, 5, 9, 12, 18, 19, 20, 25, 30, 40, 60, 90, 130], 9)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), words, num, den) == brute(rows, words, num, den)


def test_odd_rows(odd):
    assert got(odd, 3, 9, 10) == brute(ODD, 3, 9, 10)


def test_one_id_with_several_texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (2, " ".join(reversed(words))), (3, " ".join([*reversed(words)][1:])), (4, "a b c d"), (5, "a b c d"), (5, "e f g h i"), (0, "e f g h i")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10) == brute_by_id(rows)


def brute_by_id(rows):
    """1, 2, 3 and 0, 4, 5 are connected through the ids that have two texts."""
    return sorted(((i, len(shingles(t, 3)), {1: 1, 2: 1, 3: 1}.get(i, 0)) for i, t in rows), key=str)


def test_first_of_each(odd):
    kept = jaccard.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 4, 6, 7, 8, 10, 12]


def test_empty(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string"), 3, 9, 10) == []


def test_boundary_is_where_subsets_cost_more():
    like = jaccard.Likeness(3, 9, 10)
    assert 9 <= like.boundary < 40


def test_relatives_that_differ_too_much_do_not_meet(spark):
    """Each of many relatives has more shingles of its own than a link allows: no pair of them is made."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(60):
        words = list(base)
        for at in random.Random(d).sample(range(10, 390, 4), 9):
            words[at] = f"own{d}x{at}"
        rows.append((d, " ".join(words)))
    rows.append((60, rows[7][1].replace("w5 ", "other ")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = spark.createDataFrame([(r[0], r[0]) for r in rows], "node long, cluster long")
    pairs = jaccard.rare_pairs(docs, members, jaccard.Likeness(3, 9, 10)).collect()
    assert {frozenset(p) for p in pairs} == {frozenset((7, 60))}


def relatives(count, size, gap):
    """Texts of ``size`` words of which every ``gap``-th is a text's own, and a near copy of one of them."""
    rows = [(d, " ".join(f"own{d}x{i}" if (i + d) % gap == 0 else f"w{i}" for i in range(size))) for d in range(count)]
    return [*rows, (count, rows[0][1].replace("w9 ", "other "))]


def test_relatives_of_other_sizes_need_more_lists(spark, monkeypatch):
    """Relatives share lists, but fewer than two sets of their sizes need to link: their shingles are not ranked."""
    met, ranked = [], jaccard.rare_pairs
    monkeypatch.setattr(jaccard, "rare_pairs", lambda docs, members, like: met.extend(members.collect()) or ranked(docs, members, like))
    rows = relatives(3, 340, 12)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 5) == brute(rows, 5, 4, 5)
    assert not met


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5)])
def test_links_agree_on_as_many_lists_as_needed(num, den):
    like, rng = jaccard.Likeness(3, num, den), random.Random(den)
    for _ in range(400):
        a = rng.sample(range(2**62), rng.randrange(20, 900))
        b = a[: rng.randrange(like.smallest(len(a)), len(a) + 1)]
        b += rng.sample(range(2**62, 2**63), max(0, (len(b) * (num + den) - num * (len(a) + len(b))) // num * rng.randrange(2)))
        if len(b) > like.largest(len(a)) or len(set(a) & set(b)) * (num + den) < num * (len(a) + len(b)):
            continue
        lists = [set(jaccard.list_keys(np.sort(np.array(x, np.uint64)), like, 0).tolist()) for x in (a, b)]
        side = like.size_class(max(len(a), len(b))) % 2
        shared = sum(k % 2 == side for k in lists[0] & lists[1])
        assert shared >= max(like.needed(len(x))[side] for x in (a, b))
