"""String scores, fuzzy merging and the pair search against brute force."""

import random
from itertools import combinations

import pytest

from scour.functions import similarity as sim
from scour.operators import categories, contained, grams, pairs
from scour.plans.stages import apply_stage
from tests.conftest import values


def textbook_lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(line[j] + 1 if x == y else max(line[j + 1], new[j]))
        line = new
    return line[-1]


def some_texts(seed, n, letters, longest):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        if out and r.random() < 0.6:
            base = list(r.choice(sorted(out)))
            for _ in range(r.randrange(1, 1 + max(1, len(base) // 8))):
                at = r.randrange(len(base) + 1)
                base[at : at + r.randrange(2)] = r.choice(letters) if r.random() < 0.6 else ""
            text = "".join(base)
        else:
            text = "".join(r.choice(letters) for _ in range(r.randrange(1, longest)))
        if text:
            out.add(text)
    return sorted(out)


def test_lcs_equals_the_textbook():
    texts = some_texts(1, 120, "abcdé", 90)
    a, b = zip(*[(x, y) for x, y in zip(texts, reversed(texts))])
    want = [textbook_lcs(x, y) for x, y in zip(a, b)]
    assert list(sim.lcs_lengths(a, b)) == want
    assert [sim.lcs_length(x, y) for x, y in zip(a, b)] == want
    assert [sim.lcs_at_least(x, y, w) for x, y, w in zip(a, b, want)] == want
    assert [sim.lcs_at_least(x, y, w + 1) for x, y, w in zip(a, b, want)] == [0] * len(want)


@pytest.mark.parametrize(
    "a, b, ratio, partial, token_sort",
    [
        ("BUILDING", "BUILDIN", 93, 100, 93),
        ("female", "male", 80, 100, 80),
        ("new york", "york new", 50, 50, 100),
        ("abc", "xyz", 0, 0, 0),
        ("", "abc", 0, 0, 0),
    ],
)
def test_scores(a, b, ratio, partial, token_sort):
    assert sim.ratios([a], [b])[0] == ratio
    assert sim.partial_ratios([a], [b])[0] == partial
    assert sim.token_sort_ratios([a], [b])[0] == token_sort


def test_half_scores_round_to_even():
    # 200 * 171 / 400 = 85.5 rounds to 86; 200 * 161 / 400 = 80.5 rounds to 80.
    for common, score in ((171, 86), (161, 80)):
        a = "x" * common + "a" * (200 - common)
        b = "x" * common + "b" * (200 - common)
        assert sim.ratios([a], [b])[0] == score
    assert pairs.least_common(400, 85) == 171 and pairs.least_common(400, 80) == 162


def test_scores_over_columns_keep_null(frame):
    df = frame([("male", "female"), (None, "x")], "a string, b string")
    rows = {r["a"]: (r["ratio"], r["partial"]) for r in categories.pair_scores(df, "a", "b").collect()}
    assert rows == {"male": (80, 100), None: (None, None)}


DIRTY = ["BUILDING"] * 5 + ["building", " Building ", "BUILDIN"] + ["MACHINERY"] * 3 + [None]


def test_case_and_fuzzy_methods(frame):
    df = frame([(v,) for v in DIRTY], "c string")
    tidy = values(categories.standardise_case(df, "c"), "c")
    assert tidy == ["buildin"] + ["building"] * 7 + ["machinery"] * 3 + [None]
    assert values(categories.fuzzy_merge(df, "c"), "c") == ["BUILDING"] * 8 + ["MACHINERY"] * 3 + [None]
    assert values(categories.fuzzy_merge(df, "c", scorers=("ratio",)), "c").count("BUILDING") == 6
    assert values(categories.adaptive_merge(df, "c"), "c") == ["building"] * 8 + ["machinery"] * 3 + [None]


def test_partial_score_merges_contained_words(frame):
    df = frame([("female",)] * 3 + [("male",)] * 2, "c string")
    assert set(values(categories.fuzzy_merge(df, "c"), "c")) == {"female"}
    assert set(values(categories.fuzzy_merge(df, "c", scorers=("ratio",)), "c")) == {"female", "male"}


def test_merging_is_greedy_by_frequency():
    counts = [("b", 9), ("a", 5), ("c", 5), ("d", 1)]
    assert categories.merge_map(counts, [(0, 1), (1, 3), (2, 3)]) == {"a": "b", "d": "c"}


def test_guards_of_the_inconsistency_operation(frame):
    df = frame([(f"v{i % 9}",) for i in range(40)], "c string")
    op = {"c": [{"operation": "handle_inconsistencies", "method": "fuzzy_match"}]}
    out, log = apply_stage(df, op, "cleaning", config={"max_unique_for_fuzzy_matching": 5})
    assert log[0].status == "skipped" and values(out, "c") == values(df, "c")
    _, log = apply_stage(df, op, "cleaning", config={"enable_fuzzy_matching": False})
    assert log[0].status == "skipped"
    unique = frame([(f"name {i * 37}",) for i in range(60)], "c string")
    _, log = apply_stage(unique, op, "cleaning")
    assert log[0].status == "completed" and log[0].affected == 0


def test_categorical_test_patterns(frame):
    rows = [(f"yes {i}", f"text {i}", "x") for i in range(60)]
    got = categories.categorical_test(frame(rows, "p string, t string, f string"))
    assert [got[c]["categorical"] for c in ("p", "t", "f")] == [True, False, True]
    assert categories.categorical_test(frame([("yes",), (None,)] * 2 + [("no",)], "p string"))["p"]["pattern"] is False


def brute(texts, above):
    scored = ((a, b, int(sim.ratios([a], [b])[0])) for a, b in combinations(sorted(texts), 2))
    return sorted(x for x in scored if x[2] > above)


def found(spark, texts, above):
    df = spark.createDataFrame([("c", t) for t in texts], "column string, value string")
    return sorted((r["value1"], r["value2"], r["score"]) for r in pairs.similar_values(df, above).collect())


@pytest.mark.parametrize("above", [85, 80, 60])
def test_similar_short_strings_equal_brute_force(spark, above):
    texts = some_texts(7, 150, "abcd", 24)
    assert found(spark, texts, above) == brute(texts, above)


def test_common_prefixes_are_refined_and_complete(spark, monkeypatch):
    """A piece shared by many strings: the refined keys must not lose a pair."""
    monkeypatch.setattr(pairs, "HOT_PAIRS", 50)
    texts = ["http://www." + t for t in some_texts(9, 120, "abcdef", 14)]
    assert found(spark, texts, 85) == brute(texts, 85)


GROUPS = [100_000, 12]


def crowded_texts(seed, n, longest):
    return sorted({w + t for i, t in enumerate(some_texts(seed, n, "abcdefgh", longest)) for w in (["", "QQ"] if i % 3 else ["abcabc"])})


@pytest.mark.parametrize("most", GROUPS)
@pytest.mark.parametrize("above", [85, 80])
def test_many_short_strings_meet_by_grams(spark, monkeypatch, above, most):
    """No row for each piece and shift; the small groups force second grams and parts."""
    monkeypatch.setattr(pairs, "HOT_PAIRS", 50)
    monkeypatch.setattr(grams, "GROUP_VALUES", most)
    texts = crowded_texts(13, 150, 30) + ["x" * 66 + "ab", "x" * 60 + "a"]
    whole, seen = pairs._candidates, []
    monkeypatch.setattr(pairs, "_candidates", lambda values, *more: (seen.extend(r["value"] for r in values.collect()), whole(values, *more))[1])
    assert found(spark, texts, above) == brute(texts, above)
    assert max(map(len, seen), default=0) <= pairs.FEW_GRAMS


@pytest.mark.parametrize("most", GROUPS)
def test_many_contained_strings_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(contained, "HOT_PAIRS", 50)
    monkeypatch.setattr(grams, "GROUP_VALUES", most)
    texts = crowded_texts(17, 90, 24) + ["abc" * 50, "abc" * 12, "bca" * 48 + "h"]
    shortest, whole = [], contained._candidates

    def spied(rows, above, first=None):
        shortest.append((first if first is not None else rows).where("n between 5 and 128").count() * rows.where("n <= 128").count())
        return whole(rows, above, first)

    monkeypatch.setattr(contained, "_candidates", spied)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, value string")
    got = sorted((r["a"], r["b"]) for r in contained.contained_pairs(df, 80).collect())
    want = [(i, j) for i, j in combinations(range(len(texts)), 2) if sim.partial_ratios([texts[i]], [texts[j]])[0] > 80]
    assert got == want and set(shortest) == {0}


def test_similar_long_strings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_VALUES", 8)
    texts = [t * 4 for t in some_texts(11, 80, "abcdefgh", 50)]
    assert {len(t) <= pairs.PIECE_LENGTH for t in texts} == {True, False}
    assert found(spark, texts, 85) == brute(texts, 85)
