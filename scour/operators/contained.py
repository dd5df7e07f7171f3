"""All pairs of strings of which one nearly occurs inside the other (a partial score above a limit), by an index of pieces.

For the partial score the shorter string meets windows of the longer one of its own length, cut at the longer one's end. A
score above the limit leaves so few unmatched characters on both sides that, of one more disjoint piece of the shorter
string, one stands whole in the window. Pieces are looked up among the substrings of all strings by an equi-join; a piece that very
many strings hold (a common prefix, say) must have a second one from the rest of the string on the same side of it. A pair that meets must also have nearly all letters of the shorter string in the longer one, which bit masks tell inside the join. What
is left is scored: first by the common subsequence with the whole longer string, a bound that runs over batches, then exactly.
Many strings of moderate length meet by the grams that the shorter one and the window must share instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scour.functions.similarity import lcs_lengths, partial_ratios, ratios
from scour.operators.grams import GRAM_LENGTH, gram_pairs, lacking, masks
from scour.operators.pairs import LETTERS, _least_common, least_common
from scour.session import cut_lineage

# A piece that would bring more than this many pairs together is joined with one more piece.
HOT_PAIRS = 250_000
SCORED = 1 << 16
# Below this limit strings of many lengths may share less than two grams with a window.
GRAMS_ABOVE = 75


def _share(above: int) -> float:
    """The least ratio, from 0 to 1, that rounds to more than ``above``."""
    return (above + 0.5) / 100


def _edits(n: Column, above: int) -> Column:
    """The most unmatched characters, both sides together, that a string of ``n`` characters and a window may have."""
    # The bound rises with the total by 1 - r on average and is off by less than 2 from rounding, so shorter windows matter only this far.
    reach = math.ceil(2 / (1 - _share(above))) + 1
    totals = F.sequence(F.greatest(n * 2 - reach, F.lit(1)), n * 2)
    return F.greatest(F.array_max(F.transform(totals, lambda t: (t - 2 * _least_common(t, above)).cast("int"))), F.lit(0))


def least_shared(n: int, above: int) -> int:
    """The fewest characters of a string of ``n`` that must be matched, over all windows it can meet."""
    return min((least_common(n + w, above) for w in range(1, n + 1) if least_common(n + w, above) <= w), default=n)


def _substrings(text: Column, size: int) -> Column:
    """All substrings of a length, in order; a shorter text gives itself."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def _cut(text: Column, first: Column, length: Column, parts: Column, side: int) -> Column:
    """Structs (side, start, piece) of ``parts`` even pieces of ``length`` characters from ``first`` on; none if there are no parts."""

    def piece(i: Column) -> Column:
        start = F.floor(i * length / parts).cast("int")
        size = F.floor((i + 1) * length / parts).cast("int") - start
        return F.struct(F.lit(side).alias("side"), (first + start).alias("start"), F.substring(text, first + start + 1, size).alias("piece"))

    return F.when(parts > 0, F.transform(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0))), piece)).otherwise(F.array().cast("array<struct<side:int,start:int,piece:string>>"))


def _lengths(pieces: DataFrame) -> list[int]:
    """Which lengths pieces have: a few small numbers."""
    return sorted(r[0] for r in pieces.select(F.char_length("piece")).distinct().collect())


def _met(short: DataFrame, long: DataFrame, keys: list[str], above: int) -> DataFrame:
    """Pairs (s, l) that share a key and nearly all letters, the shorter first; of two equally long ones the smaller id."""
    # With w >= common >= r * (n + w) / 2, at most this share of the shorter string's characters has no partner.
    spare = (2 - 2 * _share(above)) / (2 - _share(above)) + 1e-9
    x, y = short.alias("x"), long.alias("y")
    missing = F.bit_count(F.col("x.mask").bitwiseAND(F.bitwise_not(F.col("y.mask"))))
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    same = reduce(lambda a, b: a & b, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys])
    met = x.join(y, same & ordered & (missing <= F.floor(F.col("x.n") * spare)))
    return met.select(F.col("x.id").alias("s"), F.col("y.id").alias("l"), F.col("x.value").alias("short"), F.col("y.value").alias("long"))


def _refined(rows: DataFrame, short: DataFrame, hot: DataFrame, above: int) -> DataFrame:
    """Pairs that share a piece held by very many strings, by one more piece before or behind it.

    If a piece stands whole in the window, the rest of the shorter string, cut into as many pieces again, has one that does, on the same side.
    """
    before, behind = F.col("start"), F.col("n") - F.col("start") - F.col("size")
    ahead = F.floor(F.col("parts") * before / (before + behind)).cast("int")
    rest = F.concat(_cut(F.col("value"), F.lit(0), before, ahead, 0), _cut(F.col("value"), F.col("start") + F.col("size"), behind, F.col("parts") - ahead, 1))
    seconds = short.withColumnRenamed("piece", "first").withColumn("second", F.explode(rest)).select("id", "value", "n", "mask", "first", "second.side", "second.piece")
    sizes = _lengths(seconds)
    if not sizes:
        return _met(seconds, seconds, ["id"], above)
    longest = short.agg(F.max("n")).first()[0]
    firsts = F.concat(*[F.transform(_substrings(F.col("value"), k), lambda p, i: F.struct((i + 1).alias("at"), p.alias("first"))) for k in _lengths(hot)])
    spots = rows.withColumn("spot", F.explode(firsts)).select("id", "value", "n", "mask", "spot.*").join(hot.withColumnRenamed("piece", "first"), "first")
    left = F.substring("value", F.greatest(F.col("at") - longest, F.lit(1)), F.least(F.col("at") - 1, F.lit(longest)))
    right = F.substring("value", F.col("at") + F.char_length("first"), F.lit(longest))
    near = [F.transform(_substrings(text, k), lambda p: F.struct(F.lit(side).alias("side"), p.alias("piece"))) for side, text in ((0, left), (1, right)) for k in sizes]  # noqa: B023
    other = spots.withColumn("o", F.explode(F.array_distinct(F.concat(*near)))).select("id", "value", "n", "mask", "first", "o.*")
    return _met(seconds, other, ["first", "side", "piece"], above)


def shared_grams(n: int, above: int) -> int:
    """How many grams, at least, a string of ``n`` characters shares with a window it is similar to."""
    needs = [(w, least_common(n + w, above)) for w in range(1, n + 1)]
    return min(need - (n + w - 2 * need) - 1 for w, need in needs if need <= w)


def _candidates(rows: DataFrame, above: int, first: DataFrame | None = None) -> DataFrame:
    """Pairs of ``rows`` that may be similar, only those with the shorter string from ``first`` if that is given."""
    parts = F.least(_edits(F.col("n"), above) + 1, F.col("n"))
    short = (rows if first is None else first).withColumn("parts", parts).withColumn("cut", F.explode(_cut(F.col("value"), F.lit(0), F.col("n"), F.col("parts"), 0)))
    short = short.select("id", "value", "n", "mask", "parts", "cut.start", "cut.piece", F.char_length("cut.piece").alias("size"))
    sizes = _lengths(short)
    if not sizes:
        return _met(short, short, ["id"], above)
    every = F.array_distinct(F.concat(*[_substrings(F.col("value"), k) for k in sizes]))
    long = rows.withColumn("piece", F.explode(every))
    if rows.count() ** 2 <= HOT_PAIRS:
        return _met(short, long, ["piece"], above)
    n, m = (df.groupBy("piece").agg(F.count(F.lit(1)).alias(c)) for df, c in ((short, "n"), (long, "m")))
    hot = cut_lineage(n.join(m, "piece").where(F.col("n") * F.col("m") > HOT_PAIRS).select("piece"))
    if not hot.limit(1).count():
        return _met(short, long, ["piece"], above)
    # A piece with too little around it stays with the first join; its pairs are similar but for a few characters.
    fits = F.col("n") - F.col("size") >= F.col("parts")
    crowded = short.join(hot, "piece", "left_semi").where(fits)
    plain = short.join(hot.withColumn("hot", F.lit(True)), "piece", "left").where(F.col("hot").isNull() | ~fits)
    return _met(plain, long, ["piece"], above).union(_refined(rows, cut_lineage(crowded), hot, above))


def _found(s: np.ndarray, l: np.ndarray, short: list[str], long: list[str], need: dict[int, int], above: int) -> pd.DataFrame:
    """(a, b) of the candidates that are similar."""
    least = np.array([need.get(len(t)) or need.setdefault(len(t), least_shared(len(t), above)) for t in short], dtype=np.int64)
    near = np.flatnonzero(lcs_lengths(short, long) >= least) if short else np.zeros(0, dtype=np.int64)
    # The end of the longer string is a window of every pair.
    sure = ratios([short[i] for i in near], [long[i][-len(short[i]) :] for i in near]) > above if len(near) else near > 0
    done, near = near[sure], near[~sure]
    first = [short[i] if s[i] < l[i] else long[i] for i in near]
    second = [long[i] if s[i] < l[i] else short[i] for i in near]
    hit = np.r_[done, near[partial_ratios(first, second) > above] if len(near) else near]
    return pd.DataFrame({"a": np.minimum(s[hit], l[hit]), "b": np.maximum(s[hit], l[hit])})


def _scorer(longest: int, above: int):
    least = np.array([0] + [least_shared(n, above) for n in range(1, longest + 1)])

    def scorer(group: pd.DataFrame):
        texts, ids = group["value"].tolist(), group["id"].to_numpy()
        n, marks = np.array([len(t) for t in texts]), masks(texts)

        def ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            swap = (n[a] > n[b]) | (n[a] == n[b]) & (ids[a] > ids[b])
            return np.where(swap, b, a), np.where(swap, a, b)

        def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a, b = ordered(a, b)
            return lacking(marks, a, b) <= n[a] - least[n[a]]

        def scored(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
            a, b = ordered(a, b)
            parts = [slice(k, k + SCORED) for k in range(0, max(len(a), 1), SCORED)]
            return pd.concat([_found(ids[a[p]], ids[b[p]], [texts[i] for i in a[p]], [texts[i] for i in b[p]], {}, above) for p in parts])

        return may, scored

    return scorer


def _by_grams(rows: DataFrame, above: int) -> tuple[DataFrame, DataFrame | None]:
    """Similar pairs of strings of moderate length, by their grams, and the candidates that pieces have to bring together."""
    lengths = sorted(r["n"] for r in rows.select("n").distinct().collect())
    shared = {n: shared_grams(n, above) for n in lengths if n <= GRAM_LENGTH}
    few, sizes, least = [n for n in shared if shared[n] < 2], [0] * (GRAM_LENGTH + 1), GRAM_LENGTH
    for n in shared:
        least = min(least, shared[n] if shared[n] >= 2 else least)
        sizes[n] = max(0, n - least + 1)
    dealt = rows.where((F.col("n") > 1) & (F.col("n") <= GRAM_LENGTH)).select(F.lit("").alias("column"), "id", "value")
    found = gram_pairs(dealt, sizes, _scorer(GRAM_LENGTH, above), "a long, b long")
    left = [_candidates(rows, above, rows.where(F.col("n").isin(few)))] if few else []
    if lengths and lengths[-1] > GRAM_LENGTH:
        left.append(_candidates(rows.where(F.col("n") > GRAM_LENGTH), above, rows.where(~F.col("n").isin(few))))
    return found, reduce(DataFrame.union, left) if left else None


def contained_pairs(nodes: DataFrame, above: int) -> DataFrame:
    """(a, b) ids, smaller first, of pairs whose partial score is above the limit, the smaller id's value as the first string.

    ``nodes``: id and value, both unique. An empty string is in no pair.
    """
    rows = cut_lineage(nodes.where("value <> ''").select("id", "value", F.char_length("value").alias("n"), F.expr(LETTERS).alias("mask")))
    found, met = None, None
    if rows.count() ** 2 > HOT_PAIRS and above >= GRAMS_ABOVE:
        found, met = _by_grams(rows, above)
        if met is None:
            return found.distinct()
    met = (_candidates(rows, above) if found is None else met).dropDuplicates(["s", "l"])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        need: dict[int, int] = {}
        for batch in batches:
            yield _found(batch["s"].to_numpy(), batch["l"].to_numpy(), batch["short"].tolist(), batch["long"].tolist(), need, above)

    rest = met.mapInPandas(scored, "a long, b long")
    return rest if found is None else found.union(rest).distinct()
