"""Pairs of strings that share rare grams: candidates for a common subsequence of a known length, without enumerating every pair.

A gram is two neighbouring characters. A common subsequence of ``c`` characters that leaves ``d`` unmatched, both sides together,
is cut into at most ``d + 1`` runs, so the strings share at least ``s = c - d - 1`` grams. With all grams in one order, rarest
first, the two rarest shared ones are among the first ``grams - s + 2`` of either string. So a string is dealt once for each gram
of that head, and those that meet there are paired by a second gram of their heads, inside the task. A gram that very many
strings hold is dealt together with a second one, and a group that is still large in parts that meet part by part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scour.functions.similarity import _codes
from scour.session import cut_lineage

# Only strings up to this length meet by their grams: a string is dealt once for each gram of its head.
GRAM_LENGTH = 128
BUCKETS = 1 << 16
# A group of more strings than this is dealt by a second gram, or in parts.
GROUP_VALUES = 16_384
# Groups are dealt to tasks in bins of about so many rows.
BIN_ROWS = 32_768
CHUNK = 1 << 21
SLICE = 8192
NONE = np.iinfo(np.int32).max

Filter = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _buckets(texts: Sequence[str]) -> np.ndarray:
    """The bucket of each gram of each text, one text a row; BUCKETS behind its end."""
    codes = _codes(texts, max(max(map(len, texts)), 2), -1).astype(np.int64)
    mixed = (codes[:, :-1] * 0x9E3779B1 + codes[:, 1:] * 0x85EBCA6B) & 0xFFFFFFFF
    return np.where(codes[:, 1:] < 0, BUCKETS, (mixed ^ mixed >> 15) % BUCKETS)


def heads(texts: Sequence[str], ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first grams of each text in their common order, ascending, then NONE. The second, third ... of equal grams are other grams."""
    rows = np.sort(_buckets(texts), axis=1)
    at = np.arange(rows.shape[1])
    new = np.ones(rows.shape, dtype=bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    nth = at - np.maximum.accumulate(np.where(new, at, 0), axis=1)
    grams = np.sort(np.where(rows < BUCKETS, ranks[np.minimum(rows, BUCKETS - 1)] * GRAM_LENGTH + nth, NONE), axis=1)
    kept = sizes[[len(t) for t in texts]]
    return np.where(at < kept[:, None], grams, NONE)


def masks(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which letters a text has, and which it has twice, one bit for each letter by its code."""
    codes = _codes(texts, max(max(map(len, texts)), 1), -1)
    once, twice = (np.zeros(len(texts), dtype=np.uint64) for _ in range(2))
    for column in codes.T:
        bit = np.where(column < 0, np.uint64(0), np.uint64(1) << (column % 64).astype(np.uint64))
        twice |= once & bit
        once |= bit
    return once, twice


def lacking(marks: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least so many characters of the texts ``a`` have no partner in the texts ``b``."""
    return sum(np.bitwise_count(m[a] & ~m[b]).astype(np.int64) for m in marks)


def _run_pairs(rows: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with an equal mark, in chunks."""
    order = np.argsort(marks, kind="stable")
    rows, marks = rows[order], marks[order]
    at = np.arange(len(rows))
    start = np.maximum.accumulate(np.where(np.r_[True, marks[1:] != marks[:-1]], at, 0)) if len(rows) else at
    before = at - start
    ends = np.cumsum(before)
    done = 0
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CHUNK, "right")))
        n = before[done:upto]
        left = np.repeat(at[done:upto], n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[done:upto], n)
        yield rows[left], rows[right]
        done = upto


def _unique(found: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([np.minimum(a, b) * n + np.maximum(a, b) for a, b in found] or [np.zeros(0, dtype=np.int64)]))
    return keys // n, keys % n


def pairs_in(rows: pd.DataFrame, ranks: np.ndarray, sizes: np.ndarray, may: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group that share another gram of their heads and pass the filter, the smaller index first."""
    texts, (gram, second, part, low, high) = rows["value"].tolist(), (rows[c].to_numpy() for c in ("gram", "second", "part", "low", "high"))
    group = rows.groupby(["column", "gram", "second", "low", "high"], sort=False).ngroup().to_numpy().astype(np.int64)
    hot = np.flatnonzero(second >= 0)
    at, marks = [hot], [-1 - group[hot]]
    for i in range(0, len(texts), SLICE):
        own = heads(texts[i : i + SLICE], ranks, sizes)
        r, c = np.nonzero((own > gram[i : i + SLICE, None]) & (own != NONE) & (second[i : i + SLICE, None] < 0))
        at.append(r + i)
        marks.append(group[r + i] * (NONE + 1) + own[r, c])
    found = []
    for a, b in _run_pairs(np.concatenate(at), np.concatenate(marks)):
        # Rows of one part meet where that part is dealt alone.
        own = (low[a] == high[a]) | (part[a] != part[b])
        a, b = a[own], b[own]
        ok = may(a, b)
        found.append((a[ok], b[ok]))
    a, b = _unique(found, max(1, len(texts)))
    kept = [_least_shared([texts[i] for i in a[k : k + SLICE]], [texts[i] for i in b[k : k + SLICE]], ranks, sizes) for k in range(0, len(a), SLICE)]
    if kept:
        first, then = (np.concatenate(x) for x in zip(*kept))
        own = (first == gram[a]) & ((second[a] < 0) | (then == second[a]))
        a, b = a[own], b[own]
    return a, b


def _least_shared(a: list[str], b: list[str], ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two rarest grams that both heads have: a pair belongs to their group alone."""
    x, y = heads(a, ranks, sizes), heads(b, ranks, sizes)
    shared = np.zeros(x.shape, dtype=bool)
    for column in y.T:
        shared |= x == column[:, None]
    shared = np.sort(np.where(shared, x, NONE), axis=1)
    return shared[:, 0], shared[:, 1] if shared.shape[1] > 1 else shared[:, 0]


def gram_ranks(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each bucket, rarest first, and how many grams the bucket of each rank has."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_buckets(batch["value"].tolist()).ravel(), minlength=BUCKETS + 1)
        used = np.flatnonzero(total[:BUCKETS])
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows.select("value").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    ranks, order = np.empty(BUCKETS, dtype=np.int64), np.argsort(counts, kind="stable")
    ranks[order] = np.arange(BUCKETS)
    return ranks, counts[order]


def gram_pairs(rows: DataFrame, sizes: Sequence[int], scorer: Callable, schema: str) -> DataFrame:
    """What ``scorer`` finds among the rows that may be similar, each pair once.

    ``rows``: column, id and value, of at most GRAM_LENGTH characters. ``sizes``: how many grams the head of a string has, by its length. ``scorer``: makes, from
    the rows of a group, the filter of index pairs and what turns pairs that pass into rows of ``schema``.
    """
    ranks, counts = gram_ranks(rows)
    size, crowded = np.array(sizes, dtype=np.int64), counts > GROUP_VALUES
    bins = 1 + int(counts.sum() + counts[crowded].sum() * max(sizes) // 2) // BIN_ROWS

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own = heads(batch["value"].tolist(), ranks, size)
            at, place = np.nonzero(own != NONE)
            gram = own[at, place]
            hot = crowded[gram // GRAM_LENGTH]
            keys = [(at[~hot], gram[~hot], np.full((~hot).sum(), -1))]
            for k in range(1, own.shape[1] if hot.any() else 0):
                # The gram of a crowded group and the k-th behind it in the same head.
                near = hot & (place + k < own.shape[1])
                second = own[at[near], place[near] + k]
                real = second != NONE
                keys.append((at[near][real], gram[near][real], second[real]))
            where, first, other = (np.concatenate(x) for x in zip(*keys))
            texts = {c: pd.Series(batch[c].to_numpy(dtype=object)[where], dtype=object) for c in ("column", "value")}
            yield pd.DataFrame({"column": texts["column"], "id": batch["id"].to_numpy()[where], "value": texts["value"], "gram": first.astype(np.int32), "second": other.astype(np.int32)})

    out = rows.select("column", "id", "value").mapInPandas(dealt, "column string, id long, value string, gram int, second int")
    groups = ["column", "gram", "second"]
    out = out.withColumns({c: F.lit(0) for c in ("part", "low", "high")})
    crowded_pairs = False
    if crowded.any():
        many = out.where("second >= 0").groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_VALUES)
        many = cut_lineage(many.withColumn("parts", F.ceil(F.col("n") / GROUP_VALUES).cast("int")).drop("n"))
        crowded_pairs = many.limit(1).count() > 0
    if crowded_pairs:
        parts = F.coalesce("parts", F.lit(1))
        out = out.join(many, groups, "left").withColumn("part", F.pmod(F.xxhash64("value"), parts).cast("int"))
        out = out.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        out = out.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("parts", "other")

    def met(group: pd.DataFrame) -> pd.DataFrame:
        may, scored = scorer(group)
        return scored(*pairs_in(group, ranks, size, may))

    key = F.pmod(F.xxhash64(*groups, "low", "high"), F.lit(bins))
    return out.withColumn("bin", key).groupBy("bin").applyInPandas(met, schema)
