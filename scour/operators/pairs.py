"""All pairs of similar strings, exactly, without comparing every pair.

Two strings with ``d`` unmatched characters still share one of any ``d + 1`` pieces of the
shorter one, shifted by at most the unmatched characters of either side. Pieces are join
keys; the few pairs that meet are scored. A piece shared by very many strings (a common
prefix, say) is not joined on its own: the rest of both strings is cut into ``d + 1``
pieces again and one of those has to match as well. Where strings so similar must share
two grams or more, many of them meet by their rarest grams instead, in a row for each gram
and not one for each piece and shift.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scour.functions.similarity import lcs_at_least, ratios
from scour.operators.grams import GRAM_LENGTH, gram_pairs, lacking, masks
from scour.session import cut_lineage

# Strings up to this length meet through pieces, longer ones through blocks of similar length.
PIECE_LENGTH = 64
# A key is refined when it would bring more than this many pairs together.
HOT_PAIRS = 250_000
BLOCK_VALUES = 256
SCORED = 1 << 16
# Grams are of use if all pairs too short for them are of at most this length.
FEW_GRAMS = 8
NEVER = 1 << 20
BAG_BINS = 128
# One bit for each letter, by its code.
LETTERS = "aggregate(array_distinct(split(value, '')), 0L, (m, c) -> m | shiftleft(1L, pmod(ascii(c), 64)))"


def _least_common(total: Column, above: int) -> Column:
    """Fewest common characters for a rounded score above ``above`` (halves round to the even score)."""
    scaled = total * F.lit(10 * above + 5)
    whole = F.floor(scaled / 2000)
    return whole + 1 if above % 2 == 0 else F.when(scaled % 2000 == 0, whole).otherwise(whole + 1)


def least_common(total: int, above: int) -> int:
    scaled = total * (10 * above + 5)
    return scaled // 2000 + 1 if above % 2 == 0 else -(-scaled // 2000)


def _length_pairs(values: DataFrame, side: str, above: int, lengths: list[int]) -> DataFrame:
    """Each value with every partner length that occurs and that it can be similar to, as (short_len, long_len, edits)."""
    part = (10 * above + 5) / (2000 - (10 * above + 5))
    n = F.char_length("value")
    if side == "short":
        rows = values.where(n <= PIECE_LENGTH).withColumn("short_len", n)
        rows = rows.withColumn("long_len", F.explode(F.sequence(n, F.floor(n / part + 1e-9).cast("int")))).where(F.col("long_len").isin(lengths))
    else:
        rows = values.where(n <= PIECE_LENGTH / part + 1).withColumn("long_len", n)
        rows = rows.withColumn("short_len", F.explode(F.sequence(F.ceil(n * part - 1e-9).cast("int"), n)))
        rows = rows.where((F.col("short_len") <= PIECE_LENGTH) & F.col("short_len").isin(lengths))
    total = F.col("short_len") + F.col("long_len")
    rows = rows.withColumn("edits", (total - 2 * _least_common(total, above)).cast("int"))
    return rows.where(F.col("edits") >= F.col("long_len") - F.col("short_len"))


def _pieces(rows: DataFrame, side: str) -> DataFrame:
    """Explode ``rest`` into keyed pieces. The short side has ``edits + 1`` pieces, the long side every shift of each."""
    parts = F.col("edits") + 1
    i, short, long = F.col("piece"), F.col("short_rest"), F.col("long_rest")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    rows = rows.withColumn("start", F.floor(i * short / parts).cast("int"))
    rows = rows.withColumn("size", (F.floor((i + 1) * short / parts) - F.col("start")).cast("int"))
    if side == "short":
        rows = rows.withColumn("at", F.col("start"))
    else:
        lost = F.floor((F.col("edits") - (long - short)) / 2).cast("int")
        first = F.greatest(F.lit(0), F.col("start") - lost)
        last = F.least(long - F.col("size"), F.col("start") + lost + (long - short))
        rows = rows.where(first <= last).withColumn("at", F.explode(F.sequence(first, last)))
    text = F.substr(F.col("rest"), F.col("at") + 1, F.col("size"))
    before = F.substr(F.col("rest"), F.lit(1), F.col("at"))
    after = F.substr(F.col("rest"), F.col("at") + F.col("size") + 1)
    rows = rows.withColumn("key", F.xxhash64("key", "piece", text)).withColumn("rest", F.concat(before, after))
    return rows.withColumns({"short_rest": short - F.col("size"), "long_rest": long - F.col("size")}).drop(
        "piece", "start", "size", "at"
    )


def _sides(values: DataFrame, above: int) -> tuple[DataFrame, DataFrame]:
    out = []
    n = F.char_length("value").alias("n")
    reach = 2 * PIECE_LENGTH * 1000 // (5 * above + 1) + 2  # no string of piece length is similar to a longer one
    lengths = sorted(r["n"] for r in values.select(n).where(F.col("n") <= reach).distinct().collect())
    for side in ("short", "long"):
        rows = _length_pairs(values, side, above, lengths).withColumns(
            {
                "rest": F.col("value"),
                "short_rest": F.col("short_len"),
                "long_rest": F.col("long_len"),
                "key": F.xxhash64("column", "short_len", "long_len"),
                "letters": F.expr(LETTERS),
                "spare_short": ((F.col("edits") - F.col("long_len") + F.col("short_len")) / 2).cast("int"),
                "spare_long": ((F.col("edits") + F.col("long_len") - F.col("short_len")) / 2).cast("int"),
            }
        )
        out.append(_pieces(rows.drop("short_len", "long_len"), side))
    return out[0], out[1]


def _lacking(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))


def _met(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs that share a key, each once; of two equally long strings the smaller counts as the short one."""
    a = short.select("key", "column", F.col("value").alias("a"), F.col("letters").alias("__a"), F.col("spare_short").alias("__s"))
    b = long.select("key", F.col("column").alias("__column"), F.col("value").alias("b"), F.col("letters").alias("__b"), F.col("spare_long").alias("__l"))
    ordered = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    # Every letter that the other string lacks is an unmatched character.
    alike = (_lacking("__a", "__b") <= F.col("__s")) & (_lacking("__b", "__a") <= F.col("__l"))
    meet = a.join(b, (a["key"] == b["key"]) & (F.col("column") == F.col("__column")) & ordered & alike)
    return meet.select("column", "a", "b").distinct()


def _hot_keys(short: DataFrame, long: DataFrame) -> DataFrame:
    left = short.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    right = long.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    return left.join(right, "key").where(F.col("n") * F.col("m") > HOT_PAIRS).select("key")


def _candidates(values: DataFrame, above: int, crowded: bool) -> DataFrame:
    short, long = _sides(values, above)
    if not crowded:
        return _met(short, long)
    hot = cut_lineage(_hot_keys(short, long))
    if not hot.limit(1).count():
        return _met(short, long)
    cold = _met(short.join(hot, "key", "left_anti"), long.join(hot, "key", "left_anti"))
    refined = _met(
        _pieces(short.join(hot, "key", "left_semi"), "short"), _pieces(long.join(hot, "key", "left_semi"), "long")
    )
    return cold.unionByName(refined).distinct()


def shared_grams(n: int, m: int, above: int) -> int | None:
    """How many grams, at least, different similar strings of these lengths share; None if there are none."""
    need = least_common(n + m, above)
    edits = n + m - 2 * need
    return None if need > min(n, m) or edits < 1 else need - edits - 1


def _gram_sizes(lengths: list[int], above: int) -> tuple[list[int], int] | None:
    """How many grams the head of a string has, by its length, and the length up to which some pairs share less than two; None if that is not short."""
    longest = lengths[-1] if lengths else 0
    sizes, few = [0] * (longest + 1), 0
    for i, n in enumerate(lengths):
        for m in lengths[i:]:
            shared = shared_grams(n, m, above) if n <= PIECE_LENGTH else None
            if shared is not None and shared < 2:
                few = max(few, m)
            elif shared is not None:
                sizes[n], sizes[m] = max(sizes[n], n - shared + 1), max(sizes[m], m - shared + 1)
    return (sizes, few) if longest <= GRAM_LENGTH and few <= FEW_GRAMS else None


def _ratio_scorer(longest: int, above: int):
    least = np.array([[NEVER if shared_grams(n, m, above) is None or min(n, m) > PIECE_LENGTH else least_common(n + m, above) for m in range(longest + 1)] for n in range(longest + 1)])

    def scorer(group: pd.DataFrame):
        texts, column = group["value"].tolist(), group["column"].tolist()
        n, marks = np.array([len(t) for t in texts]), masks(texts)

        def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            need = least[n[a], n[b]]
            near = np.flatnonzero(lacking(marks, a, b) <= n[a] - need)
            out = np.zeros(len(a), dtype=bool)
            out[near] = lacking(marks, b[near], a[near]) <= n[b[near]] - need[near]
            return out

        def scored(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
            a, b = np.where(n[a] <= n[b], a, b), np.where(n[a] <= n[b], b, a)
            scores = [ratios([texts[i] for i in a[k : k + SCORED]], [texts[i] for i in b[k : k + SCORED]]) for k in range(0, len(a), SCORED)]
            score = np.concatenate(scores) if scores else np.zeros(0, dtype=int)
            hit = np.flatnonzero(score > above)
            return pd.DataFrame([(column[a[i]], *sorted((texts[a[i]], texts[b[i]])), int(score[i])) for i in hit], columns=["column", "a", "b", "score"], dtype=object)

        return may, scored

    return scorer


def _short_pairs(values: DataFrame, above: int, crowded: bool) -> DataFrame:
    """Similar pairs of which one string at least is short, with their scores."""
    if crowded:
        reach = 2 * PIECE_LENGTH * 1000 // (5 * above + 1) + 2  # as in _sides
        n = F.char_length("value")
        near = values.where(n <= reach)
        lengths = sorted(r["n"] for r in near.select(n.alias("n")).distinct().collect())
        plan = _gram_sizes(lengths, above)
        if plan is not None:
            sizes, few = plan
            rows = near.where(n > 1).select("column", F.lit(0).cast("bigint").alias("id"), "value")
            found = gram_pairs(rows, sizes, _ratio_scorer(lengths[-1], above), "column string, a string, b string, score int").distinct()
            if not few:
                return found
            short = _score_pairs(_candidates(values.where(n <= few), above, True), above)
            return found.unionByName(short.select("column", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")).distinct()
    return _score_pairs(_candidates(values, above, crowded), above)


def _score_pairs(pairs: DataFrame, above: int) -> DataFrame:
    @F.pandas_udf("int")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratios(a.tolist(), b.tolist()), index=a.index)

    return pairs.withColumn("score", score("a", "b")).where(F.col("score") > above)


def _bag(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) % BAG_BINS
    return np.bincount(codes, minlength=BAG_BINS)


def _block_scorer(above: int):
    def score(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        left = block[block["side"] == 0]
        right = block[block["side"] == 1]
        out = []
        texts = right["value"].tolist()
        lengths = np.array([len(t) for t in texts])
        bags = np.array([_bag(t) for t in texts]) if texts else None
        for column, a in zip(left["column"], left["value"]):
            if bags is None:
                break
            total = len(a) + lengths
            # Shared characters bound the common subsequence from above, so this drops no similar pair.
            shared = np.minimum(bags, _bag(a)).sum(axis=1)
            need = np.array([least_common(int(t), above) for t in total])
            for j in np.flatnonzero(shared >= need):
                b = texts[j]
                if a == b or (key[-1] and a > b):
                    continue
                common = lcs_at_least(a, b, int(need[j]))
                if common:
                    out.append((column, a, b, int(np.rint(100.0 * (2.0 * common / total[j])))))
        return pd.DataFrame(out, columns=["column", "a", "b", "score"])

    return score


def _long_pairs(values: DataFrame, above: int) -> DataFrame:
    """Long strings: blocks of a few hundred strings of similar length meet block by block, spread over all tasks."""
    step = (2000 - (10 * above + 5)) / (10 * above + 5)
    n = F.char_length("value")
    rows = values.where(n > PIECE_LENGTH).withColumn("zone", F.floor(F.log(n) / F.log(F.lit(step))).cast("int"))
    spread = F.pmod(F.xxhash64("value"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_VALUES)))
    sizes = rows.groupBy("column", "zone").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, ["column", "zone"]).withColumn("part", spread)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_VALUES)).cast("bigint")
    blocks = sizes.select("column", "zone", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    a, b = blocks.alias("a"), blocks.alias("b")
    near = (F.col("a.column") == F.col("b.column")) & (
        (F.col("b.zone") == F.col("a.zone")) & (F.col("a.part") <= F.col("b.part")) | (F.col("b.zone") == F.col("a.zone") + 1)
    )
    meet = a.join(b, near).select(
        F.col("a.column").alias("column"), F.col("a.zone").alias("zone"), F.col("a.part").alias("part"),
        F.col("b.zone").alias("zone2"), F.col("b.part").alias("part2"),
    )
    same = (F.col("zone") == F.col("zone2")) & (F.col("part") == F.col("part2"))
    meet = meet.withColumn("same", same)
    left = rows.join(meet, ["column", "zone", "part"]).withColumn("side", F.lit(0))
    right = rows.withColumnsRenamed({"zone": "zone2", "part": "part2"}).join(meet, ["column", "zone2", "part2"])
    keys = ["column", "zone", "part", "zone2", "part2", "same"]
    wanted = [*keys, "side", "value"]
    members = left.select(*wanted).unionByName(right.withColumn("side", F.lit(1)).select(*wanted))
    return members.groupBy(*keys).applyInPandas(_block_scorer(above), "column string, a string, b string, score int")


def similar_values(values: DataFrame, above: int) -> DataFrame:
    """Pairs of distinct (column, value) rows whose ratio is above the limit, smaller value first."""
    values = cut_lineage(values)
    lengths = F.char_length("value")
    row = values.agg(F.count_if(lengths <= PIECE_LENGTH).alias("short"), F.count_if(lengths > PIECE_LENGTH).alias("long")).first()
    found = _short_pairs(values, above, row["short"] ** 2 > HOT_PAIRS)
    if row["long"]:
        found = found.unionByName(_long_pairs(values, above))
    return found.select(
        "column", F.least("a", "b").alias("value1"), F.greatest("a", "b").alias("value2"), F.col("score").cast("int").alias("score")
    )
