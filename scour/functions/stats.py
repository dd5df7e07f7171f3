"""Column statistics: moments, exact quantiles and modes that never pass a whole column through one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scour.functions.columns import col, join_groups, known, value_counts
from scour.session import cut_lineage

# A quantile is read off a histogram once its bracket holds at most about this many distinct values.
HISTOGRAM_LIMIT = 200_000
GROUP_LIMIT = 1_000_000
SALTS = 16
# Brackets come from this many sampled rows, whatever the table holds; exact counts confirm them.
SAMPLE_ROWS = 100_000
SAMPLE_ACCURACY = 10_000
GRID = 1_000
MAX_ROUNDS = 8


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness; NULL below three values or for a constant column."""
    n = F.count(c).cast("double")
    corrected = F.skewness(c) * F.sqrt(n * (n - 1)) / F.try_subtract(n, F.lit(2.0))
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.when(F.isnan(F.skewness(c)), None).otherwise(corrected))


def moments(df: DataFrame, names: Sequence[str], null_counts: Sequence[str] = ()) -> dict[str, dict]:
    """Count, nulls, mean, deviations, skew, min and max of the named columns in one aggregate.

    Columns in ``null_counts`` only get their row and null counts, from the same scan.
    """
    if not names and not null_counts:
        return {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        c = known(name, df).cast("double")
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.stddev_pop(c).alias(f"std_pop{i}"),
            sample_skew(c).alias(f"skew{i}"),
            F.min(c).alias(f"min{i}"),
            F.max(c).alias(f"max{i}"),
        ]
    others = [c for c in null_counts if c not in names]
    aggs += [F.count(known(c, df)).alias(f"known{i}") for i, c in enumerate(others)]
    row = df.agg(*aggs).first()
    out = {c: {"n": row[f"known{i}"]} for i, c in enumerate(others)}
    for i, name in enumerate(names):
        out[name] = {k: row[f"{k}{i}"] for k in ("n", "mean", "std", "std_pop", "skew", "min", "max")}
    return {c: s | {"rows": row["rows"], "nulls": row["rows"] - s["n"]} for c, s in out.items()}


@dataclass
class _Search:
    """One open quantile: the bracket of values around its rank, at first from the least to the largest value (None without values)."""

    name: str
    q: float
    rows: int  # known values
    ends: tuple[float | None, float | None]
    lo: float | None = None
    hi: float | None = None
    size: int = 0  # rows inside, as counted or expected
    small: bool = False

    def __post_init__(self) -> None:
        self.reset()
        if self.rows and self.rank == self.last and self.rank in (0, self.rows - 1):
            self.lo = self.hi = self.ends[self.rank > 0]  # no sample is sure to hold an end
        self.small = self.lo == self.hi

    def reset(self) -> None:
        (self.lo, self.hi), self.size = self.ends, self.rows

    @property
    def rank(self) -> int:
        return math.floor((self.rows - 1) * self.q)

    @property
    def last(self) -> int:
        return math.ceil((self.rows - 1) * self.q)

    @property
    def bounded(self) -> bool:
        return (self.lo, self.hi) != self.ends

    @property
    def key(self) -> tuple:
        return self.name, self.lo, self.hi

    def inside(self, c: Column) -> Column:
        cond = c.isNotNull()
        if self.lo is not None:
            cond = cond & (c >= F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (c <= F.lit(self.hi))
        return cond

    def holds(self, value: float) -> bool:
        return (self.lo is None or self.lo <= value) and (self.hi is None or value <= self.hi)

    def narrow(self, inside: int, below: int, drawn: int, points: Sequence[float], limit: int) -> bool:
        """Move the bracket to the grid cells around the two ranks; False when that changes nothing. At an end of the grid
        the old bound stays: a sample need not hold the least or largest value.

        The margin is six standard deviations of a share seen in ``drawn`` sampled rows, at worst.
        """
        margin = 2 if drawn == inside else 2 + math.ceil(GRID * 3 / math.sqrt(drawn))
        first = math.floor((self.rank - below) / inside * GRID) - margin
        end = math.ceil((self.last + 1 - below) / inside * GRID) + margin
        low, high = points[first] if first > 0 else self.lo, points[end] if end < GRID else self.hi
        moved = (low, high) != (self.lo, self.hi)
        # The bracket spans that many grid cells; few enough rows need no further look.
        self.size = max(1, inside * (2 * margin + 2) // GRID)
        self.small = low == high or self.size <= limit
        self.lo, self.hi = low, high
        return moved


def _split_by_value(table: DataFrame, s: _Search) -> None:
    """Narrow a bracket that equal values keep wide: cut its distinct values evenly and count rows at each cut."""
    c = col(s.name)
    cuts = [i / 16 for i in range(17)]
    points = table.where(s.inside(c)).select(c).distinct().agg(F.percentile_approx(c, cuts, SAMPLE_ACCURACY)).first()[0]
    upto = table.agg(*[F.count_if(c <= F.lit(p)).alias(f"c{i}") for i, p in enumerate(points)]).first()
    s.lo = max([p for i, p in enumerate(points) if upto[i] <= s.rank], default=s.lo)
    s.hi = min([p for i, p in enumerate(points) if upto[i] > s.last], default=s.hi)


def _collapsed(c: Column, brackets: Sequence[tuple[float | None, float | None]]) -> Column:
    """Values between the brackets become one value per gap: ranks stay right, distinct values stay few."""
    merged: list[list] = []
    for lo, hi in sorted({(-math.inf if lo is None else lo, math.inf if hi is None else hi) for lo, hi in brackets}):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    out = F.when(c > F.lit(merged[-1][1]), F.lit(math.inf)).otherwise(c)
    for (_, end), (start, _) in reversed(list(zip(merged, merged[1:]))):
        middle = end + (start - end) / 2
        out = F.when((c > F.lit(end)) & (c < F.lit(start)), F.lit(middle if math.isfinite(middle) else math.nextafter(end, start))).otherwise(out)
    return F.when(c < F.lit(merged[0][0]), F.lit(-math.inf)).otherwise(out)


def _looked(table: DataFrame, searches: Sequence[_Search], draw: Column) -> tuple[DataFrame, list[Column]]:
    """The rows that a round looks at closely, and what it asks of them: a grid over sampled rows of each bracket, and how
    many distinct values a narrowed bracket holds. Rows outside the brackets and the samples never reach the sketches.
    """
    grid = F.expr(f"array({', '.join(f'{i / GRID}D' for i in range(GRID + 1))})")  # one call, not one for each literal
    aggs, rows = [], F.lit(False)
    for i, s in enumerate(searches):
        c = col(s.name)
        inside = s.inside(c)
        taken = inside & (F.col("__draw") * s.size < SAMPLE_ROWS)
        aggs += [F.count_if(taken).alias(f"drawn{i}"), F.percentile_approx(F.when(taken, c), grid, SAMPLE_ACCURACY).alias(f"grid{i}")]
        if s.bounded:
            aggs.append(F.approx_count_distinct(F.when(inside, c)).alias(f"nd{i}"))
        rows = rows | (inside if s.bounded else taken)
    return table.withColumn("__draw", draw).where(rows), aggs


def exact_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]], limit: int = HISTOGRAM_LIMIT, seed: int = 7) -> dict[str, list]:
    """Exact linearly interpolated quantiles of several columns.

    Rounds each narrow a value bracket around every wanted rank: a bounded random sample proposes it, and the next round
    starts with exact counts that confirm it. Once few rows or few distinct values remain, the last job counts
    those with a distributed ``groupBy`` and interpolates. Up to half a million rows one round is enough.
    """
    if not any(len(qs) for qs in wanted.values()):
        return {}
    table = df.select(*[known(name, df).cast("double").alias(name) for name in wanted])
    row = table.agg(*[f(col(name)).alias(f"{k}{i}") for i, name in enumerate(wanted) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    searches = [_Search(name, q, row[f"n{i}"], (row[f"lo{i}"], row[f"hi{i}"])) for i, (name, qs) in enumerate(wanted.items()) for q in dict.fromkeys(qs)]
    for s in searches:
        s.small = s.small or s.rows <= limit
    turn = 0
    while any(not s.small for s in searches):
        keys = list(dict.fromkeys(s.key for s in searches if not s.small and s.bounded))
        spans = {s.key: (0, s.rows) for s in searches if not s.small and not s.bounded}
        if keys:
            inside = {s.key: s.inside(col(s.name)) for s in searches}
            aggs = [(F.count_if(col(name) < F.lit(lo)), F.count_if(inside[name, lo, hi])) for name, lo, hi in keys]
            row = table.agg(*[c for pair in aggs for c in pair]).first()
            spans |= {key: (row[2 * i], row[2 * i + 1]) for i, key in enumerate(keys)}
        for s in [s for s in searches if not s.small]:
            below, s.size = spans[s.key]
            if not below <= s.rank <= s.last < below + s.size:
                s.reset()  # the sample misled: look at the whole column again
                spans[s.key] = 0, s.rows
            elif s.size <= limit:
                s.small = True
        looked = {s.key: s for s in searches if not s.small}
        if not looked:
            break
        # Should the samples keep failing, every row is drawn and the rounds are certain to end.
        draw = F.rand(seed + turn) if turn < MAX_ROUNDS else F.lit(0.0)
        rows, aggs = _looked(table, list(looked.values()), draw)
        row = rows.agg(*aggs).first().asDict()
        position = {key: i for i, key in enumerate(looked)}
        for s in [s for s in searches if not s.small]:
            i, (below, inside) = position[s.key], spans[s.key]
            points = row[f"grid{i}"]
            if row.get(f"nd{i}", inside) <= limit:
                s.small = True
            elif not (points and s.narrow(inside, below, row[f"drawn{i}"], points, limit)) and not s.small:
                _split_by_value(table, s)
        turn += 1
    names = list(wanted)
    cells = [
        F.struct(F.lit(i).alias("item"), _collapsed(col(c), [(s.lo, s.hi) for s in searches if s.name == c]).alias("v"))
        for i, c in enumerate(names)
    ]
    histogram = (
        table.select(F.explode(F.array(*cells)).alias("x"))
        .where(F.col("x.v").isNotNull())
        .groupBy(F.col("x.item").alias("item"), F.col("x.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    found = []
    for i, name in enumerate(names):
        mine = F.col("item") == i
        qs = [s.q for s in searches if s.name == name]
        found.append(F.percentile(F.when(mine, F.col("v")), qs, F.when(mine, F.col("freq")).otherwise(0)).alias(f"q{i}"))
    row = histogram.agg(*found).first()
    out: dict[str, list] = {}
    for i, name in enumerate(names):
        mine = [s for s in searches if s.name == name]
        by_q = dict(zip([s.q for s in mine], row[f"q{i}"] or []))
        if any(not s.holds(by_q[s.q]) for s in mine if s.q in by_q):
            by_q = dict(zip(wanted[name], exact_quantiles(df, {name: wanted[name]}, limit, seed + 1)[name]))
        out[name] = [by_q.get(q) for q in wanted[name]]
    return out


def approximate_quantiles(df: DataFrame, wanted: dict[str, Sequence[float]], accuracy: int = 10_000) -> dict[str, list]:
    """One-scan sketch quantiles (an existing value per quantile, no interpolation)."""
    aggs = [
        F.percentile_approx(known(name, df).cast("double"), list(qs), accuracy).alias(f"q{i}")
        for i, (name, qs) in enumerate(wanted.items())
    ]
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    return {name: row[f"q{i}"] or [None] * len(qs) for i, (name, qs) in enumerate(wanted.items())}


def _salted(groups: DataFrame) -> DataFrame:
    """Each group's row once for every salt."""
    return groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def grouped_quantile(df: DataFrame, keys: Sequence[str], name: str, q: float, out: str, limit: int = GROUP_LIMIT) -> DataFrame:
    """Exact interpolated quantile per group.

    A bounded sample per group brackets the rank and exact counts confirm it, again while some
    group keeps more than ``limit`` rows in its bracket. Only the distinct values inside the bracket
    are ordered, so a group holding a third of the table leaves a thin slice for its window. Rows meet
    their group's bracket under a salt made from the value: a hot group is joined and counted in several tasks, and an
    exchange lies between them and the window. A NULL key is a group; without keys the table is one.
    """
    if not keys:
        found = exact_quantiles(df, {name: [q]})[name][0]
        return df.sparkSession.createDataFrame([(found,)], f"`{out}` double")
    by = [col(k) for k in keys]
    grid = [i / GRID for i in range(GRID + 1)]
    cells = df.select(*by, known(name, df).cast("double").alias("__v")).withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SALTS)))
    n, v, lo, hi, size = (F.col(c) for c in ("__n", "__v", "__lo", "__hi", "__in"))
    rank, last = F.floor((n - 1) * F.lit(float(q))), F.ceil((n - 1) * F.lit(float(q)))
    whole = [F.lit(-math.inf).alias("__lo"), F.lit(math.inf).alias("__hi")]
    state = cells.groupBy(*by).agg(F.count(v).alias("__n")).select(*by, "__n", n.alias("__in"), *whole)
    state = cut_lineage(state)
    total, widest = state.agg(F.sum("__n"), F.max("__n")).first()
    for turn in range(MAX_ROUNDS):
        if not widest or widest <= limit and (turn or total <= limit):
            break
        within = v.between(lo, hi)
        taken = F.when(within & (F.col("__draw") * size < SAMPLE_ROWS), v)
        drawn = cells.withColumn("__draw", F.rand(turn))
        looked = join_groups(drawn, _salted(state), [*keys, "__salt"]).groupBy(*by, "__n", "__in", "__lo", "__hi").agg(
            F.count_if(v < lo).alias("__below"),
            F.count_if(within).alias("__found"),
            F.approx_count_distinct(F.when(within, v)).alias("__nd"),
            F.count(taken).alias("__drawn"),
            F.percentile_approx(taken, grid, SAMPLE_ACCURACY).alias("__grid"),
        )
        found, sampled = F.col("__found"), F.greatest(F.col("__drawn"), F.lit(1))
        margin = F.when(sampled >= found, 2).otherwise(2 + F.ceil(GRID * 3 / F.sqrt(sampled)))
        first, end = ((r - F.col("__below")) / found * GRID for r in (rank, last + 1))
        low = F.get("__grid", F.greatest(F.lit(0), F.floor(first) - margin).cast("int"))
        high = F.get("__grid", F.least(F.lit(GRID), F.ceil(end) + margin).cast("int"))
        caught = (F.col("__below") <= rank) & (last < F.col("__below") + found)
        few = (found <= limit // 8) | F.col("__grid").isNull()
        state = cut_lineage(
            looked.select(
                *by, "__n", "__nd",
                F.when(~caught, n).when(few, found).otherwise(F.ceil(found * (2 * margin + 2) / GRID)).alias("__in"),
                F.when(~caught, F.lit(-math.inf)).when(few, lo).otherwise(low).alias("__lo"),
                F.when(~caught, F.lit(math.inf)).when(few, hi).otherwise(high).alias("__hi"),
            )
        )
        widest = state.agg(F.max(F.least("__in", "__nd"))).first()[0]
    counted = (
        join_groups(cells, _salted(state.select(*by, "__n", "__lo", "__hi")), [*keys, "__salt"])
        .where(v <= hi)
        .withColumn("__v", F.when(v < lo, F.lit(-math.inf)).otherwise(v))
        .groupBy(*by, "__salt", "__n", "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    order = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__cum", F.sum("__c").over(order))
    first = F.min(F.when(F.col("__cum") > rank, v))
    second = F.min(F.when(F.col("__cum") > last, v))
    part = F.max((n - 1) * F.lit(float(q)) - rank)
    value = F.when(part == 0, first).otherwise(first * (1 - part) + second * part)
    return join_groups(state.select(*by), ranked.groupBy(*by).agg(value.alias(out)), keys, "left")


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column, as text; ties go to the smallest value."""
    out: dict[str, str | None] = {name: None for name in names}
    if names:
        first = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value")))
        for row in value_counts(df, names).groupBy("column").agg(first.alias("top")).collect():
            out[row["column"]] = row["top"]["value"]
    return out


def distinct_counts(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Number of distinct non-null values per column, told apart by 128 bits of hash: no text is shuffled."""
    out = {name: 0 for name in names}
    if names:
        texts = [known(c, df).cast("string") for c in names]
        cells = [F.when(v.isNotNull(), F.struct(F.lit(i).alias("item"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))) for i, v in enumerate(texts)]
        hashed = df.select(F.explode(F.array(*cells)).alias("cell")).where("cell IS NOT NULL").select("cell.*").distinct()
        for row in hashed.groupBy("item").agg(F.count(F.lit(1)).alias("n")).collect():
            out[names[row["item"]]] = row["n"]
    return out
