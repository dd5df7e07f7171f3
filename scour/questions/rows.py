"""Questions about rows in the order of any columns, with or without a key: no day, no calendar, no window over the whole table.

The table is dealt into consecutive ranges of (key, order). A window of n rows also needs the n - 1 rows before its range, so each range
receives the last rows of the ranges before it (halo rows), which are found from the ranges' ends alone. So a series without a key, and a key that holds most of the rows, run on all tasks.

Orders are ascending, null first; name enough columns to tell rows apart, as rows equal in all of them come in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from scour.functions.columns import col, join_groups
from scour.functions.ranges import RANGE_ROWS, free_name, ranged


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, rows: int = RANGE_ROWS) -> tuple[DataFrame, str, str]:
    """``df`` in ranges, each with copies of the ``size`` rows of its first key that come before it; the names of the range and
    of the flag of copies.

    The last ``size`` rows of every range and key are candidates; of those, a range takes the last ``size`` of the ranges before it,
    however many of them it takes to make that up.
    """
    at, halo = free_name(df, "range"), free_name(df, "halo")
    parts = ranged(df, [*keys, *order], rows, at)
    if size < 1:
        return parts.withColumn(halo, F.lit(False)), at, halo
    back = Window.partitionBy(*[col(c) for c in (*keys, at)]).orderBy(*[col(o).desc_nulls_last() for o in order])
    tails = parts.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= size)
    # One row a range and key: where a range begins, and how many tail rows lie in it.
    spans = tails.groupBy(*[col(k) for k in keys], col(at)).agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(at))
    # A tail row reaches into the ranges after it until ``size`` rows lie between.
    later = spans.withColumn("__before", F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = later.withColumn("__ends", F.col("__before") + F.col("__n"))
    # Each range meets the few before it that still hold some of its last ``size`` rows: both sides are numbered along the key.
    near = _stepped(own, keys, at, size)
    copies = join_groups(tails, near, [*keys, at]).where(F.col("__back") <= F.col("__take"))
    copies = copies.withColumn(at, F.col("__to")).drop("__to", "__take", "__back").withColumn(halo, F.lit(True))
    return parts.withColumn(halo, F.lit(False)).unionByName(copies), at, halo


def _stepped(own: DataFrame, keys: Sequence[str], at: str, size: int) -> DataFrame:
    """keys, range, __to, __take: a range and each later one that needs its last ``__take`` rows. A range has at least one row of its key, so
    at most ``size`` ranges lie between."""
    along = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(at))
    following = F.collect_list(F.struct(col(at).alias("to"), F.col("__before").alias("starts"))).over(along.rowsBetween(1, size))
    rows = own.withColumn("__next", following).withColumn("__next", F.explode("__next"))
    between = F.col("__next.starts") - F.col("__ends")
    take = F.least(F.lit(size) - between, F.col("__n"))
    return rows.select(*[col(k) for k in keys], col(at), F.col("__next.to").alias("__to"), take.alias("__take")).where("__take > 0")


def row_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], exprs: dict[str, Callable[[WindowSpec], Column]], size: int, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with columns computed over the row and the ``size`` rows before it: each entry of ``exprs`` makes one from the ordered window."""
    parts, at, halo = with_halo(df, keys, order, size, rows)
    window = Window.partitionBy(*[col(c) for c in (at, *keys)]).orderBy(*[col(o) for o in order])
    out = parts
    for name, make in exprs.items():
        out = out.withColumn(name, make(window))
    return out.where(~col(halo)).drop(at, halo)


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, sizes: Sequence[int], rows: int = RANGE_ROWS) -> DataFrame:
    """``ma_n`` over the last n rows in order; NULL until n rows are there."""

    def mean(n: int):
        def over(window):
            frame = window.rowsBetween(1 - n, 0)
            return F.when(F.count(F.lit(1)).over(frame) == n, F.avg(col(value)).over(frame))

        return over

    return row_windows(df, keys, order, {f"ma_{n}": mean(n) for n in sizes}, max(sizes) - 1, rows)


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """``previous``, ``change`` and ``change_pct`` against the row before."""
    moved = row_windows(df, keys, order, {"previous": lambda w: F.lag(col(value)).over(w)}, 1, rows)
    moved = moved.withColumn("change", col(value) - F.col("previous"))
    return moved.withColumn("change_pct", F.try_divide((F.col("change") * 100).cast("double"), F.col("previous").cast("double")))


def longest_streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Per direction (rising, falling, equal) the longest run of changes between consecutive rows: its length and the order columns
    of its first and last row, as ``first_`` and ``last_``; the earliest run on a tie. A change from or to NULL ends a run.

    Runs are counted inside ranges. Only the first and the last run of a range can go on elsewhere: these few are put together in order.
    """
    by = [col(k) for k in keys]
    parts, at, halo = with_halo(df, keys, order, 1, rows)
    inside = Window.partitionBy(col(at), *by).orderBy(*[col(o) for o in order])
    sign = F.signum((col(value) - F.lag(col(value)).over(inside)).cast("double")).cast("int")
    spot = F.struct(*[col(o) for o in order])
    signed = parts.select(*by, col(at), col(halo), spot.alias("__spot"), sign.alias("__sign"), *[col(o) for o in order if o not in keys]).where(~col(halo))
    starts = F.when(F.col("__sign").eqNullSafe(F.lag("__sign", 1, 9).over(inside)), 0).otherwise(1)
    signed = signed.withColumn("__start", starts).withColumn("__run", F.sum("__start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = signed.groupBy(*by, col(at), "__run", "__sign").agg(F.count(F.lit(1)).alias("__n"), F.min("__spot").alias("__first"), F.max("__spot").alias("__last"))
    ends = runs.groupBy(*by, col(at)).agg(F.max("__run").alias("__runs"))
    runs = join_groups(runs, ends, [*keys, at])
    edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__runs"))
    along = Window.partitionBy(*by).orderBy(col(at), F.col("__run"))
    # Two runs are one if they meet at the border of two ranges.
    same = (F.lag("__sign").over(along).eqNullSafe(F.col("__sign"))) & (F.lag(col(at)).over(along) != col(at)) & (F.lag(F.col("__run") == F.col("__runs")).over(along)) & (F.col("__run") == 1)
    joined = runs.where(edge).withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    joined = joined.withColumn("__group", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*by, "__group", "__sign").agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first"), F.max("__last").alias("__last")).drop("__group")
    every = joined.unionByName(runs.where(~edge).select(*joined.columns)).where("__sign IS NOT NULL")
    rank = F.struct((-F.col("__n")).alias("n"), F.col("__first").alias("f"))
    best = every.groupBy(*by, "__sign").agg(F.min_by(F.struct("__n", "__first", "__last"), rank).alias("__row"))
    name = F.when(F.col("__sign") > 0, "rising").when(F.col("__sign") < 0, "falling").otherwise("equal").alias("direction")
    ends = [F.col(f"__row.__{side}")[o].alias(f"{side}_{o}") for side in ("first", "last") for o in order]
    return best.select(*by, name, F.col("__row.__n").alias("length"), *ends)
