"""Consecutive ranges of an order, so that ordered work without a key, or with one hot key, runs on every task.

A table is dealt by a sampled range partitioning and written with the number of its range. Rows of range r come
before all rows of range r + 1, so whatever an ordered window needs from outside its range is a small carry: the
rows or the state of the ranges before. The tables of carries have one row a range (and key), not one a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from scour.functions.columns import col, join_groups
from scour.session import cut_lineage

RANGE_ROWS = 500_000


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranged(df: DataFrame, order: Sequence[Column | str], rows: int = RANGE_ROWS, name: str = "range") -> DataFrame:
    """``df`` with an int column ``name``: the range of each row, ascending in ``order`` (null first).

    Rows that are equal in all of ``order`` share a range. There is at least one range for each shuffle partition
    and for each ``rows`` rows, so a range stays small however large the table is. The result is a written table:
    the ranges are the same for every reader and after the loss of an executor.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-df.count() // rows))
    by = [col(o) if isinstance(o, str) else o for o in order]
    return cut_lineage(df.repartitionByRange(n, *by).withColumn(name, F.spark_partition_id()))


def by_range(df: DataFrame, name: str = "range") -> DataFrame:
    """A ranged table, dealt so that each task has a stretch of whole ranges; windows by range need no other shuffle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, col(name))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """``df`` with a long column ``name``: the place of each row among those of its keys, from 0, in ``order`` (null first).

    A key that holds most of the rows is spread over many ranges; its parts are numbered on their own and moved by the
    counts of the parts before. Null keys are one group. Rows equal in ``order`` are numbered in any order.
    """
    at = free_name(df, "range")
    parts = ranged(df, [*keys, *order], name=at)
    groups = [*keys, at]
    sizes = parts.groupBy(*[col(c) for c in groups]).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(at)).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__rows").over(before), F.lit(0))).where("__start > 0").drop("__rows")
    inside = Window.partitionBy(*[col(c) for c in groups]).orderBy(*[col(o) for o in order])
    placed = parts.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    moved = join_groups(placed, starts, groups, "left")
    return moved.withColumn(name, col(name) + F.coalesce("__start", F.lit(0))).drop("__start", at)


def neighbours(df: DataFrame, value: str, name: str = "next", rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct known values of a column (``value``, ``name``): the next larger one, and the smallest one after the largest."""
    parts = ranged(df.where(col(value).isNotNull()).select(col(value)).distinct(), [value], rows)
    own = Window.partitionBy("range").orderBy(col(value))
    ends = parts.groupBy("range").agg(F.min(col(value)).alias("__first"))
    # One row a range: the only window without a key.
    after = ends.select((F.lag("range").over(Window.orderBy("range"))).alias("range"), col("__first"))
    wrap = ends.agg(F.min("__first").alias("__least"))
    linked = by_range(parts).withColumn("__inside", F.lead(col(value)).over(own))
    linked = linked.join(F.broadcast(after.where("range IS NOT NULL")), "range", "left").join(F.broadcast(wrap))
    return linked.select(col(value), F.coalesce("__inside", "__first", "__least").alias(name))


def split_points(df: DataFrame, value: str, rows: int = 256, most: int = 16_384) -> list:
    """At most ``most`` ascending values of a numeric column that part its known rows about evenly, one for each ``rows`` rows."""
    n = min(most, df.where(col(value).isNotNull()).count() // rows)
    if n < 1:
        return []
    shares = F.array(*[F.lit(i / (n + 1)) for i in range(1, n + 1)])
    found = df.agg(F.percentile_approx(col(value), shares, F.lit(min(20 * n, 1_000_000)))).first()[0]
    return sorted(set(found))


def place(value: Column, points: list, fan: int = 128) -> Column:
    """How many of the points are at most ``value``, in two steps of at most about ``fan`` comparisons; null gives 0."""
    if not points:
        return F.lit(0)
    groups = [points[i : i + fan] for i in range(0, len(points), fan)]
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    below = lambda xs: F.coalesce(F.size(F.filter(xs, lambda p: p <= value)), F.lit(0))
    if len(groups) == 1:
        return F.greatest(below(array(points)), F.lit(0))
    group = F.greatest(below(array([g[0] for g in groups[1:]])), F.lit(0))
    return group * fan + F.greatest(below(F.element_at(F.array(*map(array, groups)), group + 1)), F.lit(0))
