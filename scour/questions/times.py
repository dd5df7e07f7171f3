"""Questions that relate two tables by time, at any grain, with or without a key: the last known value, and what lies around an event.

*As-of lookups* merge both tables into one order and carry the last known row along. The merged table is dealt into consecutive ranges;
a range hands on at most one row, the last one known of its largest key, since only that key can go on in the next range. So a table
without a key, and a key that holds most of the rows, run on all tasks, and the carries are one row a range.

*Windows around events* are an interval join over bins as wide as the window: what lies around an event is in its bin or in one of the two beside it, so the
join has equal keys. Rows of one time are added up before they meet, and a bin that holds very many times is dealt to several tasks.

Null keys are one group. Rows whose time is null take no part as series rows; as asked rows they find nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from scour.functions.columns import col, dtype, join_groups, unique_names
from scour.functions.ranges import RANGE_ROWS, by_range, ranged
from scour.session import cut_lineage

BIN_TIMES = 10_000


def _number(df: DataFrame, name: str) -> Column:
    """A time as a number that differences can be taken of: microseconds, or days of a date."""
    kind = dtype(df, name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp"))
    return F.unix_date(col(name)).cast("long") if isinstance(kind, T.DateType) else col(name)


def _width(df: DataFrame, name: str, width: timedelta | float) -> float:
    """A width in the unit of ``_number``."""
    if not isinstance(width, timedelta):
        return width
    kind = dtype(df, name)
    if isinstance(kind, T.DateType):
        return width / timedelta(days=1)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return width // timedelta(microseconds=1)
    raise ValueError(f"{name} is a number; give the width as a number, too")


def _carries(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, __range, __carry: the last known row of ranges before, for the smallest key of each range. One row a range at most."""
    key = F.struct(F.lit(0).alias("none"), *[col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    place = F.struct("__at", "__kind", "__tie")
    states = parts.groupBy("__range", key.alias("__key")).agg(F.max_by("__seen", F.when(F.col("__seen").isNotNull(), place)).alias("__last"))
    ends = states.groupBy("__range").agg(F.min("__key").alias("first"), F.max("__key").alias("largest"), F.max_by("__last", "__key").alias("last"))
    rows = F.array(
        F.struct(F.col("first").alias("key"), F.lit(0).alias("gives"), F.lit(None).cast(parts.schema["__seen"].dataType).alias("seen")),
        F.struct(F.col("largest").alias("key"), F.lit(1).alias("gives"), F.col("last").alias("seen")),
    )
    along = Window.partitionBy("row.key").orderBy("__range", "row.gives").rowsBetween(Window.unboundedPreceding, -1)
    found = ends.select("__range", F.explode(rows).alias("row")).withColumn("__carry", F.last("row.seen", ignorenulls=True).over(along))
    found = found.where("row.gives = 0 AND __carry IS NOT NULL")
    return found.select(*[F.col("row.key")[f"k{i}"].alias(k) for i, k in enumerate(keys)], "__range", "__carry")


def last_known(
    asked: DataFrame, series: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], tie: Sequence[str] = (), strict: bool = False,
    tolerance: timedelta | float | None = None, rows: int = RANGE_ROWS,
) -> DataFrame:
    """``asked`` with ``previous_<at>`` and ``previous_<value>``: the latest row of ``series`` of the same keys at that time or before.

    Both tables have the columns ``keys`` and ``at``. Of series rows of one time the largest in ``tie`` counts. ``strict`` wants an
    earlier time; ``tolerance`` (a timedelta, or a number if times are numbers) is how old a row may be. Nothing found gives nulls.
    A value may itself be null. New names that ``asked`` has already, in any case, end in _2.
    """
    spot = F.struct(*[col(c).alias(f"t{i}") for i, c in enumerate([*tie, *values])]).alias("__tie")
    seen = F.struct(col(at).alias("at"), *[col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("__seen")
    known = series.where(col(at).isNotNull())
    known = known.select(*[col(k) for k in keys], col(at).alias("__at"), F.lit(1).alias("__kind"), spot, seen, F.lit(None).alias("__row"))
    everything = F.struct(*[col(c) for c in asked.columns]).alias("__row")
    # A question comes after the series rows of its time, or before them if they must be earlier.
    wanted = asked.select(*[col(k) for k in keys], col(at).alias("__at"), F.lit(0 if strict else 2).alias("__kind"), F.lit(None).alias("__tie"), F.lit(None).alias("__seen"), everything)
    order = ["__at", "__kind", "__tie"]
    parts = ranged(known.unionByName(wanted), [*keys, *order], rows, "__range")
    inside = Window.partitionBy("__range", *[col(k) for k in keys]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = by_range(parts, "__range").withColumn("__seen", F.last("__seen", ignorenulls=True).over(inside)).where("__row IS NOT NULL")
    found = join_groups(last, _carries(parts, keys), [*keys, "__range"], "left").withColumn("__seen", F.coalesce("__seen", "__carry"))
    if tolerance is not None:
        before = found.withColumn("__then", F.col("__seen.at"))
        age = _number(before, "__at") - _number(before, "__then")
        found = before.withColumn("__seen", F.when(age <= F.lit(_width(asked, at, tolerance)), F.col("__seen")))
    names = unique_names([f"previous_{c}" for c in (at, *values)], asked.columns)
    return found.select("__row.*", *[F.col("__seen")[f].alias(n) for f, n in zip(["at", *[f"v{i}" for i in range(len(values))]], names)])


def around_times(series: DataFrame, events: DataFrame, keys: Sequence[str], at: str, value: str, width: timedelta | float, bin_times: int = BIN_TIMES) -> DataFrame:
    """keys, ``at``, and count and mean of the known values in the ``width`` before and after each distinct event time, and the difference.

    Both tables have the columns ``keys`` and ``at``; the time of the event itself belongs to neither side. ``width`` is a timedelta, or a number if times are
    numbers. Events without a time have no row. A bin of more than ``bin_times`` distinct times is split; the events around it are copied to its parts.
    """
    size = _width(events, at, width)
    if size <= 0:
        raise ValueError("the width must be positive")
    by = [col(k) for k in keys]
    bins = lambda c: F.floor(c / F.lit(size)).cast("long")
    times = series.where(col(at).isNotNull() & col(value).isNotNull()).select(*by, _number(series, at).alias("__t"), col(value).alias("__v"))
    times = times.groupBy(*by, "__t").agg(F.sum("__v").alias("__sum"), F.count(F.lit(1)).alias("__n")).withColumn("__bin", bins(F.col("__t")))
    times = cut_lineage(times)
    split = times.groupBy(*by, "__bin").agg(F.ceil(F.count(F.lit(1)) / bin_times).cast("int").alias("__parts"))
    split = cut_lineage(split.where("__parts > 1"))  # hot bins only
    part = F.pmod(F.xxhash64("__t"), F.coalesce("__parts", F.lit(1))).cast("int")
    times = join_groups(times, split, [*keys, "__bin"], "left").withColumn("__part", part).drop("__parts")
    # Each time once, with its number; its neighbourhood is copied, nothing else of the event.
    asked = cut_lineage(events.where(col(at).isNotNull()).select(*by, col(at).alias("__at"), _number(events, at).alias("__e")).distinct())
    wide = asked.select(*by, "__e", F.explode(F.array(*[bins(F.col("__e")) + i for i in (-1, 0, 1)])).alias("__bin"))
    wide = join_groups(wide, split, [*keys, "__bin"], "left")
    wide = wide.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    met = join_groups(wide, times, [*keys, "__bin", "__part"])
    near = F.col("__t") - F.col("__e")
    met = met.where((near != 0) & near.between(-size, size))
    side = lambda test, c: F.sum(F.when(test, F.col(c)))
    sums = met.groupBy(*by, "__e").agg(
        side(near < 0, "__n").alias("n_before"), side(near < 0, "__sum").alias("__before"), side(near > 0, "__n").alias("n_after"), side(near > 0, "__sum").alias("__after"),
    )
    out = join_groups(asked, sums, [*keys, "__e"], "left")
    before, after = F.col("__before") / F.col("n_before"), F.col("__after") / F.col("n_after")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select(*by, col("__at").alias(at), count("n_before"), before.alias("mean_before"), count("n_after"), after.alias("mean_after"))
    return out.withColumn("change", F.col("mean_after") - F.col("mean_before"))
