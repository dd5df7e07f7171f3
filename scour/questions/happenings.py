"""Questions about dated events: how many, how often, how far apart, and what a series does around them.

Events are reduced to one row per key and day before any ordered window, as in ``series``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from scour.functions.columns import col, divide, join_groups


def _by(keys: Sequence[str]) -> list[Column]:
    return [col(k) for k in keys]


def event_days(df: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    """keys, day, events."""
    return df.where(col(ts).isNotNull()).groupBy(*_by(keys), F.to_date(col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("events"))


def extent(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of events, first and last day, and the years between them."""
    first, last = F.min("day"), F.max("day")
    return days.groupBy(*_by(keys)).agg(
        F.sum("events").alias("events"), first.alias("first_day"), last.alias("last_day"),
        (F.year(last) - F.year(first)).cast("int").alias("years"),
    )


def per_period(days: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Events per year, decade, quarter or month of the year."""
    parts = {
        "year": F.year("day"),
        "decade": (F.floor(F.year("day") / 10) * 10).cast("int"),
        "quarter": F.quarter("day"),
        "month": F.month("day"),
    }
    return days.groupBy(*_by(keys), parts[period].cast("int").alias(period)).agg(F.sum("events").alias("events"))


def busiest(days: DataFrame, keys: Sequence[str], period: str, k: int = 3) -> DataFrame:
    """The k periods with the most events over all keys; ties go to the earlier period."""
    return per_period(days, keys, period).orderBy(F.desc("events"), period, *_by(keys)).limit(k)


def distribution(df: DataFrame, name: str) -> DataFrame:
    """Each value with its count, the most frequent first flag, and the number of distinct values."""
    counts = df.where(col(name).isNotNull()).groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(
        F.min_by("value", F.struct((-F.col("n")).alias("r"), F.col("value").alias("v"))).alias("mode"), F.count(F.lit(1)).alias("distinct")
    ).first()
    return counts.select(
        "value", "n", (F.col("value") == F.lit(top["mode"])).alias("is_mode"), F.lit(top["distinct"]).cast("bigint").alias("distinct")
    )


def longest_gap(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest time between two neighbouring event days, the earliest on a tie."""
    previous = F.lag("day").over(Window.partitionBy(*_by(keys)).orderBy("day"))
    gaps = days.select(*_by(keys), previous.alias("from_day"), F.col("day").alias("to_day")).where("from_day IS NOT NULL")
    gaps = gaps.withColumn("gap_days", F.datediff("to_day", "from_day"))
    rank = F.struct((-F.col("gap_days")).alias("g"), F.col("from_day").alias("d"))
    best = gaps.groupBy(*_by(keys)).agg(F.min_by(F.struct("from_day", "to_day", "gap_days"), rank).alias("row"))
    return best.select(*_by(keys), "row.*")


def clusters(days: DataFrame, keys: Sequence[str], gap: int, least: int = 2) -> DataFrame:
    """Runs of event days no more than ``gap`` days apart, holding at least ``least`` events."""
    over = Window.partitionBy(*_by(keys)).orderBy("day")
    far = F.datediff("day", F.lag("day").over(over)) > gap
    marked = days.withColumn("start", F.when(far, 1).otherwise(0))
    marked = marked.withColumn("cluster", F.sum("start").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*_by(keys), "cluster").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("events").alias("events")
    )
    return runs.where(F.col("events") >= least).drop("cluster")


def parsed_ratio(c: Column) -> Column:
    """``2:01`` as 2.0; NULL for anything that is not two numbers, or a zero on the right."""
    parts = F.split(c, ":")
    valid = F.size(parts) == 2
    return F.when(valid, divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")))


def ratio_summary(df: DataFrame, ratio: str, keys: Sequence[str] = (), at_least: float = 2.0) -> DataFrame:
    """Count, mean, smallest and largest ratio, distinct ratios, and how many reach a level."""
    rows = df.select(*_by(keys), parsed_ratio(col(ratio)).alias("r"))
    return rows.groupBy(*_by(keys)).agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.min("r").alias("smallest"), F.max("r").alias("largest"),
        F.count_distinct("r").alias("distinct"), F.count_if(F.col("r") >= at_least).alias("at_least"),
    )


def around_events(series: DataFrame, events: DataFrame, keys: Sequence[str], days: int, value: str = "close") -> DataFrame:
    """Mean of a daily series in the ``days`` days before and after each event day, and the difference.

    A range join written as an equi-join: each event day is spread over its 2 * days neighbours.
    """
    offsets = F.explode(F.array(*[F.lit(i) for i in range(-days, days + 1) if i]))
    wide = events.select(*_by(keys), F.col("day").alias("event_day")).distinct().withColumn("offset", offsets)
    wide = wide.withColumn("day", F.date_add("event_day", F.col("offset")))
    found = join_groups(wide, series.select(*_by(keys), "day", col(value).alias("v")), [*keys, "day"], "left")
    before, after = F.when(F.col("offset") < 0, F.col("v")), F.when(F.col("offset") > 0, F.col("v"))
    out = found.groupBy(*_by(keys), "event_day").agg(
        F.count(before).alias("n_before"), F.avg(before).alias("mean_before"),
        F.count(after).alias("n_after"), F.avg(after).alias("mean_after"),
    )
    return out.withColumn("change", F.col("mean_after") - F.col("mean_before"))


def last_before(series: DataFrame, events: DataFrame, keys: Sequence[str], value: str = "close") -> DataFrame:
    """The latest daily value strictly before each event day (as-of lookup without a range join)."""
    known = series.select(*_by(keys), "day", F.struct("day", col(value).alias("v")).alias("seen"), F.lit(1).alias("kind"))
    asked = events.select(*_by(keys), "day").distinct()
    asked = asked.withColumn("seen", F.lit(None).cast(known.schema["seen"].dataType)).withColumn("kind", F.lit(0))
    over = Window.partitionBy(*_by(keys)).orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = known.unionByName(asked).withColumn("last", F.last("seen", ignorenulls=True).over(over))
    return merged.where("kind = 0").select(
        *_by(keys), F.col("day").alias("event_day"), F.col("last.day").alias("previous_day"), F.col("last.v").alias("previous_value")
    )
