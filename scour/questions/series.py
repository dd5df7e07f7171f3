"""Questions about a price-like series: one row per key and day.

``daily_bars`` reduces any table of timed values to daily rows first, with partial
aggregation, so a key that holds a third of the table becomes a few thousand rows at
most; the ordered windows below therefore never see more than the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from scour.functions.columns import col, divide, join_groups
from scour.functions.stats import grouped_quantile


def daily_bars(df: DataFrame, ts: str, value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, day, open, high, low, close, volume: first, largest, smallest and last value of the day, and its row count."""
    v, at = col(value), F.struct(*[col(o) for o in order])
    return (
        df.where(v.isNotNull() & col(ts).isNotNull())
        .groupBy(*[col(k) for k in keys], F.to_date(col(ts)).alias("day"))
        .agg(
            F.min_by(v, at).alias("open"),
            F.max(v).alias("high"),
            F.min(v).alias("low"),
            F.max_by(v, at).alias("close"),
            F.count(v).alias("volume"),
        )
    )


def _by(keys: Sequence[str]) -> list[Column]:
    return [col(k) for k in keys]


def _over(keys: Sequence[str]):
    return Window.partitionBy(*_by(keys)).orderBy("day")


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def with_change(bars: DataFrame, keys: Sequence[str], value: str = "close") -> DataFrame:
    """Adds the previous day's value, the difference and the relative change in percent."""
    previous = F.lag(col(value)).over(_over(keys))
    out = bars.withColumn("previous", previous).withColumn("change", col(value) - F.col("previous"))
    return out.withColumn("change_pct", divide(F.col("change") * 100, F.col("previous")))


def linear_trend(bars: DataFrame, keys: Sequence[str], value: str = "close") -> DataFrame:
    """Least-squares slope per day, and the share of variance it explains."""
    x, y = day_number(F.col("day")), col(value)
    return bars.groupBy(*_by(keys)).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))


def monthly_mean(bars: DataFrame, keys: Sequence[str], value: str = "close") -> DataFrame:
    month = F.trunc("day", "month").alias("month")
    return bars.groupBy(*_by(keys), month).agg(F.avg(col(value)).alias("mean"))


def at_extremum(bars: DataFrame, keys: Sequence[str], by: str, show: Sequence[str], largest: bool = True) -> DataFrame:
    """The day with the largest (smallest) value, ties to the earliest day, with other columns of that day."""
    rank = F.struct((-col(by) if largest else col(by)).alias("r"), F.col("day").alias("d"))
    row = F.min_by(F.struct("day", col(by), *[col(c) for c in show]), rank).alias("row")
    return bars.groupBy(*_by(keys)).agg(row).select(*_by(keys), "row.*")


def correlation(bars: DataFrame, keys: Sequence[str], a: str, b: str, lag: int = 0) -> DataFrame:
    """Pearson correlation of ``a`` with ``b`` of ``lag`` days (rows) earlier."""
    other = F.lag(col(b), lag).over(_over(keys)) if lag else col(b)
    pairs = bars.select(*_by(keys), col(a).cast("double").alias("a"), other.cast("double").alias("b"))
    return pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy(*_by(keys)).agg(F.corr("a", "b").alias("corr"))


def seasonality(bars: DataFrame, keys: Sequence[str], part: str, value: str = "close") -> DataFrame:
    """Mean value, mean daily change and share of rising days per month of the year, quarter or weekday (Sunday 0)."""
    parts = {"month": F.month("day"), "quarter": F.quarter("day"), "weekday": F.dayofweek("day") - 1}
    moved = with_change(bars, keys, value)
    return moved.groupBy(*_by(keys), parts[part].cast("int").alias(part)).agg(
        F.avg(col(value)).alias("mean"),
        F.avg("change").alias("mean_change"),
        F.avg(F.when(F.col("change").isNotNull(), (F.col("change") > 0).cast("int"))).alias("rising_share"),
    )


def share_of_rows(df: DataFrame, keys: Sequence[str], condition: str | Column) -> DataFrame:
    """Rows, rows meeting a condition, and their share in percent."""
    hit = F.expr(condition) if isinstance(condition, str) else condition
    n, hits = F.count(F.lit(1)), F.count_if(hit)
    return df.groupBy(*_by(keys)).agg(n.alias("rows"), hits.alias("hits"), (hits * 100.0 / n).alias("share_pct"))


def spread(bars: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean, deviation and median of ``a - b``, and the deviations of both columns."""
    diff = bars.withColumn("diff", col(a) - col(b))
    stats = diff.groupBy(*_by(keys)).agg(
        F.avg("diff").alias("mean"),
        F.stddev_samp("diff").alias("std"),
        F.stddev_samp(col(a)).alias(f"std_{a}"),
        F.stddev_samp(col(b)).alias(f"std_{b}"),
    )
    return join_groups(stats, grouped_quantile(diff, list(keys), "diff", 0.5, "median"), keys)


def spikes(bars: DataFrame, keys: Sequence[str], k: float = 3.0, value: str = "close") -> DataFrame:
    """Days whose change lies more than k sample deviations from the mean change."""
    moved = with_change(bars, keys, value)
    usual = moved.groupBy(*_by(keys)).agg(F.avg("change").alias("usual"), F.stddev_samp("change").alias("deviation"))
    far = join_groups(moved, usual, keys).where(F.abs(F.col("change") - F.col("usual")) > k * F.col("deviation"))
    return far.select(*_by(keys), "day", col(value), "change")


def before_after(bars: DataFrame, keys: Sequence[str], day: str, value: str = "close") -> DataFrame:
    """Rows, mean and deviation before and from a date on."""
    side = F.when(F.col("day") < F.lit(day).cast("date"), "before").otherwise("after").alias("side")
    return bars.groupBy(*_by(keys), side).agg(
        F.count(F.lit(1)).alias("days"), F.avg(col(value)).alias("mean"), F.stddev_samp(col(value)).alias("std")
    )


def moving_average(bars: DataFrame, keys: Sequence[str], sizes: Sequence[int], value: str = "close") -> DataFrame:
    """``ma_n`` over the last n daily rows; NULL until n rows are there."""
    out = [*_by(keys), F.col("day"), col(value)]
    for n in sizes:
        frame = _over(keys).rowsBetween(1 - n, 0)
        full = F.count(F.lit(1)).over(frame) == n
        out.append(F.when(full, F.avg(col(value)).over(frame)).alias(f"ma_{n}"))
    return bars.select(*out)


def percent_change(bars: DataFrame, keys: Sequence[str], value: str = "close") -> DataFrame:
    return with_change(bars, keys, value).select(*_by(keys), "day", col(value), "change_pct")


def largest_drops(bars: DataFrame, keys: Sequence[str], k: int = 10, value: str = "close") -> DataFrame:
    """The k largest falls from one day to the next over all keys."""
    moved = with_change(bars, keys, value).where("change < 0")
    return moved.orderBy("change", "day", *_by(keys)).select(*_by(keys), "day", col(value), "change").limit(k)


def monthly_gain(bars: DataFrame, keys: Sequence[str], value: str = "close") -> DataFrame:
    """First and last value, gain, and deviation of each month."""
    first, last = F.min_by(col(value), "day"), F.max_by(col(value), "day")
    return bars.groupBy(*_by(keys), F.trunc("day", "month").alias("month")).agg(
        first.alias("first"), last.alias("last"), (last - first).alias("gain"), F.stddev_samp(col(value)).alias("volatility")
    )


def longest_streak(bars: DataFrame, keys: Sequence[str], value: str = "close") -> DataFrame:
    """Per direction (rising, falling, equal) the longest run of consecutive daily changes; the earliest run on a tie."""
    sign = F.signum("change").cast("int")
    moved = with_change(bars, keys, value).where("change IS NOT NULL").select(*_by(keys), "day", sign.alias("sign"))
    over = _over(keys)
    starts = F.when(F.col("sign").eqNullSafe(F.lag("sign").over(over)), 0).otherwise(1)
    runs = moved.withColumn("start", starts).withColumn("run", F.sum("start").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*_by(keys), "sign", "run").agg(
        F.count(F.lit(1)).alias("length"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    rank = F.struct((-F.col("length")).alias("l"), F.col("first_day").alias("d"))
    best = runs.groupBy(*_by(keys), "sign").agg(F.min_by(F.struct("length", "first_day", "last_day"), rank).alias("row"))
    name = F.when(F.col("sign") > 0, "rising").when(F.col("sign") < 0, "falling").otherwise("equal").alias("direction")
    return best.select(*_by(keys), name, "row.*")


def total_change(bars: DataFrame, keys: Sequence[str], value: str = "close") -> DataFrame:
    """First and last value of the whole range and the change in percent."""
    first, last = F.min_by(col(value), "day"), F.max_by(col(value), "day")
    out = bars.groupBy(*_by(keys)).agg(first.alias("first"), last.alias("last"))
    return out.withColumn("change_pct", divide((F.col("last") - F.col("first")) * 100, F.col("first")))


def running_extremes(bars: DataFrame, keys: Sequence[str], value: str = "close") -> DataFrame:
    """How many days set a new high and how many a new low against all earlier days."""
    earlier = _over(keys).rowsBetween(Window.unboundedPreceding, -1)
    c = col(value)
    marked = bars.select(*_by(keys), (c > F.max(c).over(earlier)).alias("high"), (c < F.min(c).over(earlier)).alias("low"))
    return marked.groupBy(*_by(keys)).agg(F.count_if("high").alias("new_highs"), F.count_if("low").alias("new_lows"))


def compare_datasets(tables: dict[str, DataFrame], value: str = "close") -> DataFrame:
    """The same figures for several daily tables: days, earliest day and its value, mean and deviation."""
    tagged = [t.select(F.lit(name).alias("dataset"), "day", col(value).alias("v")) for name, t in tables.items()]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("days"),
        F.min("day").alias("first_day"),
        F.min_by("v", "day").alias("first_value"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
    )
