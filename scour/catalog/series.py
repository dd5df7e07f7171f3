"""Analytical questions on daily series and dated events."""

from datetime import timedelta

from pyspark.sql import functions as F

from scour.catalog.base import Tables, q6, query, rounded
from scour.questions import happenings as hp, rows as rq, series as qs, times as tq

K = ["o_orderstatus"]


def bars(t: Tables):
    return qs.daily_bars(t.orders, "o_orderdate", "o_totalprice", ["o_orderdate", "o_orderkey"], K)


BARS = """b AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS open, MAX(o_totalprice) AS high,
 MIN(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, COUNT(*) AS volume FROM orders GROUP BY 1, 2)"""
MOVED = f"""{BARS}, m AS (SELECT *, close - lag(close) OVER w AS change, lag(close) OVER w AS previous FROM b
 WINDOW w AS (PARTITION BY o_orderstatus ORDER BY day))"""


@query("daily_bars", f"WITH {BARS} SELECT * FROM b")
def daily_bars(t: Tables):
    return bars(t)


@query(
    "linear_trend",
    f"""WITH {BARS} SELECT o_orderstatus, {q6("regr_slope(close, date_diff('day', DATE '1970-01-01', day))")} AS slope,
 {q6("regr_r2(close, date_diff('day', DATE '1970-01-01', day))")} AS r2 FROM b GROUP BY 1""",
)
def linear_trend(t: Tables):
    return rounded(qs.linear_trend(bars(t), K), "slope", "r2")


@query("monthly_mean", f"WITH {BARS} SELECT o_orderstatus, CAST(date_trunc('month', day) AS DATE) AS month, {q6('AVG(close)')} AS mean FROM b GROUP BY 1, 2")
def monthly_mean(t: Tables):
    return rounded(qs.monthly_mean(bars(t), K), "mean")


def _extremum_sql(sign: str, by: str, show: str) -> str:
    return f"""WITH {BARS} SELECT o_orderstatus, day, {by}, {show} FROM
 (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sign}{by}, day) AS r FROM b) WHERE r = 1"""


@query("busiest_day", _extremum_sql("-", "volume", "close"))
def busiest_day(t: Tables):
    return qs.at_extremum(bars(t), K, "volume", ["close"])


@query("lowest_close", _extremum_sql("", "close", "open, high, low, volume"))
def lowest_close(t: Tables):
    return qs.at_extremum(bars(t), K, "close", ["open", "high", "low", "volume"], largest=False)


@query("correlation", f"WITH {BARS} SELECT o_orderstatus, {q6('corr(open, close)')} AS corr FROM b GROUP BY 1")
def correlation(t: Tables):
    return rounded(qs.correlation(bars(t), K, "open", "close"), "corr")


@query("lagged_correlation", f"WITH {MOVED} SELECT o_orderstatus, {q6('corr(open, previous)')} AS corr FROM m GROUP BY 1")
def lagged_correlation(t: Tables):
    return rounded(qs.correlation(bars(t), K, "open", "close", lag=1), "corr")


def _season_sql(part: str, expr: str) -> str:
    return f"""WITH {MOVED} SELECT o_orderstatus, CAST({expr} AS INTEGER) AS {part}, {q6('AVG(close)')} AS mean, {q6('AVG(change)')} AS mean_change,
 {q6('AVG(CASE WHEN change IS NOT NULL THEN CAST(change > 0 AS INTEGER) END)')} AS rising_share FROM m GROUP BY 1, 2"""


def _season(t: Tables, part: str):
    return rounded(qs.seasonality(bars(t), K, part), "mean", "mean_change", "rising_share")


@query("seasonality_month", _season_sql("month", "month(day)"))
def seasonality_month(t: Tables):
    return _season(t, "month")


@query("seasonality_quarter", _season_sql("quarter", "quarter(day)"))
def seasonality_quarter(t: Tables):
    return _season(t, "quarter")


@query("seasonality_weekday", _season_sql("weekday", "dayofweek(day)"))
def seasonality_weekday(t: Tables):
    return _season(t, "weekday")


@query(
    "share_of_losses",
    f"""WITH {BARS} SELECT o_orderstatus, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE close < open) AS hits,
 {q6('100.0 * COUNT(*) FILTER (WHERE close < open) / COUNT(*)')} AS share_pct FROM b GROUP BY 1""",
)
def share_of_losses(t: Tables):
    out = qs.share_of_rows(bars(t), K, "close < open").withColumnRenamed("rows", "n_rows")
    return rounded(out, "share_pct")


@query(
    "spread",
    f"""WITH {BARS} SELECT o_orderstatus, {q6('AVG(high - low)')} AS mean, {q6('stddev_samp(high - low)')} AS std, {q6('stddev_samp(high)')} AS std_high,
 {q6('stddev_samp(low)')} AS std_low, {q6('quantile_cont(high - low, 0.5)')} AS median FROM b GROUP BY 1""",
)
def spread(t: Tables):
    return rounded(qs.spread(bars(t), K, "high", "low"), "mean", "std", "std_high", "std_low", "median")


@query(
    "spikes",
    f"""WITH {MOVED}, u AS (SELECT o_orderstatus, AVG(change) AS usual, stddev_samp(change) AS deviation FROM m GROUP BY 1)
 SELECT o_orderstatus, day, close, {q6('change')} AS change FROM m JOIN u USING (o_orderstatus) WHERE abs(change - usual) > 2 * deviation""",
)
def spikes(t: Tables):
    return rounded(qs.spikes(bars(t), K, 2.0), "change")


@query(
    "before_after",
    f"""WITH {BARS} SELECT o_orderstatus, CASE WHEN day < DATE '1998-07-01' THEN 'before' ELSE 'after' END AS side, COUNT(*) AS days,
 {q6('AVG(close)')} AS mean, {q6('stddev_samp(close)')} AS std FROM b GROUP BY 1, 2""",
)
def before_after(t: Tables):
    return rounded(qs.before_after(bars(t), K, "1998-07-01"), "mean", "std")


def _ma_sql(n: int) -> str:
    frame = f"(PARTITION BY o_orderstatus ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"{q6(f'CASE WHEN COUNT(*) OVER {frame} = {n} THEN AVG(close) OVER {frame} END')} AS ma_{n}"


@query("moving_average", f"WITH {BARS} SELECT o_orderstatus, day, close, {_ma_sql(5)}, {_ma_sql(10)}, {_ma_sql(30)} FROM b")
def moving_average(t: Tables):
    return rounded(qs.moving_average(bars(t), K, [5, 10, 30]), "ma_5", "ma_10", "ma_30")


@query("percent_change", f"WITH {MOVED} SELECT o_orderstatus, day, close, {q6('change * 100 / nullif(previous, 0)')} AS change_pct FROM m")
def percent_change(t: Tables):
    return rounded(qs.percent_change(bars(t), K), "change_pct")


@query(
    "largest_drops",
    f"WITH {MOVED} SELECT o_orderstatus, day, close, {q6('change')} AS change FROM m WHERE change < 0 ORDER BY m.change, day, o_orderstatus LIMIT 10",
)
def largest_drops(t: Tables):
    return rounded(qs.largest_drops(bars(t), K, 10), "change")


@query(
    "monthly_gain",
    f"""WITH {BARS} SELECT o_orderstatus, CAST(date_trunc('month', day) AS DATE) AS month, arg_min(close, day) AS first, arg_max(close, day) AS last,
 {q6('arg_max(close, day) - arg_min(close, day)')} AS gain, {q6('stddev_samp(close)')} AS volatility FROM b GROUP BY 1, 2""",
)
def monthly_gain(t: Tables):
    return rounded(qs.monthly_gain(bars(t), K), "gain", "volatility")


@query(
    "longest_streak",
    f"""WITH {MOVED}, f AS (SELECT o_orderstatus, day, sign(change) AS s FROM m WHERE change IS NOT NULL),
 g AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER (PARTITION BY o_orderstatus ORDER BY day) THEN 0 ELSE 1 END AS st FROM f),
 h AS (SELECT *, SUM(st) OVER (PARTITION BY o_orderstatus ORDER BY day) AS run FROM g),
 r AS (SELECT o_orderstatus, s, COUNT(*) AS length, MIN(day) AS first_day, MAX(day) AS last_day FROM h GROUP BY o_orderstatus, s, run)
 SELECT o_orderstatus, CASE WHEN s > 0 THEN 'rising' WHEN s < 0 THEN 'falling' ELSE 'equal' END AS direction, length, first_day, last_day FROM
 (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, s ORDER BY length DESC, first_day) AS n FROM r) WHERE n = 1""",
)
def longest_streak(t: Tables):
    return qs.longest_streak(bars(t), K)


@query(
    "total_change",
    f"""WITH {BARS} SELECT o_orderstatus, arg_min(close, day) AS first, arg_max(close, day) AS last,
 {q6('(arg_max(close, day) - arg_min(close, day)) * 100 / arg_min(close, day)')} AS change_pct FROM b GROUP BY 1""",
)
def total_change(t: Tables):
    return rounded(qs.total_change(bars(t), K), "change_pct")


@query(
    "running_extremes",
    f"""WITH {BARS}, e AS (SELECT o_orderstatus, close, MAX(close) OVER w AS hi, MIN(close) OVER w AS lo FROM b
 WINDOW w AS (PARTITION BY o_orderstatus ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT o_orderstatus, COUNT(*) FILTER (WHERE close > hi) AS new_highs, COUNT(*) FILTER (WHERE close < lo) AS new_lows FROM e GROUP BY 1""",
)
def running_extremes(t: Tables):
    return qs.running_extremes(bars(t), K)


U = ["user_id"]


def buys(t: Tables):
    return hp.event_days(t.events.where("event_type = 'purchase'"), "ts", U)


BUYS = "d AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS events FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"


@query(
    "event_extent",
    """SELECT o_orderpriority, COUNT(*) AS events, CAST(MIN(o_orderdate) AS DATE) AS first_day, CAST(MAX(o_orderdate) AS DATE) AS last_day,
 CAST(year(MAX(o_orderdate)) - year(MIN(o_orderdate)) AS INTEGER) AS years FROM orders GROUP BY 1""",
)
def event_extent(t: Tables):
    return hp.extent(hp.event_days(t.orders, "o_orderdate", ["o_orderpriority"]), ["o_orderpriority"])


def _period_sql(period: str, expr: str) -> str:
    return f"SELECT o_orderpriority, CAST({expr} AS INTEGER) AS {period}, COUNT(*) AS events FROM orders GROUP BY 1, 2"


@query("events_per_year", _period_sql("year", "year(o_orderdate)"))
def events_per_year(t: Tables):
    return hp.per_period(hp.event_days(t.orders, "o_orderdate", ["o_orderpriority"]), ["o_orderpriority"], "year")


@query("events_per_decade", _period_sql("decade", "floor(year(o_orderdate) / 10) * 10"))
def events_per_decade(t: Tables):
    return hp.per_period(hp.event_days(t.orders, "o_orderdate", ["o_orderpriority"]), ["o_orderpriority"], "decade")


@query("busiest_years", f"{_period_sql('year', 'year(o_orderdate)')} ORDER BY 3 DESC, 2, 1 LIMIT 3")
def busiest_years(t: Tables):
    return hp.busiest(hp.event_days(t.orders, "o_orderdate", ["o_orderpriority"]), ["o_orderpriority"], "year")


@query(
    "value_distribution",
    """WITH c AS (SELECT p_type AS value, COUNT(*) AS n FROM part GROUP BY 1)
 SELECT value, n, value = (SELECT value FROM c ORDER BY n DESC, value LIMIT 1) AS is_mode, (SELECT COUNT(*) FROM c) AS "distinct" FROM c""",
)
def value_distribution(t: Tables):
    return hp.distribution(t.part, "p_type")


@query(
    "longest_gap",
    f"""WITH {BUYS}, g AS (SELECT user_id, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS from_day, day AS to_day FROM d),
 r AS (SELECT *, CAST(date_diff('day', from_day, to_day) AS INTEGER) AS gap_days FROM g WHERE from_day IS NOT NULL)
 SELECT user_id, from_day, to_day, gap_days FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap_days DESC, from_day) AS n FROM r) WHERE n = 1""",
)
def longest_gap(t: Tables):
    return hp.longest_gap(buys(t), U)


@query(
    "event_clusters",
    f"""WITH {BUYS}, g AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) > 2 THEN 1 ELSE 0 END AS st FROM d),
 h AS (SELECT *, SUM(st) OVER (PARTITION BY user_id ORDER BY day) AS c FROM g)
 SELECT user_id, MIN(day) AS first_day, MAX(day) AS last_day, CAST(SUM(events) AS BIGINT) AS events FROM h GROUP BY user_id, c HAVING SUM(events) >= 3""",
)
def event_clusters(t: Tables):
    return hp.clusters(buys(t), U, gap=2, least=3)


RATIO = "CASE WHEN p_size % 9 = 0 THEN 'none' ELSE concat(p_size % 7 + 1, ':0', p_size % 3) END"


@query(
    "ratio_summary",
    f"""WITH r AS (SELECT p_type, CASE WHEN contains(x, ':') THEN CAST(split_part(x, ':', 1) AS DOUBLE) / nullif(CAST(split_part(x, ':', 2) AS DOUBLE), 0) END AS r
 FROM (SELECT p_type, {RATIO} AS x FROM part)) SELECT p_type, COUNT(r) AS n, {q6('AVG(r)')} AS mean, MIN(r) AS smallest, MAX(r) AS largest,
 COUNT(DISTINCT r) AS "distinct", COUNT(*) FILTER (WHERE r >= 2) AS at_least FROM r GROUP BY 1""",
)
def ratio_summary(t: Tables):
    return rounded(hp.ratio_summary(t.part.withColumn("ratio", F.expr(RATIO)), "ratio", ["p_type"]), "mean")


VIEWS = """v AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS close FROM events WHERE event_type = 'view' GROUP BY 1, 2),
 s AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS event_day FROM events WHERE event_type = 'signup')"""


def views(t: Tables):
    return qs.daily_bars(t.events.where("event_type = 'view'"), "ts", "value", ["ts", "event_id"], U)


def signups(t: Tables):
    return hp.event_days(t.events.where("event_type = 'signup'"), "ts", U)


@query(
    "around_events",
    f"""WITH {VIEWS}, j AS (SELECT s.user_id, event_day, close, day < event_day AS is_before FROM s
 LEFT JOIN v ON v.user_id = s.user_id AND day BETWEEN event_day - 3 AND event_day + 3 AND day <> event_day)
 SELECT user_id, event_day, COUNT(close) FILTER (WHERE is_before) AS n_before, {q6('AVG(close) FILTER (WHERE is_before)')} AS mean_before,
 COUNT(close) FILTER (WHERE NOT is_before) AS n_after, {q6('AVG(close) FILTER (WHERE NOT is_before)')} AS mean_after,
 {q6('AVG(close) FILTER (WHERE NOT is_before) - AVG(close) FILTER (WHERE is_before)')} AS change FROM j GROUP BY 1, 2""",
)
def around_events(t: Tables):
    return rounded(hp.around_events(views(t), signups(t), U, 3), "mean_before", "mean_after", "change")


@query(
    "last_before",
    f"""WITH {VIEWS} SELECT s.user_id, event_day, MAX(day) AS previous_day, arg_max(close, day) AS previous_value
 FROM s LEFT JOIN v ON v.user_id = s.user_id AND day < event_day GROUP BY 1, 2""",
)
def last_before(t: Tables):
    return hp.last_before(views(t), signups(t), U)


SAMES = """SELECT '{n}' AS dataset, CAST({ts} AS DATE) AS day, arg_max({v}, {k}) AS v FROM {t} GROUP BY 2"""


@query(
    "compare_datasets",
    f"""WITH r AS ({SAMES.format(n='orders', ts='o_orderdate', v='o_totalprice', k='o_orderkey', t='orders')}
 UNION ALL {SAMES.format(n='events', ts='ts', v='value', k='(ts, event_id)', t='events')})
 SELECT dataset, COUNT(*) AS days, MIN(day) AS first_day, arg_min(v, day) AS first_value, {q6('AVG(v)')} AS mean, {q6('stddev_samp(v)')} AS std FROM r GROUP BY 1""",
)
def compare_datasets(t: Tables):
    tables = {
        "orders": qs.daily_bars(t.orders, "o_orderdate", "o_totalprice", ["o_orderkey"]),
        "events": qs.daily_bars(t.events, "ts", "value", ["ts", "event_id"]),
    }
    return rounded(qs.compare_datasets(tables), "mean", "std")


ROW = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINES = f"ORDER BY {', '.join(ROW)}"


@query(
    "moving_average_rows",
    f"""SELECT {', '.join(ROW)}, CASE WHEN COUNT(*) OVER a = 5 THEN {q6("AVG(l_quantity) OVER a")} END AS ma_5,
 CASE WHEN COUNT(*) OVER b = 30 THEN {q6("AVG(l_quantity) OVER b")} END AS ma_30
 FROM lineitem WINDOW a AS ({LINES} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS ({LINES} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def moving_average_rows(t: Tables):
    """One series of all rows, without a key."""
    lines = t.lineitem.select(*ROW, "l_quantity")
    out = rq.moving_average(lines, [], ROW, "l_quantity", [5, 30])
    return rounded(out, "ma_5", "ma_30").drop("l_quantity")


@query(
    "percent_change_rows",
    f"""SELECT {', '.join(ROW)}, l_returnflag, {q6("(l_quantity - lag(l_quantity) OVER w) * 100 / nullif(lag(l_quantity) OVER w, 0)")} AS change_pct
 FROM lineitem WINDOW w AS (PARTITION BY l_returnflag {LINES})""",
)
def percent_change_rows(t: Tables):
    """Few keys, each with a large share of the rows."""
    lines = t.lineitem.select(*ROW, "l_returnflag", "l_quantity")
    out = rq.changes(lines, ["l_returnflag"], ROW, "l_quantity")
    return rounded(out, "change_pct").drop("l_quantity", "previous", "change")


@query(
    "longest_streak_rows",
    f"""WITH s AS (SELECT *, row_number() OVER ({LINES}) AS r, sign(l_quantity - lag(l_quantity) OVER ({LINES})) AS g FROM lineitem),
 i AS (SELECT *, r - row_number() OVER (PARTITION BY g ORDER BY r) AS run FROM s WHERE g IS NOT NULL),
 n AS (SELECT g, run, COUNT(*) AS length, MIN(r) AS first, MAX(r) AS last FROM i GROUP BY 1, 2),
 b AS (SELECT g, arg_min({{'n': length, 'f': first, 'l': last}}, (-length, first)) AS x FROM n GROUP BY g)
 SELECT CASE WHEN b.g > 0 THEN 'rising' WHEN b.g < 0 THEN 'falling' ELSE 'equal' END AS direction, x.n AS length,
  {', '.join(f"{t}.{c} AS {side}_{c}" for t, side in (("f", "first"), ("e", "last")) for c in ROW)}
 FROM b JOIN s f ON f.r = x.f JOIN s e ON e.r = x.l""",
)
def longest_streak_rows(t: Tables):
    """Runs over all rows, without a key."""
    return rq.longest_streaks(t.lineitem, [], ROW, "l_quantity")


@query(
    "last_known_rows",
    """WITH v AS (SELECT ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1),
 e AS (SELECT event_id, ts FROM events WHERE event_type = 'signup')
 SELECT e.event_id, e.ts, CASE WHEN e.ts - v.ts <= INTERVAL 20 MINUTE THEN v.ts END AS previous_ts,
 CASE WHEN e.ts - v.ts <= INTERVAL 20 MINUTE THEN v.value END AS previous_value FROM e ASOF LEFT JOIN v ON e.ts >= v.ts""",
)
def last_known_rows(t: Tables):
    """The last view of anybody at most 20 minutes before each sign-up, without a key."""
    kind = F.col("event_type")
    return tq.last_known(t.events.where(kind == "signup").select("event_id", "ts"), t.events.where(kind == "view"), [], "ts", ["value"], tolerance=timedelta(minutes=20))


@query(
    "last_known_by_key",
    """WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
 e AS (SELECT user_id, event_id, ts FROM events WHERE event_type <> 'view')
 SELECT e.event_id, e.user_id, e.ts, v.ts AS previous_ts, v.value AS previous_value FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts > v.ts""",
)
def last_known_by_key(t: Tables):
    """The last earlier view of the same user before each other event."""
    kind = F.col("event_type")
    return tq.last_known(t.events.where(kind != "view").select("event_id", "user_id", "ts"), t.events.where(kind == "view"), U, "ts", ["value"], strict=True)


def _around_sql(keys: list[str], window: str) -> str:
    named = "".join(f"{k}, " for k in keys)
    same = "".join(f" AND v.{k} = s.{k}" for k in keys)
    return f"""WITH v AS (SELECT {named}ts, value FROM events WHERE event_type = 'view'), s AS (SELECT DISTINCT {named}ts FROM events WHERE event_type = 'signup'),
 j AS (SELECT s.*, v.value, v.ts < s.ts AS is_before FROM s LEFT JOIN v ON v.ts BETWEEN s.ts - {window} AND s.ts + {window} AND v.ts <> s.ts{same})
 SELECT {named}ts, COUNT(value) FILTER (WHERE is_before) AS n_before, {q6('AVG(value) FILTER (WHERE is_before)')} AS mean_before,
 COUNT(value) FILTER (WHERE NOT is_before) AS n_after, {q6('AVG(value) FILTER (WHERE NOT is_before)')} AS mean_after,
 {q6('AVG(value) FILTER (WHERE NOT is_before) - AVG(value) FILTER (WHERE is_before)')} AS change FROM j GROUP BY ALL"""


@query("around_times_rows", _around_sql([], "INTERVAL 2700 SECOND"))
def around_times_rows(t: Tables):
    """Views of anybody in the 45 minutes before and after each sign-up, at the grain of the clock, without a key."""
    kind = F.col("event_type")
    out = tq.around_times(t.events.where(kind == "view"), t.events.where(kind == "signup"), [], "ts", "value", timedelta(minutes=45))
    return rounded(out, "mean_before", "mean_after", "change")


@query("around_times_by_key", _around_sql(["user_id"], "INTERVAL 36 HOUR"))
def around_times_by_key(t: Tables):
    kind = F.col("event_type")
    out = tq.around_times(t.events.where(kind == "view"), t.events.where(kind == "signup"), U, "ts", "value", timedelta(hours=36))
    return rounded(out, "mean_before", "mean_after", "change")
