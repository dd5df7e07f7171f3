"""Cases that used to stop a run or lose rows: errors in a row, clashing names, NULL keys, series without a key, hot groups."""

from pyspark.sql import functions as F

from scour.catalog.base import DIRTY_SQL, GAPS_SQL, HEAVY_SQL, Tables, q6, query, rounded
from scour.catalog.series import K
from scour.functions.stats import exact_quantiles, grouped_quantile
from scour.operators import encode, impute, outliers
from scour.plans.runner import run_plan
from scour.questions import happenings as hp, series as qs
from scour.session import scratch_path
from scour.sources import tables as io


def _planned(df, stage: str, op: dict, target: str = "global", **more):
    """The table after a run of one operation, with the operation's status."""
    run = run_plan(df, {f"{stage}_operations": {target: [op]}, "pipeline_plan": [stage]}, max_retries=1, spelling=False, **more)
    return run.df.withColumn("status", F.lit(run.log[0].status))


@query("formula_failure_logged", "SELECT l_orderkey, l_linenumber, l_quantity, 'failed' AS status FROM lineitem")
def formula_failure_logged(t: Tables):
    """The formula divides by zero on the first line of every order: it is logged as failed, the table goes on unchanged."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    op = {"operation": "create_new_feature", "formula": "CAST(l_quantity AS INT) div (l_linenumber - 1)", "new_feature_name": "ratio"}
    return _planned(lines, "modification", op)


@query(
    "merge_suffixes",
    """SELECT nationkey, c_custkey, c.acctbal AS acctbal_x, s_suppkey, s.acctbal AS acctbal_y, 'completed' AS status
 FROM (SELECT c_nationkey AS nationkey, c_custkey, c_acctbal AS acctbal FROM customer) c
 JOIN (SELECT s_nationkey AS nationkey, s_suppkey, s_acctbal AS acctbal FROM supplier) s USING (nationkey)""",
)
def merge_suffixes(t: Tables):
    left = t.customer.selectExpr("c_nationkey AS nationkey", "c_custkey", "c_acctbal AS acctbal")
    right = t.supplier.selectExpr("s_nationkey AS nationkey", "s_suppkey", "s_acctbal AS acctbal")
    return _planned(left, "transformation", {"operation": "merge", "right_df_name": "suppliers", "on": "nationkey"}, tables={"suppliers": right})


@query(
    "one_hot_case_clash",
    f"""{DIRTY_SQL}, v AS (SELECT c_mktsegment AS v, COUNT(*) AS n FROM g WHERE c_mktsegment IS NOT NULL GROUP BY 1),
 r AS (SELECT v, n, row_number() OVER (PARTITION BY lower(v) ORDER BY v) AS k FROM v)
 SELECT 'c_mktsegment_' || v || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS flag, n AS rows, 'completed' AS status FROM r""",
)
def one_hot_case_clash(t: Tables):
    """Spellings that differ only in case: how many rows each flag marks."""
    found = _planned(t.dirty, "transformation", {"operation": "encode_categorical", "method": "one_hot"}, "c_mktsegment")
    flags = [c for c in found.columns if c.startswith("c_mktsegment_")]
    counts = found.groupBy("status").agg(*[F.count_if(F.col(f"`{c}`")).alias(c) for c in flags])
    return counts.unpivot(["status"], [F.col(f"`{c}`") for c in flags], "flag", "rows").select("flag", "rows", "status")


@query("rename_collision", "SELECT *, 'failed' AS status FROM supplier")
def rename_collision(t: Tables):
    """The new name is there already, in other case."""
    return _planned(t.supplier, "modification", {"operation": "rename_column", "old_name": "s_name", "new_name": "S_NationKey"})


ONE = """b AS (SELECT CAST(o_orderdate AS DATE) AS day, MAX(o_totalprice) AS high, MIN(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1)"""


def _one(t: Tables):
    return qs.daily_bars(t.orders, "o_orderdate", "o_totalprice", ["o_orderdate", "o_orderkey"])


@query(
    "spread_one_series",
    f"""WITH {ONE} SELECT {q6('AVG(high - low)')} AS mean, {q6('stddev_samp(high - low)')} AS std, {q6('stddev_samp(high)')} AS std_high,
 {q6('stddev_samp(low)')} AS std_low, {q6('quantile_cont(high - low, 0.5)')} AS median FROM b""",
)
def spread_one_series(t: Tables):
    return rounded(qs.spread(_one(t), [], "high", "low"), "mean", "std", "std_high", "std_low", "median")


@query(
    "spikes_one_series",
    f"""WITH {ONE}, m AS (SELECT *, close - lag(close) OVER (ORDER BY day) AS change FROM b), u AS (SELECT AVG(change) AS usual, stddev_samp(change) AS deviation FROM m)
 SELECT day, close, {q6('change')} AS change FROM m, u WHERE abs(change - usual) > 2 * deviation""",
)
def spikes_one_series(t: Tables):
    return rounded(qs.spikes(_one(t), [], 2.0), "change")


HOLED = "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END"
NULL_BARS = f"""b AS (SELECT {HOLED} AS o_orderstatus, CAST(o_orderdate AS DATE) AS day, MAX(o_totalprice) AS high, MIN(o_totalprice) AS low,
 arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2)"""


def _null_bars(t: Tables):
    return qs.daily_bars(t.orders.withColumn("o_orderstatus", F.expr(HOLED)), "o_orderdate", "o_totalprice", ["o_orderdate", "o_orderkey"], K)


@query(
    "spread_null_key",
    f"""WITH {NULL_BARS} SELECT o_orderstatus, {q6('AVG(high - low)')} AS mean, {q6('stddev_samp(high - low)')} AS std, {q6('stddev_samp(high)')} AS std_high,
 {q6('stddev_samp(low)')} AS std_low, {q6('quantile_cont(high - low, 0.5)')} AS median FROM b GROUP BY 1""",
)
def spread_null_key(t: Tables):
    return rounded(qs.spread(_null_bars(t), K, "high", "low"), "mean", "std", "std_high", "std_low", "median")


@query(
    "around_events_null_key",
    f"""WITH {NULL_BARS}, e AS (SELECT DISTINCT o_orderstatus, day AS event_day FROM b WHERE dayofmonth(day) = 1),
 j AS (SELECT e.o_orderstatus, event_day, close, day < event_day AS is_before FROM e
 LEFT JOIN b ON b.o_orderstatus IS NOT DISTINCT FROM e.o_orderstatus AND day BETWEEN event_day - 3 AND event_day + 3 AND day <> event_day)
 SELECT o_orderstatus, event_day, COUNT(close) FILTER (WHERE is_before) AS n_before, {q6('AVG(close) FILTER (WHERE is_before)')} AS mean_before,
 COUNT(close) FILTER (WHERE NOT is_before) AS n_after, {q6('AVG(close) FILTER (WHERE NOT is_before)')} AS mean_after,
 {q6('AVG(close) FILTER (WHERE NOT is_before) - AVG(close) FILTER (WHERE is_before)')} AS change FROM j GROUP BY 1, 2""",
)
def around_events_null_key(t: Tables):
    series = _null_bars(t)
    return rounded(hp.around_events(series, series.where("dayofmonth(day) = 1"), K, 3), "mean_before", "mean_after", "change")


HOT = "CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_suppkey END"


@query("aggregate_median_hot_group", f"SELECT {HOT} AS supplier, {q6('quantile_cont(l_extendedprice, 0.5)')} AS median FROM lineitem GROUP BY 1")
def aggregate_median_hot_group(t: Tables):
    """One group holds a third of the rows; the limit of 500 rows makes the bracket search run on small tables too."""
    lines = t.lineitem.selectExpr(f"{HOT} AS supplier", "l_extendedprice")
    return rounded(grouped_quantile(lines, ["supplier"], "l_extendedprice", 0.5, "median", limit=500), "median")


@query("exact_quantiles_bracketed", f"SELECT {q6('quantile_cont(l_extendedprice, 0.3)')} AS low, {q6('quantile_cont(l_extendedprice, 0.9)')} AS high FROM lineitem")
def exact_quantiles_bracketed(t: Tables):
    """With a tiny histogram the bracket search runs whatever the size of the table."""
    low, high = exact_quantiles(t.lineitem, {"l_extendedprice": [0.3, 0.9]}, limit=200)["l_extendedprice"]
    return rounded(t.spark.createDataFrame([(low, high)], "low double, high double"), "low", "high")


@query("label_encode_salted", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_encoded FROM customer")
def label_encode_salted(t: Tables):
    """With a limit of two values the code table is range-partitioned and joined under salts."""
    return encode.label_encode(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", limit=2).select("c_custkey", "c_mktsegment_encoded")


@query("json_array_source", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_array_source(t: Tables):
    """One JSON array document, the form that is not splittable, written by Spark and read back."""
    path = scratch_path(t.spark, "suppliers.json")
    rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(path)
    return io.read_table(t.spark, path, schema="s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query(
    "isolation_forest_invariants",
    f"""{HEAVY_SQL} SELECT COUNT(*) AS n_rows, COUNT(*) - COUNT(l_extendedprice) AS nulls, {q6('quantile_cont(l_extendedprice, 0.5)')} AS replaced_by,
 TRUE AS one_value, TRUE AS some_changed, TRUE AS at_most_a_tenth, TRUE AS largest_gone FROM g""",
)
def isolation_forest_invariants(t: Tables):
    """What must hold whatever trees were drawn: rows and NULLs stay, the flagged tenth at most becomes the exact median, the largest values are among it."""
    both = outliers.isolation_forest(t.heavy.withColumn("u", F.col("l_extendedprice")), "l_extendedprice").withColumnRenamed("l_extendedprice", "v")
    changed = F.col("u") != F.col("v")
    out = both.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min(F.when(changed, F.col("v"))).alias("replaced_by"),
        (F.min(F.when(changed, F.col("v"))) == F.max(F.when(changed, F.col("v")))).alias("one_value"), (F.count_if(changed) > 0).alias("some_changed"),
        (F.count_if(changed) <= F.ceil(F.count("u") * 0.1)).alias("at_most_a_tenth"), (F.max("v") < F.max("u")).alias("largest_gone"),
    )
    return rounded(out, "replaced_by")


@query("impute_median_sketch_rank", f"{GAPS_SQL} SELECT COUNT(*) - COUNT(l_extendedprice) AS filled, TRUE AS one_value, TRUE AS near_the_middle FROM g")
def impute_median_sketch_rank(t: Tables):
    """The sketch fills one existing value whose rank is within 0.1 % of the middle."""
    both = impute.impute(t.gaps.withColumn("u", F.col("l_extendedprice")), "l_extendedprice", "median", exact=False).withColumnRenamed("l_extendedprice", "v")
    filled = F.col("u").isNull() & F.col("v").isNotNull()
    found = both.agg(F.count_if(filled).alias("filled"), F.min(F.when(filled, F.col("v"))).alias("lo"), F.max(F.when(filled, F.col("v"))).alias("hi")).first()
    ranks = both.agg(F.count_if(F.col("u") < found.lo).alias("below"), F.count_if(F.col("u") <= found.lo).alias("upto"), F.count("u").alias("n"))
    near = (F.col("below") <= F.col("n") * 0.501) & (F.col("upto") >= F.col("n") * 0.499)
    return ranks.select(F.lit(found.filled).alias("filled"), F.lit(found.lo == found.hi).alias("one_value"), near.alias("near_the_middle"))
