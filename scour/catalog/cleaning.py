"""Missing values, outliers and duplicates."""

from pyspark.sql import functions as F

from scour.catalog.base import GAPS_SQL, HEAVY_SQL, Tables, q6, query, r6, rounded
from scour.operators import duplicates, impute, outliers
from scour.plans.stages import apply_stage

KEYS = ["l_orderkey", "l_linenumber"]


def _fences(column: str, source: str = "g") -> str:
    """(lo, hi) of one column as a sub-select."""
    return (
        f"SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
        f"(SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})"
    )


@query(
    "null_census",
    f"""{GAPS_SQL} SELECT 'l_orderkey' AS column_name, COUNT(*) - COUNT(l_orderkey) AS nulls FROM g
 UNION ALL SELECT 'l_linenumber', COUNT(*) - COUNT(l_linenumber) FROM g UNION ALL SELECT 'l_quantity', COUNT(*) - COUNT(l_quantity) FROM g
 UNION ALL SELECT 'l_extendedprice', COUNT(*) - COUNT(l_extendedprice) FROM g UNION ALL SELECT 'l_returnflag', COUNT(*) - COUNT(l_returnflag) FROM g""",
)
def null_census(t: Tables):
    return impute.null_census(t.gaps).withColumnRenamed("column", "column_name")


@query(
    "impute_mean",
    f"{GAPS_SQL} SELECT l_orderkey, l_linenumber, {q6('COALESCE(l_quantity, (SELECT AVG(l_quantity) FROM g))')} AS l_quantity FROM g",
)
def impute_mean(t: Tables):
    return rounded(impute.impute(t.gaps, "l_quantity", "mean").select(*KEYS, "l_quantity"), "l_quantity")


MEDIAN_SQL = q6("COALESCE(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM g))")
MODE_SQL = """COALESCE(l_returnflag, (SELECT l_returnflag FROM g WHERE l_returnflag IS NOT NULL
 GROUP BY l_returnflag ORDER BY COUNT(*) DESC, l_returnflag LIMIT 1))"""


@query("impute_median", f"{GAPS_SQL} SELECT l_orderkey, l_linenumber, {MEDIAN_SQL} AS l_extendedprice FROM g")
def impute_median(t: Tables):
    return rounded(impute.impute(t.gaps, "l_extendedprice", "median").select(*KEYS, "l_extendedprice"), "l_extendedprice")


@query("impute_median_sketch")
def impute_median_sketch(t: Tables):
    return impute.impute(t.gaps, "l_extendedprice", "median", exact=False).select(*KEYS, "l_extendedprice")


@query("impute_mode", f"{GAPS_SQL} SELECT l_orderkey, l_linenumber, {MODE_SQL} AS l_returnflag FROM g")
def impute_mode(t: Tables):
    return impute.impute(t.gaps, "l_returnflag", "mode").select(*KEYS, "l_returnflag")


def _adaptive(column: str) -> str:
    return f"""(SELECT CASE WHEN COUNT(*) FILTER (WHERE {column} < lo OR {column} > hi) > 0.05 * COUNT({column})
 THEN quantile_cont({column}, 0.5) ELSE AVG({column}) END FROM g, ({_fences(column)}))"""


@query(
    "impute_adaptive",
    f"""{GAPS_SQL} SELECT l_orderkey, l_linenumber, {q6(f"COALESCE(l_quantity, {_adaptive('l_quantity')})")} AS l_quantity,
 {q6(f"COALESCE(l_extendedprice, {_adaptive('l_extendedprice')})")} AS l_extendedprice FROM g""",
)
def impute_adaptive(t: Tables):
    numbers = t.gaps.select(*KEYS, "l_quantity", "l_extendedprice")
    return rounded(impute.impute_table(numbers), "l_quantity", "l_extendedprice")


@query(
    "impute_table",
    f"""{GAPS_SQL} SELECT l_orderkey, l_linenumber, {q6(f"COALESCE(l_quantity, {_adaptive('l_quantity')})")} AS l_quantity,
 {MEDIAN_SQL} AS l_extendedprice, {MODE_SQL} AS l_returnflag FROM g""",
)
def impute_table(t: Tables):
    """One operation on any target fills every column, each by its own method."""
    plan = {"l_extendedprice": [{"operation": "handle_missing_values", "method": "median"}]}
    out, _ = apply_stage(t.gaps, plan, "cleaning")
    return rounded(out, "l_quantity", "l_extendedprice")


def _by_skew(column: str) -> str:
    return f"(SELECT CASE WHEN abs(skewness({column})) > 1 THEN quantile_cont({column}, 0.5) ELSE AVG({column}) END FROM g)"


@query(
    "impute_by_skew",
    f"""{GAPS_SQL} SELECT l_orderkey, l_linenumber, {q6(f"COALESCE(l_quantity, {_by_skew('l_quantity')})")} AS l_quantity,
 {q6(f"COALESCE(l_extendedprice, {_by_skew('l_extendedprice')})")} AS l_extendedprice FROM g""",
)
def impute_by_skew(t: Tables):
    numbers = t.gaps.select(*KEYS, "l_quantity", "l_extendedprice")
    return rounded(impute.impute_table(numbers, adaptive="skew"), "l_quantity", "l_extendedprice")


def _census_sql(names: list[str]) -> str:
    one = """SELECT '{c}' AS column_name, {q1} AS q1, {q3} AS q3, {lo} AS lower, {hi} AS upper, COUNT(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers,
 {ratio} AS ratio FROM g, (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
 (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM g)) GROUP BY q1, q3, lo, hi"""
    return " UNION ALL ".join(
        one.format(c=c, q1=q6("q1"), q3=q6("q3"), lo=q6("lo"), hi=q6("hi"), ratio=q6(f"COUNT(*) FILTER (WHERE {c} < lo OR {c} > hi) / COUNT({c})"))
        for c in names
    )


@query("outlier_census", f"{HEAVY_SQL} {_census_sql(['l_quantity', 'l_extendedprice'])}")
def outlier_census(t: Tables):
    out = outliers.outlier_census(t.heavy, ["l_quantity", "l_extendedprice"]).withColumnRenamed("column", "column_name")
    return rounded(out, "q1", "q3", "lower", "upper", "ratio")


CLIP_SQL = f"""{HEAVY_SQL} SELECT l_orderkey, l_linenumber,
 {q6("CASE WHEN l_extendedprice < lo THEN lo WHEN l_extendedprice > hi THEN hi ELSE l_extendedprice END")} AS l_extendedprice
 FROM g, ({_fences('l_extendedprice')})"""


@query("iqr_clipping", CLIP_SQL)
def iqr_clipping(t: Tables):
    return rounded(outliers.iqr_clip(t.heavy, "l_extendedprice").select(*KEYS, "l_extendedprice"), "l_extendedprice")


@query("outliers_adaptive", CLIP_SQL)
def outliers_adaptive(t: Tables):
    plan = {"l_extendedprice": [{"operation": "handle_outliers"}]}
    out, _ = apply_stage(t.heavy.select(*KEYS, "l_extendedprice"), plan, "cleaning")
    return rounded(out, "l_extendedprice")


ZSCORE = "(SELECT AVG(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM g)"


@query(
    "zscore_nullify",
    f"""{HEAVY_SQL} SELECT l_orderkey, l_linenumber,
 CASE WHEN abs((l_extendedprice - m) / s) > 3 THEN NULL ELSE l_extendedprice END AS l_extendedprice FROM g, {ZSCORE}""",
)
def zscore_nullify(t: Tables):
    return outliers.zscore_removal(t.heavy, "l_extendedprice").select(*KEYS, "l_extendedprice")


@query(
    "zscore_drop_rows",
    f"""{HEAVY_SQL} SELECT l_orderkey, l_linenumber, l_extendedprice FROM g, {ZSCORE}
 WHERE l_extendedprice IS NULL OR abs((l_extendedprice - m) / s) <= 3""",
)
def zscore_drop_rows(t: Tables):
    return outliers.zscore_removal(t.heavy, "l_extendedprice", "drop_rows").select(*KEYS, "l_extendedprice")


@query("isolation_forest")
def isolation_forest(t: Tables):
    return outliers.isolation_forest(t.heavy, "l_extendedprice").select(*KEYS, "l_extendedprice")


@query(
    "outlier_report",
    f"""{HEAVY_SQL}, o AS (SELECT l_extendedprice AS v FROM g, ({_fences('l_extendedprice')}) WHERE l_extendedprice < lo OR l_extendedprice > hi)
 SELECT 'l_extendedprice' AS column_name, (SELECT COUNT(*) FROM o) AS outliers, CAST(r AS INTEGER) AS position, {q6('v')} AS value
 FROM (SELECT v, row_number() OVER (ORDER BY v) AS r FROM o) WHERE r <= 5""",
)
def outlier_report(t: Tables):
    report = outliers.outlier_report(t.heavy, ["l_quantity", "l_extendedprice"])
    rows = report.select(F.col("column").alias("column_name"), "outliers", F.posexplode("sample").alias("p", "v"))
    return rows.select("column_name", "outliers", (F.col("p") + 1).alias("position"), r6("v").alias("value"))


NARROW = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"]


@query("dedup_rows", f"SELECT DISTINCT {', '.join(NARROW)} FROM lineitem")
def dedup_rows(t: Tables):
    return duplicates.remove_duplicates(t.lineitem.select(*NARROW))


ALL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(
    "dedup_subset",
    f"SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, {ALL}) AS r FROM lineitem) WHERE r = 1",
)
def dedup_subset(t: Tables):
    return duplicates.remove_duplicates(t.lineitem, ["l_partkey"], ["l_shipdate"])


GROUPS = "SELECT l_partkey, l_quantity, COUNT(*) AS n FROM lineitem GROUP BY l_partkey, l_quantity"


@query("duplicate_census", f"SELECT CAST(SUM(n) FILTER (WHERE n > 1) AS BIGINT) AS members, CAST(SUM(n - 1) AS BIGINT) AS excess FROM ({GROUPS})")
def duplicate_census(t: Tables):
    return duplicates.duplicate_census(t.lineitem.select("l_partkey", "l_quantity"))


@query("duplicate_sample", f"SELECT l_partkey, l_quantity, n AS copies FROM ({GROUPS}) WHERE n > 1 ORDER BY l_partkey, l_quantity LIMIT 5")
def duplicate_sample(t: Tables):
    return duplicates.duplicate_sample(t.lineitem.select("l_partkey", "l_quantity"))
