"""Aggregation, bins, scaling, reshaping, joins and encodings."""

from functools import reduce

from pyspark.sql import functions as F

from scour.catalog.base import DIRTY_SQL, HEAVY_SQL, Tables, q6, query, r6, rounded
from scour.operators import encode, features, reshape
from scour.plans.stages import apply_stage

KEYS = ["l_returnflag", "l_linestatus"]
FLAGGED = "SELECT CASE WHEN l_orderkey % 11 = 5 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM lineitem"


def flagged(t: Tables):
    flag = F.expr("CASE WHEN l_orderkey % 11 = 5 THEN NULL ELSE l_returnflag END")
    return t.lineitem.withColumn("l_returnflag", flag)


def _grouped_sql(expr: str, digits: int = 6) -> str:
    rounded_expr = q6(expr) if digits == 6 else f"ROUND(CAST({expr} AS DOUBLE), {digits})"
    return f"SELECT l_returnflag, l_linestatus, {rounded_expr} AS l_extendedprice FROM ({FLAGGED}) WHERE l_returnflag IS NOT NULL GROUP BY 1, 2"


def _grouped(t: Tables, method: str):
    """Through the configured operation, keys as one comma-separated text."""
    op = {"operation": "aggregate", "group_by_cols": "l_returnflag, l_linestatus", "target_column": "l_extendedprice", "method": method}
    out, _ = apply_stage(flagged(t), {"modification_operations": {"global": [op]}}, "modification")
    return out


# Sums of cents: two places hold the whole value.


@query("aggregate_sum", _grouped_sql("SUM(CAST(l_extendedprice AS DECIMAL(18,2)))", 2))
def aggregate_sum(t: Tables):
    return _grouped(t, "sum").withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@query("aggregate_mean", _grouped_sql("AVG(l_extendedprice)"))
def aggregate_mean(t: Tables):
    return rounded(_grouped(t, "mean"), "l_extendedprice")


@query("aggregate_median", _grouped_sql("quantile_cont(l_extendedprice, 0.5)"))
def aggregate_median(t: Tables):
    return rounded(_grouped(t, "median"), "l_extendedprice")


METHODS_SQL = {
    "min": "MIN(l_quantity)", "max": "MAX(l_quantity)", "count": "COUNT(l_quantity)", "size": "COUNT(*)", "nunique": "COUNT(DISTINCT l_quantity)",
    "std": "stddev_samp(l_quantity)", "var": "var_samp(l_quantity)", "sem": "stddev_samp(l_quantity) / sqrt(COUNT(l_quantity))",
    "skew": "skewness(l_quantity)",
}


@query(
    "aggregate_methods",
    " UNION ALL ".join(
        f"SELECT '{m}' AS method, l_returnflag, l_linestatus, {q6(e)} AS value FROM lineitem GROUP BY 2, 3" for m, e in METHODS_SQL.items()
    ),
)
def aggregate_methods(t: Tables):
    parts = [
        features.aggregate(t.lineitem, KEYS, "l_quantity", m).select(F.lit(m).alias("method"), *KEYS, r6("l_quantity").alias("value"))
        for m in METHODS_SQL
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


ORDERED = "(l_shipdate, l_linenumber, l_partkey, l_suppkey)"


@query(
    "aggregate_first_last",
    f"""SELECT l_orderkey, arg_min(l_quantity, {ORDERED}) AS first, arg_max(l_quantity, {ORDERED}) AS last, ROUND(product(l_quantity)) AS prod
 FROM lineitem GROUP BY l_orderkey""",
)
def aggregate_first_last(t: Tables):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
    parts = [
        features.aggregate(t.lineitem, "l_orderkey", "l_quantity", m, order).withColumnRenamed("l_quantity", m) for m in ("first", "last", "prod")
    ]
    return reduce(lambda a, b: a.join(b, "l_orderkey"), parts).withColumn("prod", F.round("prod"))


LETTERS = ["a", "b", "c", "d", "e"]


@query(
    "equal_width_bins",
    """SELECT p_partkey, CASE WHEN x <= lo + w THEN 'a' WHEN x <= lo + w * 2 THEN 'b' WHEN x <= lo + w * 3 THEN 'c' WHEN x <= lo + w * 4 THEN 'd' ELSE 'e' END AS band
 FROM (SELECT p_partkey, p_retailprice AS x FROM part), (SELECT MIN(p_retailprice) AS lo, (MAX(p_retailprice) - MIN(p_retailprice)) / 5 AS w FROM part)""",
)
def equal_width_bins(t: Tables):
    bins = features.fit_equal_width(t.part, "p_retailprice", 5, LETTERS)
    return features.discretise(t.part, "p_retailprice", bins, "band").select("p_partkey", "band")


def _explicit_sql(lowest: str, labels: list[str]) -> str:
    return f"""SELECT p_partkey, CASE WHEN p_size {lowest} 1 AND p_size <= 10 THEN '{labels[0]}' WHEN p_size > 10 AND p_size <= 20 THEN '{labels[1]}'
 WHEN p_size > 20 AND p_size <= 40 THEN '{labels[2]}' END AS p_size_binned FROM part"""


def _explicit(t: Tables, stage: str):
    op = {"operation": "discretize_bin", "method": "equal_width", "bins": [1, 10, 20, 40]}
    out, _ = apply_stage(t.part, {"p_size": [op]}, stage)
    return out.select("p_partkey", "p_size_binned")


@query("explicit_bins", _explicit_sql(">=", ["(0.999, 10.0]", "(10.0, 20.0]", "(20.0, 40.0]"]))
def explicit_bins(t: Tables):
    return _explicit(t, "transformation")


@query("explicit_bins_open", _explicit_sql(">", ["(1, 10]", "(10, 20]", "(20, 40]"]))
def explicit_bins_open(t: Tables):
    """The modification flavour leaves the lowest edge outside."""
    return _explicit(t, "modification")


@query(
    "equal_frequency_bins",
    """SELECT o_orderkey, CASE WHEN o_totalprice <= q[1] THEN 'q1' WHEN o_totalprice <= q[2] THEN 'q2' WHEN o_totalprice <= q[3] THEN 'q3' ELSE 'q4' END AS quarter
 FROM orders, (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)""",
)
def equal_frequency_bins(t: Tables):
    bins = features.fit_equal_frequency(t.orders, "o_totalprice", 4, ["q1", "q2", "q3", "q4"])
    return features.discretise(t.orders, "o_totalprice", bins, "quarter").select("o_orderkey", "quarter")


@query(
    "equal_frequency_ties",
    """SELECT p_partkey, CAST(list_position(list_transform(list_slice(list_sort(list_distinct(q)), 2, 11), lambda e: p_discount <= e), true) AS INTEGER) AS bin
 FROM (SELECT p_partkey, p_size % 4 AS p_discount FROM part), (SELECT quantile_cont(p_size % 4, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM part)""",
)
def equal_frequency_ties(t: Tables):
    """Ten bins of four values: equal edges collapse and ties share a bin."""
    table = t.part.selectExpr("p_partkey", "p_size % 4 AS p_discount")
    fitted = features.fit_equal_frequency(table, "p_discount", 10)
    numbered = features.make_bins(fitted.edges, [str(i + 1) for i in range(len(fitted.labels))], include_lowest=True)
    return features.discretise(table, "p_discount", numbered, "bin").select("p_partkey", F.col("bin").cast("int").alias("bin"))


@query(
    "age_groups",
    """SELECT p_partkey, CASE WHEN a < 0 OR a >= 100 THEN NULL WHEN a < 18 THEN '0-18' WHEN a < 35 THEN '19-35' WHEN a < 55 THEN '36-55' ELSE '56+' END AS age_group
 FROM (SELECT p_partkey, p_size * 3 - 10 AS a FROM part)""",
)
def age_groups(t: Tables):
    op = {"operation": "create_new_feature", "method": "age_grouping", "new_feature_name": "age_group"}
    out, _ = apply_stage(t.part.withColumn("age", F.expr("p_size * 3 - 10")), {"age": [op]}, "modification")
    return out.select("p_partkey", "age_group")


@query(
    "bmi_classes",
    """SELECT p_partkey, CASE WHEN b <= 0 OR b > 100 THEN NULL WHEN b <= 18.5 THEN 'Underweight' WHEN b <= 24.9 THEN 'Normal weight' WHEN b <= 29.9 THEN 'Overweight'
 WHEN b <= 34.9 THEN 'Obesity Class I' WHEN b <= 39.9 THEN 'Obesity Class II' ELSE 'Obesity Class III' END AS bmi_class
 FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) + 0.5 AS b FROM part)""",
)
def bmi_classes(t: Tables):
    table = t.part.withColumn("bmi", F.col("p_size").cast("double") + 0.5)
    return features.bmi_classes(table, name="bmi_class").select("p_partkey", "bmi_class")


def _scaled_sql(column: str, shift: str, width: str) -> str:
    return f"""{HEAVY_SQL} SELECT l_orderkey, l_linenumber, {q6(f'({column} - a) / b')} AS {column}
 FROM g, (SELECT {shift} AS a, {width} AS b FROM g)"""


MIN_MAX_SQL = _scaled_sql("l_extendedprice", "MIN(l_extendedprice)", "MAX(l_extendedprice) - MIN(l_extendedprice)")


@query("min_max_scale", MIN_MAX_SQL)
def min_max_scale(t: Tables):
    out = features.scale(t.heavy, "l_extendedprice", "min_max_scaler")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")


STANDARD_SQL = _scaled_sql("l_quantity", "AVG(l_quantity)", "stddev_samp(l_quantity)")


@query("standard_scale", STANDARD_SQL)
def standard_scale(t: Tables):
    out = features.scale(t.heavy, "l_quantity", "standard_scaler")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("adaptive_scale_skewed", MIN_MAX_SQL)
def adaptive_scale_skewed(t: Tables):
    out = features.scale(t.heavy, "l_extendedprice")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")


@query("adaptive_scale_even", STANDARD_SQL)
def adaptive_scale_even(t: Tables):
    out = features.scale(t.heavy, "l_quantity")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "pivot_mean",
    "SELECT user_id, "
    + ", ".join(f"{q6(f'AVG(value) FILTER (WHERE event_type = {chr(39)}{e}{chr(39)})')} AS {e}" for e in EVENT_TYPES)
    + " FROM events GROUP BY user_id",
)
def pivot_mean(t: Tables):
    out = reshape.pivot(t.events, "user_id", "event_type", "value")
    return rounded(out, *EVENT_TYPES)


@query(
    "pivot_two_values",
    "SELECT user_id, " + ", ".join(f"MAX({v}) FILTER (WHERE event_type = '{e}') AS {v}_{e}" for v in ("value", "event_id") for e in EVENT_TYPES)
    + " FROM events GROUP BY user_id",
)
def pivot_two_values(t: Tables):
    return reshape.pivot(t.events, "user_id", "event_type", ["value", "event_id"], "max")


@query(
    "unpivot",
    """SELECT p_partkey, p_type, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part
 UNION ALL SELECT p_partkey, p_type, 'p_retailprice', CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_retailprice END FROM part""",
)
def unpivot(t: Tables):
    table = t.part.withColumn("p_retailprice", F.expr("CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE p_retailprice END"))
    return reshape.unpivot(table, ["p_partkey", "p_type"], ["p_size", "p_retailprice"])


def _orders(t: Tables):
    """Orders whose customer numbers run past the customer table."""
    return t.orders.selectExpr("o_orderkey", "o_custkey * 2 AS custkey", "o_totalprice")


def _buyers(t: Tables):
    return t.customer.selectExpr("c_custkey AS custkey", "c_mktsegment")


O = "(SELECT o_orderkey, o_custkey * 2 AS custkey, o_totalprice FROM orders) o"
C = "(SELECT c_custkey AS custkey, c_mktsegment FROM customer) c"


def _merge(t: Tables, how: str, operation: str = "merge"):
    op = {"operation": operation, "right_df_name": "buyers", "on": "custkey", "how": how}
    out, _ = apply_stage(_orders(t), {"global": [op]}, "transformation", tables={"buyers": _buyers(t)})
    return out


@query("merge_inner", f"SELECT custkey, o_orderkey, o_totalprice, c_mktsegment FROM {O} JOIN {C} USING (custkey)")
def merge_inner(t: Tables):
    return _merge(t, "inner")


@query("merge_left", f"SELECT custkey, o_orderkey, o_totalprice, c_mktsegment FROM {O} LEFT JOIN {C} USING (custkey)")
def merge_left(t: Tables):
    return _merge(t, "left")


@query("merge_right", f"SELECT custkey, o_orderkey, o_totalprice, c_mktsegment FROM {O} RIGHT JOIN {C} USING (custkey)")
def merge_right(t: Tables):
    return _merge(t, "right")


@query("merge_outer", f"SELECT custkey, o_orderkey, o_totalprice, c_mktsegment FROM {O} FULL JOIN {C} USING (custkey)")
def merge_outer(t: Tables):
    return _merge(t, "outer")


@query("join_semi", f"SELECT custkey, o_orderkey, o_totalprice FROM {O} SEMI JOIN {C} USING (custkey)")
def join_semi(t: Tables):
    return _merge(t, "left_semi", "join")


@query("join_anti", f"SELECT custkey, o_orderkey, o_totalprice FROM {O} ANTI JOIN {C} USING (custkey)")
def join_anti(t: Tables):
    return _merge(t, "left_anti", "join")


@query(
    "join_null_keys",
    f"""{DIRTY_SQL}, k AS (SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END AS c_nationkey, n_name FROM nation)
 SELECT g.c_nationkey, c_custkey, c_name, c_acctbal, c_mktsegment, n_name FROM g JOIN k ON g.c_nationkey IS NOT DISTINCT FROM k.c_nationkey""",
)
def join_null_keys(t: Tables):
    nations = t.nation.selectExpr("CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END AS c_nationkey", "n_name")
    return reshape.merge(t.dirty, nations, "c_nationkey", null_safe=True)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
HOLED = "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders"
ONE_HOT_SQL = "SELECT o_orderkey, " + ", ".join(f"coalesce(o_orderpriority = '{p}', false) AS \"o_orderpriority_{p}\"" for p in PRIORITIES) + f" FROM ({HOLED})"


def _holed(t: Tables):
    return t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority")


@query("one_hot_encode", ONE_HOT_SQL)
def one_hot_encode(t: Tables):
    return encode.one_hot(_holed(t), "o_orderpriority")


LABEL_SQL = """SELECT {k}, {c}, CASE WHEN {c} IS NULL THEN (SELECT COUNT(DISTINCT {c}) FROM ({s})) ELSE code END AS {c}_encoded
 FROM ({s}) LEFT JOIN (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM ({s}) WHERE {c} IS NOT NULL)) USING ({c})"""


@query("label_encode", LABEL_SQL.format(k="o_orderkey", c="o_orderpriority", s=HOLED))
def label_encode(t: Tables):
    return encode.label_encode(_holed(t), "o_orderpriority")


NAMES = "SELECT c_custkey, c_name FROM customer"


@query("label_encode_many", LABEL_SQL.format(k="c_custkey", c="c_name", s=NAMES))
def label_encode_many(t: Tables):
    """More values than may be broadcast: ranked over range partitions and joined by shuffle."""
    return encode.label_encode(t.customer.select("c_custkey", "c_name"), "c_name", limit=100)


FREQ_SQL = """SELECT {k}, {c}, {share} AS {c}_freq_encoded FROM ({s}) LEFT JOIN
 (SELECT {c}, COUNT(*) AS n FROM ({s}) WHERE {c} IS NOT NULL GROUP BY {c}) USING ({c})"""
FREQ_PRIORITY = FREQ_SQL.format(k="o_orderkey", c="o_orderpriority", s=HOLED, share=q6(f"n / (SELECT COUNT(o_orderpriority) FROM ({HOLED}))"))


@query("frequency_encode", FREQ_PRIORITY)
def frequency_encode(t: Tables):
    return rounded(encode.frequency_encode(_holed(t), "o_orderpriority"), "o_orderpriority_freq_encoded")


@query("frequency_encode_many", FREQ_PRIORITY)
def frequency_encode_many(t: Tables):
    """The shuffled lookup with salted frequent values gives the same shares."""
    return rounded(encode.frequency_encode(_holed(t), "o_orderpriority", limit=2), "o_orderpriority_freq_encoded")


@query("adaptive_encode_few", ONE_HOT_SQL)
def adaptive_encode_few(t: Tables):
    return encode.encode(_holed(t), "o_orderpriority")


@query("adaptive_encode_some", LABEL_SQL.format(k="p_partkey", c="p_brand", s="SELECT p_partkey, p_brand FROM part"))
def adaptive_encode_some(t: Tables):
    return encode.encode(t.part.select("p_partkey", "p_brand"), "p_brand")


@query(
    "adaptive_encode_many",
    FREQ_SQL.format(k="p_partkey", c="p_name", s="SELECT p_partkey, p_name FROM part", share=q6("n / (SELECT COUNT(p_name) FROM part)")),
)
def adaptive_encode_many(t: Tables):
    return rounded(encode.encode(t.part.select("p_partkey", "p_name"), "p_name"), "p_name_freq_encoded")
