"""Sources, sinks, projection and typing."""

from pyspark.sql import functions as F

from scour.catalog.base import GAPS_SQL, Tables, q6, query, r6
from scour.operators import schema
from scour.session import scratch_path
from scour.sources import tables as io

ORDERS_TEXT = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderpriority FROM orders
"""


@query("csv_source", ORDERS_TEXT)
def csv_source(t: Tables):
    path = io.write_table(t.orders, scratch_path(t.spark, "orders"), "csv")
    return io.read_csv(t.spark, path)


@query("csv_declared_schema", "SELECT * FROM orders")
def csv_declared_schema(t: Tables):
    path = io.write_table(t.orders, scratch_path(t.spark, "orders"), "csv")
    return io.read_csv(t.spark, path, schema=t.orders.schema)


@query("csv_multiline_text", "SELECT doc_id, text, lang FROM documents")
def csv_multiline_text(t: Tables):
    path = io.write_table(t.documents.select("doc_id", "text", "lang"), scratch_path(t.spark, "documents"), "csv")
    return io.read_csv(t.spark, path, schema="doc_id bigint, text string, lang string", multiline=True)


@query("json_source", "SELECT conv_id, turn, role, text FROM conversations")
def json_source(t: Tables):
    path = io.write_table(t.conversations, scratch_path(t.spark, "conversations"), "json")
    return io.read_json(t.spark, path, lines=True).select("conv_id", "turn", "role", "text")


@query("read_by_extension", "SELECT * FROM customer")
def read_by_extension(t: Tables):
    return io.read_table(t.spark, f"{t.folder}/customer.parquet")


@query(
    "load_datasets",
    """SELECT 'customer.parquet' AS dataset, COUNT(*) AS n_rows, CAST(NULL AS VARCHAR) AS error FROM customer
 UNION ALL SELECT 'orders.parquet', COUNT(*), NULL FROM orders
 UNION ALL SELECT 'absent.parquet', NULL, 'FileNotFoundError' UNION ALL SELECT 'notes.pdf', NULL, 'ValueError'""",
)
def load_datasets(t: Tables):
    names = ["customer.parquet", "absent.parquet", "orders.parquet", "notes.pdf"]
    found, errors = io.load_datasets(t.spark, [f"{t.folder}/{n}" for n in names])
    counted = [df.agg(F.lit(n).alias("dataset"), F.count(F.lit(1)).alias("n_rows")) for n, df in found.items()]
    failed = [(n, None, e.split(":")[0]) for n, e in errors.items()]
    bad = t.spark.createDataFrame(failed, "dataset string, n_rows bigint, error string")
    return io.concat([c.withColumn("error", F.lit(None).cast("string")) for c in counted] + [bad])


@query(
    "concat_tables",
    """SELECT c_custkey AS id, c_acctbal AS acctbal, c_mktsegment AS segment, NULL AS name FROM customer
 UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""",
)
def concat_tables(t: Tables):
    a = t.customer.selectExpr("c_custkey AS id", "c_acctbal AS acctbal", "c_mktsegment AS segment")
    b = t.supplier.selectExpr("s_suppkey AS id", "s_acctbal AS acctbal", "s_name AS name")
    return io.concat([a, b])


@query("csv_sink", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def csv_sink(t: Tables):
    return io.read_table(t.spark, io.write_table(t.part, scratch_path(t.spark, "part"), "csv"))


@query("parquet_sink", "SELECT * FROM lineitem")
def parquet_sink(t: Tables):
    return io.read_table(t.spark, io.write_table(t.lineitem, scratch_path(t.spark, "lineitem"), "parquet"))


@query("keep_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def keep_columns(t: Tables):
    return schema.keep_columns(t.lineitem, ["l_orderkey", "l_quantity", "not_there"])


@query("drop_column", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def drop_column(t: Tables):
    return schema.drop_column(t.customer, "c_mktsegment")


@query("rename_column", "SELECT s_suppkey, s_name AS supplier_name, s_nationkey, s_acctbal FROM supplier")
def rename_column(t: Tables):
    return schema.rename_column(t.supplier, "s_name", "supplier_name")


@query(
    "derived_column",
    f"SELECT l_orderkey, l_linenumber, {q6('l_extendedprice * (1 - l_discount)')} AS net FROM lineitem",
)
def derived_column(t: Tables):
    out = schema.derive(t.lineitem, "l_extendedprice * (1 - l_discount)", "net")
    return out.select("l_orderkey", "l_linenumber", r6("net").alias("net"))


@query(
    "standardise_types",
    """SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS flag,
 CAST(o_orderdate AS TIMESTAMP) AS placed, o_orderpriority AS bad_number, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS mixed FROM orders""",
)
def standardise_types(t: Tables):
    """Texts to declared types: bad numbers become NULL, a column that is no date stays text."""
    raw = t.orders.selectExpr(
        "o_orderkey", "CAST(o_custkey AS STRING) AS o_custkey", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS o_totalprice",
        "CASE WHEN o_orderkey % 5 <> 0 THEN IF(o_orderkey % 2 = 0, 'True', 'false') END AS flag",
        "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS placed", "o_orderpriority AS bad_number",
        "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS STRING) ELSE 'n.a.' END AS mixed",
    )
    types = {"o_custkey": "integer", "o_totalprice": "float", "flag": "boolean", "placed": "datetime", "bad_number": "datetime", "mixed": "integer"}
    typed, _ = schema.standardise_types(raw, types)
    return typed.withColumn("placed", F.col("placed").cast("timestamp_ntz"))


@query(
    "compact_types",
    """SELECT o_orderkey, o_custkey, o_totalprice,
 CASE WHEN max(o_orderkey) OVER () < 32768 THEN 'smallint' ELSE 'int' END AS key_type, 'smallint' AS cust_type FROM orders""",
)
def compact_types(t: Tables):
    out = schema.compact_types(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"))
    kinds = dict(out.dtypes)
    return out.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_totalprice",
        F.lit(kinds["o_orderkey"]).alias("key_type"), F.lit(kinds["o_custkey"]).alias("cust_type"),
    )


def _flags_sql(table: str, names: list[str]) -> str:
    one = (
        "SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(DISTINCT {c}) AS n_distinct, "
        "COUNT(DISTINCT {c}) < 0.5 * COUNT(*) AND COUNT(DISTINCT {c}) < 50 AS categorical FROM {t}"
    )
    return " UNION ALL ".join(one.format(c=c, t=table) for c in names)


@query("categorical_flags", _flags_sql("part", ["p_name", "p_brand", "p_type"]))
def categorical_flags(t: Tables):
    tagged = schema.tag_categories(t.part)
    flags = schema.categorical_flags(t.part)
    rows = [(c, f["rows"], f["distinct"], tagged.schema[c].metadata["categorical"]) for c, f in flags.items()]
    return t.spark.createDataFrame(rows, "column_name string, n_rows bigint, n_distinct bigint, categorical boolean")


def _samples_sql(table: str, names: list[str]) -> str:
    one = (
        "SELECT '{c}' AS column_name, CAST(r AS INTEGER) AS position, v AS value FROM "
        "(SELECT v, row_number() OVER (ORDER BY v) AS r FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL)) WHERE r <= 3"
    )
    return " UNION ALL ".join(one.format(c=c, t=table) for c in names)


@query("sample_values", _samples_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def sample_values(t: Tables):
    return schema.sample_values(t.customer).withColumnRenamed("column", "column_name")


@query("head_rows", "SELECT doc_id, left(text, 1000) AS text, left(lang, 1000) AS lang FROM documents ORDER BY doc_id LIMIT 5")
def head_rows(t: Tables):
    return schema.head_rows(t.documents.select("doc_id", "text", "lang"), ["doc_id"], 5, 1000)


@query("drop_missing_rows", f"{GAPS_SQL} SELECT l_orderkey, l_linenumber, l_quantity FROM g WHERE l_quantity IS NOT NULL")
def drop_missing_rows(t: Tables):
    return schema.drop_missing_rows(t.gaps, "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")
