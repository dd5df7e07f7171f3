"""Registration of queries and the fixtures they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Tables:
    """The tables of one data folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # Tables with gaps, heavy tails and dirty spellings, derived row by row from the clean ones.

    @property
    def gaps(self) -> DataFrame:
        return self.lineitem.selectExpr(*[line.strip() for line in GAPS.split(";")])

    @property
    def heavy(self) -> DataFrame:
        return self.lineitem.selectExpr(*[line.strip() for line in HEAVY.split(";")])

    @property
    def dirty(self) -> DataFrame:
        return self.customer.selectExpr(*[line.strip() for line in DIRTY.split(";")])


# The same expressions serve Spark and the SQL counterpart.
GAPS = """l_orderkey; l_linenumber;
CASE WHEN l_orderkey % 10 = 3 THEN NULL ELSE l_quantity END AS l_quantity;
CASE WHEN l_orderkey % 7 = 2 THEN NULL WHEN l_orderkey % 12 = 1 THEN l_extendedprice * 20 ELSE l_extendedprice END AS l_extendedprice;
CASE WHEN l_orderkey % 11 = 5 THEN NULL ELSE l_returnflag END AS l_returnflag"""
HEAVY = """l_orderkey; l_linenumber; l_quantity;
CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 20 WHEN l_orderkey % 89 = 1 THEN NULL ELSE l_extendedprice END AS l_extendedprice"""
DIRTY = """c_custkey; c_name; c_acctbal;
CASE WHEN c_custkey % 13 = 5 THEN NULL ELSE c_nationkey END AS c_nationkey;
CASE WHEN c_custkey % 17 = 4 THEN NULL WHEN c_custkey % 5 = 1 THEN lower(c_mktsegment)
 WHEN c_custkey % 5 = 2 THEN concat('  ', c_mktsegment, ' ')
 WHEN c_custkey % 5 = 3 THEN left(c_mktsegment, length(c_mktsegment) - 1) ELSE c_mktsegment END AS c_mktsegment"""


def sql_of(fixture: str, table: str) -> str:
    return f"SELECT {fixture.replace(';', ',')} FROM {table}"


GAPS_SQL = f"WITH g AS ({sql_of(GAPS, 'lineitem')})"
HEAVY_SQL = f"WITH g AS ({sql_of(HEAVY, 'lineitem')})"
DIRTY_SQL = f"WITH g AS ({sql_of(DIRTY, 'customer')})"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)``; without SQL only the rows are checked, and a unit test compares with brute force."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, lambda spark, folder: fn(Tables(spark, folder)), sql)
        return fn

    return wrap


def r6(c: Column | str) -> Column:
    """Six places, nudged off exact halves so that summation order cannot tip the rounding."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") + 1e-8, 6)


def q6(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE) + 1e-8, 6)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(f"`{n}`") for n in names})
