"""Categorical encodings: one-hot, label, frequency, adaptive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from scour.functions.columns import col, unique_names, value_counts
from scour.session import cut_lineage

BROADCAST_VALUES = 10_000
# A value held by more than this share of the rows is spread over SALTS join keys.
HOT_SHARE = 0.001
SALTS = 64


@dataclass(frozen=True)
class Codes:
    """A fitted value -> code table; ``small`` says its size was checked for broadcasting, ``hot`` lists frequent values."""

    table: DataFrame
    small: bool
    hot: tuple[str, ...]


def _counts(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, [column]).select("value", "n")


def join_codes(df: DataFrame, column: str, codes: Codes, out: str) -> DataFrame:
    """Look every row's code up. A small table is broadcast; a large one is joined with its frequent values salted."""
    table = codes.table.select(F.col("value").alias("__value"), F.col("code").alias(out))
    if codes.small:
        return df.join(F.broadcast(table), col(column) == F.col("__value"), "left").drop("__value")
    if not codes.hot:
        return df.join(table, col(column) == F.col("__value"), "left").drop("__value")
    hot = list(codes.hot)
    # The input partition picks the slot: copies of one row spread out, and a task that
    # is run again after a lost executor picks the same slot whatever its row order.
    spread = F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int")
    left = df.withColumn("__salt", F.when(col(column).isin(hot), spread).otherwise(F.lit(0)))
    copies = F.when(F.col("__value").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = table.withColumn("__slot", F.explode(copies))
    joined = left.join(right, (col(column) == F.col("__value")) & (F.col("__salt") == F.col("__slot")), "left")
    return joined.drop("__value", "__slot", "__salt")


def _large(counts: DataFrame, table: DataFrame, rows: int) -> Codes:
    """A code table too large to broadcast; at most 1 / HOT_SHARE values can hold that share each."""
    hot = counts.where(F.col("n") > HOT_SHARE * rows).select("value").collect()
    return Codes(table, False, tuple(r["value"] for r in hot))


def one_hot_values(df: DataFrame, column: str, limit: int | None = None) -> list[str]:
    """The sorted known values, which become columns; ``limit`` refuses more than so many."""
    known = df.select(col(column)).where(col(column).isNotNull()).distinct()
    found = [r[0] for r in (known if limit is None else known.limit(limit + 1)).collect()]
    if limit is not None and len(found) > limit:
        raise ValueError(f"column {column} has more than {limit} distinct values")
    return sorted(found)


def one_hot(df: DataFrame, column: str, values: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """One boolean column per sorted known value instead of the column; NULL is false everywhere.

    Values that differ only in case get names of their own: the later one in sorted order ends in _2.
    """
    values = one_hot_values(df, column, limit) if values is None else values
    kept = [c for c in df.columns if c != column]
    names = unique_names([f"{column}_{v}" for v in values], kept)
    flags = [F.coalesce(col(column) == F.lit(v), F.lit(False)).alias(n) for v, n in zip(values, names)]
    return df.select(*[col(c) for c in kept], *flags)


def label_codes(df: DataFrame, column: str, limit: int = BROADCAST_VALUES) -> Codes:
    """Rank of each distinct value in sorted order, from 0.

    Many values are range-partitioned: each partition numbers its own slice and adds
    the size of the slices before it, so no task sees all values.
    """
    spark = df.sparkSession
    counts = _counts(df, column)
    head = counts.limit(limit + 1).collect()
    if len(head) <= limit:
        rows = [(v, i) for i, v in enumerate(sorted(r["value"] for r in head))]
        return Codes(spark.createDataFrame(rows, "value string, code bigint"), True, ())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = cut_lineage(counts.repartitionByRange(parts, "value").withColumn("slice", F.spark_partition_id()))
    sizes = {r["slice"]: r["n"] for r in ranged.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = ranged.agg(F.sum("n")).first()[0]
    starts, total = [], 0
    for s in sorted(sizes):
        starts.append((s, total))
        total += sizes[s]
    offsets = spark.createDataFrame(starts, "slice int, start bigint")
    order = Window.partitionBy("slice").orderBy("value")
    numbered = ranged.withColumn("r", F.row_number().over(order) - 1).join(F.broadcast(offsets), "slice")
    table = numbered.select("value", (F.col("r") + F.col("start")).alias("code"))
    return _large(ranged, table, rows)


def label_encode(df: DataFrame, column: str, limit: int = BROADCAST_VALUES) -> DataFrame:
    """``{column}_encoded``: rank among the sorted distinct values; NULL ranks last."""
    codes = label_codes(df, column, limit)
    out = f"{column}_encoded"
    last = codes.table.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
    return join_codes(df, column, codes, out).withColumn(out, F.coalesce(F.col(out), F.lit(last)).cast("bigint"))


def frequency_codes(df: DataFrame, column: str, limit: int = BROADCAST_VALUES) -> Codes:
    counts = _counts(df, column)
    head = counts.limit(limit + 1).collect()
    if len(head) <= limit:
        rows = sum(r["n"] for r in head)
        table = df.sparkSession.createDataFrame([(r["value"], r["n"] / rows) for r in head], "value string, code double")
        return Codes(table, True, ())
    counts = cut_lineage(counts)
    rows = counts.agg(F.sum("n")).first()[0]
    return _large(counts, counts.select("value", (F.col("n") / F.lit(float(rows))).alias("code")), rows)


def frequency_encode(df: DataFrame, column: str, limit: int = BROADCAST_VALUES) -> DataFrame:
    """``{column}_freq_encoded``: share of the value among the known rows; NULL stays NULL."""
    return join_codes(df, column, frequency_codes(df, column, limit), f"{column}_freq_encoded")


def adaptive_method(df: DataFrame, column: str) -> str:
    """One-hot up to 5 distinct values, label up to 50, frequency above; looks at no more than 51 values."""
    few = df.select(col(column)).where(col(column).isNotNull()).distinct().limit(51).count()
    return "one_hot" if few <= 5 else "label_encode" if few <= 50 else "frequency_encode"


def encode(df: DataFrame, column: str, method: str | None = None, limit: int | None = None) -> DataFrame:
    """``limit`` bounds the columns of a one-hot encoding."""
    chosen = method if method in ("one_hot", "label_encode", "frequency_encode") else adaptive_method(df, column)
    if chosen == "one_hot":
        return one_hot(df, column, limit=limit)
    return label_encode(df, column) if chosen == "label_encode" else frequency_encode(df, column)
