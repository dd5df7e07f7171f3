"""Schema helpers and small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# Unicode white space, as a character-class body valid in Java and RE2 patterns.
SPACE_CLASS = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column, also when its name holds dots or spaces."""
    return F.col(quoted(name))


def dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.NumericType)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def known(name: str, df: DataFrame) -> Column:
    """The column with floating NaN read as NULL, so both count as missing."""
    if isinstance(dtype(df, name), (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(col(name)), None).otherwise(col(name))
    return col(name)


def with_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Replace columns in place and append new ones, in one projection."""
    kept = [exprs[c].alias(c) if c in exprs else col(c) for c in df.columns]
    added = [e.alias(c) for c, e in exprs.items() if c not in df.columns]
    return df.select(*kept, *added)


def stacked(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """(column, value as text) rows of the named columns; no shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), known(c, df).cast("string").alias("value")) for c in names]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.column", "cell.value")


def value_counts(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """(column, value, n) over non-null values. Partial sums run before the shuffle, so a hot value costs one row per task."""
    cells = stacked(df, names).where(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def trimmed(c: Column) -> Column:
    """Strip all leading and trailing Unicode white space."""
    return F.regexp_replace(c, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def unique_names(wanted: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """The names in order; one that equals an earlier or taken name in any case gets _2, _3 and so on."""
    used = {t.lower() for t in taken}
    out = []
    for name in wanted:
        new, n = name, 1
        while new.lower() in used:
            n += 1
            new = f"{name}_{n}"
        used.add(new.lower())
        out.append(new)
    return out


def join_groups(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join on key columns in which NULL meets NULL; ``right`` has one row a group, and one row in all without keys."""
    keys = list(keys)
    if not keys:
        return left.withColumn("__one", F.lit(1)).join(F.broadcast(right.withColumn("__one", F.lit(1))), "__one", how).drop("__one")
    twin = right.select(*[col(c).alias(f"__r_{c}") if c in keys else col(c) for c in right.columns])
    cond = F.lit(True)
    for c in keys:
        cond = cond & col(c).eqNullSafe(col(f"__r_{c}"))
    return left.join(twin, cond, how).drop(*[f"__r_{c}" for c in keys])


def divide(a: Column, b: Column) -> Column:
    """NULL instead of an ANSI error when the divisor is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))
