"""Projection, typing and sampling of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scour.functions.columns import INTEGRAL, col, dtype, known, string_columns, with_columns
from scour.functions.stats import distinct_counts

# Declared type names and their meaning; other names leave the column as it is.
DECLARED = {
    "datetime": "timestamp", "timestamp": "timestamp",
    "integer": "bigint", "int": "bigint",
    "float": "double", "double": "double",
    "boolean": "boolean", "bool": "boolean",
    "string": "string", "object": "string",
}

WIDTHS = [("tinyint", 7), ("smallint", 15), ("int", 31)]


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep only the named columns that exist; an empty list keeps everything."""
    kept = [c for c in names if c in df.columns]
    return df.select(*[col(c) for c in kept]) if kept else df


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def derive(df: DataFrame, formula: str | Column, name: str = "engineered_feature") -> DataFrame:
    """A new column from a SQL expression over the row."""
    return with_columns(df, {name: F.expr(formula) if isinstance(formula, str) else formula})


def _converted(df: DataFrame, name: str, kind: str) -> tuple[Column, Column | None]:
    """The converted column and the count of values that make the conversion fail as a whole."""
    c = col(name)
    number = c.try_cast("double") if not isinstance(dtype(df, name), T.BooleanType) else c.cast("int").cast("double")
    if kind == "timestamp":
        out = c.try_cast("timestamp") if not isinstance(dtype(df, name), (T.TimestampType, T.TimestampNTZType)) else c
        return out, F.count_if(c.isNotNull() & out.isNull())
    if kind == "bigint":
        whole = F.when(number.isNotNull() & ~F.isnan(number), number)
        if isinstance(dtype(df, name), INTEGRAL):
            return c.cast("bigint"), None
        text = F.coalesce(c.cast("string").try_cast("bigint"), whole.try_cast("bigint"))
        return F.when(whole.isNotNull(), text), F.count_if(whole != F.floor(whole))
    if kind == "double":
        return F.when(~F.isnan(number), number), None
    if kind == "boolean":
        out = c.try_cast("boolean")
        return out, F.count_if(c.isNotNull() & out.isNull())
    return c.cast("string"), None


def standardise_types(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Convert columns to declared types; one aggregate finds the columns that cannot be converted.

    Unparsable numbers become NULL. A date, flag or whole-number column with a value that does not fit stays unchanged and is named
    in the returned warnings.
    """
    plans = {
        name: _converted(df, name, DECLARED[kind])
        for name, kind in types.items()
        if name in df.columns and kind in DECLARED
    }
    checks = {name: check for name, (_, check) in plans.items() if check is not None}
    bad = df.agg(*[c.alias(n) for n, c in checks.items()]).first().asDict() if checks else {}
    warnings = {n: f"{k} values do not fit type {types[n]}; column unchanged" for n, k in bad.items() if k}
    return with_columns(df, {n: e for n, (e, _) in plans.items() if n not in warnings}), warnings


def compact_types(df: DataFrame, floats: bool = False) -> DataFrame:
    """Cast whole-number columns to the narrowest type that holds their range; optionally doubles to float (lossy)."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, INTEGRAL)]
    exprs: dict[str, Column] = {}
    if ints:
        row = df.agg(*[g(col(c)).alias(f"{t}{i}") for i, c in enumerate(ints) for t, g in (("lo", F.min), ("hi", F.max))]).first()
        for i, name in enumerate(ints):
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if lo is None:
                continue
            fits = [t for t, bits in WIDTHS if -(2**bits) <= lo and hi < 2**bits]
            exprs[name] = col(name).cast(fits[0] if fits else "bigint")
    if floats:
        exprs |= {f.name: col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return with_columns(df, exprs)


def categorical_flags(df: DataFrame) -> dict[str, dict]:
    """Per text column: rows, distinct values and whether few values repeat often."""
    names = string_columns(df)
    counts = distinct_counts(df, names)
    rows = df.count()
    return {
        name: {"rows": rows, "distinct": counts[name], "categorical": rows > 0 and counts[name] / rows < 0.5 and counts[name] < 50}
        for name in names
    }


def tag_categories(df: DataFrame) -> DataFrame:
    """Mark text columns as categorical in the column metadata."""
    for name, flag in categorical_flags(df).items():
        df = df.withMetadata(name, {"categorical": flag["categorical"]})
    return df


def sample_values(df: DataFrame, k: int = 3) -> DataFrame:
    """The k smallest distinct known values of each column, as text: (column, position, value).

    One wide aggregate a value: the smallest above the one before. Nothing is shuffled but one row a task.
    """
    texts = {c: known(c, df).cast("string") for c in df.columns}
    found: dict[str, list[str]] = {c: [] for c in texts}
    for turn in range(k):
        more = [c for c in texts if len(found[c]) == turn]
        if not more:
            break
        row = df.agg(*[F.min(F.when(texts[c] > F.lit(found[c][-1]), texts[c]) if turn else texts[c]).alias(f"v{i}") for i, c in enumerate(more)]).first()
        for i, c in enumerate(more):
            if row[f"v{i}"] is not None:
                found[c].append(row[f"v{i}"])
    rows = [(c, i + 1, v) for c, values in found.items() for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "column string, position int, value string").select("column", "value", "position")


def head_rows(df: DataFrame, order: Sequence[str], n: int = 5, width: int | None = None) -> DataFrame:
    """The first n rows by an explicit order, texts cut to ``width`` characters for display."""
    top = df.orderBy(*[col(c) for c in order]).limit(n)
    if width is None:
        return top
    return with_columns(top, {c: F.substring(col(c), 1, width) for c in string_columns(df)})


def drop_missing_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows in which the column is known."""
    return df.where(known(name, df).isNotNull())
