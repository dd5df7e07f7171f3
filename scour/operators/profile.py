"""Table summary and per-column profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from scour.functions.columns import numeric_columns
from scour.functions.stats import distinct_counts, exact_quantiles, moments
from scour.operators.schema import sample_values

PROFILE_SCHEMA = """
column string, dtype string, rows bigint, nulls bigint, distinct bigint, mean double, std double, skew double,
min double, q1 double, median double, q3 double, max double
"""


def flat_columns(df: DataFrame) -> list[str]:
    """Columns with comparable cells; nested ones are left out of the statistics."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


def profile_rows(df: DataFrame) -> list[dict]:
    """All statistics of all columns from a handful of shared aggregates."""
    names = flat_columns(df)
    numeric = [c for c in numeric_columns(df) if c in names]
    stats = moments(df, numeric, null_counts=names)
    distinct = distinct_counts(df, names)
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in numeric})
    out = []
    for name in names:
        s, q = stats[name], quartiles.get(name, [None] * 3)
        out.append(
            {"column": name, "dtype": df.schema[name].dataType.simpleString(), "rows": s["rows"], "nulls": s["nulls"], "distinct": distinct[name]}
            | {k: s.get(k) for k in ("mean", "std", "skew", "min", "max")}
            | {"q1": q[0], "median": q[1], "q3": q[2]}
        )
    return out


def profile(df: DataFrame) -> DataFrame:
    """One row per column."""
    order = [f.split()[0] for f in PROFILE_SCHEMA.split(",")]
    rows = [tuple(r[c] for c in order) for r in profile_rows(df)]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def summary(df: DataFrame, k: int = 3) -> DataFrame:
    """One row per column: type, table size, and its first k values in sorted order."""
    spark = df.sparkSession
    rows = df.count()
    schema = "position int, column string, dtype string, rows bigint, columns bigint"
    base = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), rows, len(df.columns)) for i, f in enumerate(df.schema)], schema
    )
    if not df.columns:
        return base.withColumn("samples", F.lit(None).cast("array<string>"))
    flat = flat_columns(df)
    taken = sample_values(df.select(*[F.col(f"`{c}`") for c in flat]), k)
    samples = taken.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("s"))
    samples = samples.select("column", F.col("s.value").alias("samples"))
    return base.join(samples, "column", "left").select(*base.columns, "samples").orderBy("position")


def summary_text(df: DataFrame, name: str, k: int = 3) -> str:
    """The summary as readable lines."""
    lines = [f"Dataset: {name}"]
    for i, r in enumerate(summary(df, k).collect()):
        if i == 0:
            lines.append(f"Rows: {r['rows']}, Columns: {r['columns']}")
        lines.append(f"- {r['column']} ({r['dtype']}): {', '.join(r['samples'] or [])}")
    return "\n".join(lines)
