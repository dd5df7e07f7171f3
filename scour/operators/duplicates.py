"""Duplicate rows: removal and census."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from scour.functions.columns import col


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """One row per distinct row, or the first row per distinct ``subset`` by an explicit order.

    The first row is a minimum over whole rows, which combines before the shuffle, so a
    key shared by a third of the table does not pile up in one task. Columns not named in
    ``order`` break ties, NULL first, so the result never depends on the file order.
    """
    if not subset:
        return df.dropDuplicates()
    missing = [c for c in [*subset, *(order or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    named = [c for c in order or [] if c not in subset]
    rest = named + [c for c in df.columns if c not in subset and c not in named]
    if not rest:
        return df.select(*[col(c) for c in subset]).dropDuplicates()
    first = F.min(F.struct(*[col(c) for c in rest])).alias("__first")
    kept = df.groupBy(*[col(c) for c in subset]).agg(first)
    return kept.select(*[col(c) if c in subset else F.col("__first")[c].alias(c) for c in df.columns])


def duplicate_census(df: DataFrame) -> DataFrame:
    """One row: members of duplicate groups, and rows in excess of the first of each group."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    return groups.agg(
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).cast("bigint").alias("members"),
        F.coalesce(F.sum(n - 1), F.lit(0)).cast("bigint").alias("excess"),
    )


def duplicate_sample(df: DataFrame, k: int = 5) -> DataFrame:
    """The k smallest repeated rows, each with its number of copies."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))
    return groups.where("copies > 1").orderBy(*[col(c) for c in df.columns]).limit(k)
