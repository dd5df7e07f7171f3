"""Pivot, unpivot and joins with named tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from scour.functions.columns import col, dtype, known, unique_names
from scour.operators.features import aggregate

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "left_semi": "left_semi", "left_anti": "left_anti"}


def _names(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def pivot(
    df: DataFrame, index: str | Sequence[str], columns: str | Sequence[str], values: str | Sequence[str],
    agg_func: str = "mean", order: Sequence[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """One row per index, one column per sorted value of ``columns``; rows with a NULL key are left out.

    Labels that equal another column's name in any case end in _2, _3 and so on; ``limit`` refuses more labels than that.

    The table is reduced to one row per (index, column value) first, then turned, so
    every aggregate method works and only the small result is reshaped.
    """
    index, columns, values = _names(index), _names(columns), _names(values)
    keys = index + columns
    reduced = [aggregate(df, keys, v, agg_func, order) for v in values]
    table = reduced[0]
    for other in reduced[1:]:
        table = table.join(other, keys)
    filled = F.lit(False)
    for v in values:
        filled = filled | known(v, table).isNotNull()
    label = F.concat_ws("_", *[col(c).cast("string") for c in columns]) if len(columns) > 1 else col(columns[0]).cast("string")
    table = table.where(filled).withColumn("__label", label)
    sort_key = F.min(col(columns[0])) if len(columns) == 1 else F.min(F.struct(*[col(c) for c in columns]))
    found = table.groupBy("__label").agg(sort_key.alias("__key")).orderBy("__key")
    found = (found if limit is None else found.limit(limit + 1)).collect()
    if limit is not None and len(found) > limit:
        raise ValueError(f"pivot would make more than {limit} columns")
    labels = [r["__label"] for r in found]
    turned = table.groupBy(*[col(c) for c in index]).pivot("__label", labels).agg(*[F.max(col(v)).alias(v) for v in values])
    # Columns are renamed by place: labels may differ in case only.
    names = dict(zip([(v, lab) for v in values for lab in labels], unique_names([lab if len(values) == 1 else f"{v}_{lab}" for v in values for lab in labels], index)))
    turned = turned.toDF(*index, *[names[v, lab] for lab in labels for v in values])
    return turned.select(*[col(c) for c in [*index, *names.values()]])


def unpivot(
    df: DataFrame, id_vars: str | Sequence[str] | None = None, value_vars: str | Sequence[str] | None = None,
    var_name: str = "variable", value_name: str = "value",
) -> DataFrame:
    """One row per id and value column, NULL kept; columns of different kinds become text."""
    ids = _names(id_vars or [])
    names = _names(value_vars) if value_vars else [c for c in df.columns if c not in ids]
    kinds = {dtype(df, c).typeName() for c in names}
    numbers = {"byte", "short", "integer", "long", "float", "double"}
    target = None if len(kinds) == 1 else ("double" if kinds <= numbers else "string")
    table = df.select(*[col(c) for c in ids], *[(col(c).cast(target).alias(c) if target else col(c)) for c in names])
    return table.unpivot([col(c) for c in ids], [col(c) for c in names], var_name, value_name)


def merge(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner", null_safe: bool = False, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Equi-join on the named columns. SQL rules by default; ``null_safe`` lets NULL keys meet.

    Other columns that both sides have, in any case, get the suffixes. The optimizer picks broadcast, shuffled hash or
    sort-merge from measured sizes and splits skewed partitions.
    """
    if how not in JOINS:
        raise ValueError(f"unknown join type {how!r}")
    names = _names(on)
    missing = [c for c in names if c not in left.columns or c not in right.columns]
    if missing:
        raise ValueError(f"join columns not found on both sides: {missing}")
    if not how.startswith("left_"):
        both = {c.lower() for c in left.columns if c not in names} & {c.lower() for c in right.columns if c not in names}
        left, right = (
            t.select(*[col(c).alias(c + suffix) if c.lower() in both and c not in names else col(c) for c in t.columns]) for t, suffix in zip((left, right), suffixes)
        )
    if not null_safe:
        return left.join(right, names, JOINS[how])
    twin = right.select(*[col(c).alias(f"__r_{c}") if c in names else col(c) for c in right.columns])
    cond = F.lit(True)
    for c in names:
        cond = cond & col(c).eqNullSafe(col(f"__r_{c}"))
    joined = left.join(twin, cond, JOINS[how])
    if how.startswith("left_"):
        return joined
    keys = [F.coalesce(col(c), col(f"__r_{c}")).alias(c) for c in names]
    rest = [col(c) for c in joined.columns if c not in names and not c.startswith("__r_")]
    return joined.select(*keys, *rest)
