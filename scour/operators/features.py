"""Derived features: grouped aggregates, bins and scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from scour.functions.columns import col, divide, dtype, known, with_columns
from scour.functions.stats import exact_quantiles, grouped_quantile, moments, sample_skew

STRONG_SKEW = 1.0

# The edges and labels of the two ready-made groupings.
AGE_EDGES = [0, 18, 35, 55, 100]
AGE_LABELS = ["0-18", "19-35", "36-55", "56+"]
BMI_EDGES = [0, 18.5, 24.9, 29.9, 34.9, 39.9, 100]
BMI_LABELS = [
    "Underweight", "Normal weight", "Overweight", "Obesity Class I", "Obesity Class II", "Obesity Class III",
]


def _total(c: Column, kind: T.DataType) -> Column:
    zero = F.lit(0).cast("double" if isinstance(kind, (T.FloatType, T.DoubleType)) else "bigint")
    return F.coalesce(F.sum(c), zero)


def aggregate_column(df: DataFrame, name: str, method: str, order: Sequence[str] | None = None) -> Column:
    """The aggregate expression of one method; ``first``/``last`` need an order and skip NULL."""
    c = known(name, df)
    simple = {
        "sum": lambda: _total(c, dtype(df, name)),
        "mean": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "count": lambda: F.count(c),
        "size": lambda: F.count(F.lit(1)),
        "nunique": lambda: F.count_distinct(c),
        "std": lambda: F.stddev_samp(c),
        "var": lambda: F.var_samp(c),
        "prod": lambda: F.coalesce(F.product(c.cast("double")), F.lit(1.0)),
        "skew": lambda: sample_skew(c.cast("double")),
        "sem": lambda: F.stddev_samp(c) / F.sqrt(F.count(c)),
        "any": lambda: F.coalesce(F.bool_or(c.cast("boolean")), F.lit(False)),
        "all": lambda: F.coalesce(F.bool_and(c.cast("boolean")), F.lit(True)),
    }
    if method in simple:
        return simple[method]()
    if method in ("first", "last"):
        if not order:
            raise ValueError(f"method {method} needs an order")
        pick = F.min_by if method == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), F.struct(*[col(o) for o in order])))
    raise ValueError(f"unknown aggregation method {method!r}")


def aggregate(df: DataFrame, keys: str | Sequence[str], target: str, method: str, order: Sequence[str] | None = None) -> DataFrame:
    """Group by ``keys`` (rows with a NULL key are left out) and reduce ``target``, which keeps its name."""
    names = [k.strip() for k in keys.split(",")] if isinstance(keys, str) else list(keys)
    known_keys = df.where(_all_known(df, names))
    if method == "median":
        return grouped_quantile(known_keys, names, target, 0.5, target)
    return known_keys.groupBy(*[col(k) for k in names]).agg(aggregate_column(df, target, method, order).alias(target))


def _all_known(df: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & known(n, df).isNotNull()
    return cond


@dataclass(frozen=True)
class Bins:
    """Sorted edges, a label per gap, and which side of a gap is closed."""

    edges: tuple[float, ...]
    labels: tuple[str, ...]
    right: bool = True
    include_lowest: bool = False

    def label(self, c: Column) -> Column:
        """The label of the gap a value falls in, the first whose upper edge is not passed; outside or NULL gives NULL."""
        low = F.lit(self.edges[0])
        out = F.when(c <= low if self.right and not self.include_lowest else c < low, F.lit(None).cast("string"))
        for high, label in zip(self.edges[1:], self.labels):
            out = out.when(c <= F.lit(high) if self.right else c < F.lit(high), F.lit(label))
        return out


def _shortened(x: float, digits: int) -> float:
    """``digits`` decimals, counted from the first non-zero one for values below 1."""
    if x == 0 or not math.isfinite(x):
        return x
    return round(x, digits if abs(x) >= 1 else digits - 1 - math.floor(math.log10(abs(x))))


def _interval_labels(edges: Sequence[float], include_lowest: bool, whole: bool) -> tuple[str, ...]:
    """Texts such as ``(1.0, 2.5]``: three decimals, or as many as keep the edges apart.

    With the lowest edge inside, its text is moved down by one unit of the last decimal.
    """
    digits = 3
    while digits < 20 and len({_shortened(e, digits) for e in edges}) < len(edges):
        digits += 1
    shown = [_shortened(e, digits) for e in edges]
    if include_lowest:
        shown[0] = _shortened(shown[0] - 10**-digits, max(digits, 3))
    texts = [str(int(e)) if whole and not include_lowest else str(float(e)) for e in shown]
    return tuple(f"({a}, {b}]" for a, b in zip(texts, texts[1:]))


def make_bins(edges: Sequence[float], labels: Sequence[str] | None, right: bool = True, include_lowest: bool = False) -> Bins:
    whole = all(isinstance(e, int) for e in edges)
    edges = [float(e) for e in edges]
    if any(b <= a for a, b in zip(edges, edges[1:])) or len(edges) < 2:
        raise ValueError("bin edges must increase")
    if labels is not None and len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    names = tuple(labels) if labels is not None else _interval_labels(edges, include_lowest, whole)
    return Bins(tuple(edges), names, right, include_lowest)


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """Evenly spaced edges; the lowest one is moved 0.1 % of the range down so the minimum is inside."""
    if low == high:
        pad = 0.001 * abs(low) if low else 0.001
        low, high = low - pad, high + pad
        return [low + (high - low) * i / bins for i in range(bins)] + [high]
    step = (high - low) / bins
    edges = [low + step * i for i in range(bins)] + [high]
    return [low - (high - low) * 0.001, *edges[1:]]


def fit_equal_width(df: DataFrame, column: str, bins: int | Sequence[float], labels: Sequence[str] | None = None, include_lowest: bool = True) -> Bins:
    if not isinstance(bins, int):
        return make_bins(bins, labels, include_lowest=include_lowest)
    if bins < 1:
        raise ValueError("need at least one bin")
    row = df.agg(F.min(known(column, df)).alias("lo"), F.max(known(column, df)).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError(f"column {column} holds no value")
    return make_bins(equal_width_edges(float(row["lo"]), float(row["hi"]), bins), labels, include_lowest=include_lowest)


def fit_equal_frequency(df: DataFrame, column: str, bins: int, labels: Sequence[str] | None = None) -> Bins:
    """Edges at the interpolated quantiles; equal edges collapse, so ties share a bin."""
    edges = exact_quantiles(df, {column: [i / bins for i in range(bins + 1)]})[column]
    if edges[0] is None:
        raise ValueError(f"column {column} holds no value")
    return make_bins(sorted(set(edges)), labels, include_lowest=True)


def discretise(df: DataFrame, column: str, bins: Bins, name: str | None = None) -> DataFrame:
    return with_columns(df, {name or f"{column}_binned": bins.label(known(column, df).cast("double"))})


def age_groups(df: DataFrame, column: str = "age", name: str = "engineered_feature") -> DataFrame:
    return discretise(df, column, make_bins(AGE_EDGES, AGE_LABELS, right=False), name)


def bmi_classes(df: DataFrame, column: str = "bmi", name: str = "engineered_feature") -> DataFrame:
    return discretise(df, column, make_bins(BMI_EDGES, BMI_LABELS), name)


@dataclass(frozen=True)
class Scale:
    """value -> (value - shift) / width, fitted once."""

    column: str
    method: str
    shift: float | None
    width: float | None

    def apply(self, df: DataFrame) -> DataFrame:
        c = known(self.column, df).cast("double")
        shift, width = (F.lit(v).cast("double") for v in (self.shift, self.width))
        return with_columns(df, {self.column: divide(c - shift, width)})


def fit_scale(df: DataFrame, column: str, method: str | None = None) -> Scale:
    """Min-max or standard scaling; any other method chooses min-max for strongly skewed columns."""
    s = moments(df, [column])[column]
    if method not in ("min_max_scaler", "standard_scaler"):
        skewed = s["skew"] is not None and abs(s["skew"]) > STRONG_SKEW
        method = "min_max_scaler" if skewed else "standard_scaler"
    if method == "min_max_scaler":
        return Scale(column, method, s["min"], None if s["min"] is None else s["max"] - s["min"])
    return Scale(column, method, s["mean"], s["std"])


def scale(df: DataFrame, column: str, method: str | None = None) -> DataFrame:
    return fit_scale(df, column, method).apply(df)
