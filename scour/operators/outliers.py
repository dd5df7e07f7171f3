"""Outliers: quartile fences, z-scores, isolation forest, and the report of what is left."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scour.functions.columns import col, known, numeric_columns, with_columns
from scour.functions.forest import SAMPLE, TREES, AnomalySteps, fit_many
from scour.functions.stats import exact_quantiles, moments

FENCE = 1.5
FAR = 3.0


@dataclass(frozen=True)
class Bounds:
    """Quartiles of one column and the fences 1.5 interquartile ranges outside them."""

    column: str
    q1: float | None
    q3: float | None

    @property
    def lower(self) -> float | None:
        return None if self.q1 is None else self.q1 - FENCE * (self.q3 - self.q1)

    @property
    def upper(self) -> float | None:
        return None if self.q1 is None else self.q3 + FENCE * (self.q3 - self.q1)

    def outside(self, c: Column) -> Column:
        if self.q1 is None:
            return F.lit(False)
        return (c < F.lit(self.lower)) | (c > F.lit(self.upper))


def iqr_bounds(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, Bounds]:
    """Exact fences of several numeric columns, fitted together."""
    names = numeric_columns(df) if names is None else list(names)
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in names})
    return {c: Bounds(c, *quartiles[c]) for c in names}


def count_outside(df: DataFrame, bounds: dict[str, Bounds]) -> dict[str, tuple[int, int, int]]:
    """(outliers, known values, rows) per column, in one aggregate."""
    if not bounds:
        return {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, b in enumerate(bounds.values()):
        c = known(b.column, df)
        aggs += [F.count_if(b.outside(c)).alias(f"out{i}"), F.count(c).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    return {name: (row[f"out{i}"], row[f"n{i}"], row["rows"]) for i, name in enumerate(bounds)}


def outlier_census(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, fences, outlier count and share per numeric column."""
    bounds = iqr_bounds(df, names)
    counted = count_outside(df, bounds)
    rows = [
        (c, b.q1, b.q3, b.lower, b.upper, counted[c][0], counted[c][0] / counted[c][1] if counted[c][1] else 0.0)
        for c, b in bounds.items()
    ]
    schema = "column string, q1 double, q3 double, lower double, upper double, outliers bigint, ratio double"
    return df.sparkSession.createDataFrame(rows, schema)


def clip(df: DataFrame, bounds: Iterable[Bounds]) -> DataFrame:
    """Clamp values to the fences; NULL stays NULL and the column keeps its type unless a fence needs a fraction."""
    exprs = {}
    for b in bounds:
        if b.q1 is None or b.column not in df.columns:
            continue
        c = known(b.column, df).cast("double")
        exprs[b.column] = F.when(c < F.lit(b.lower), F.lit(b.lower)).when(c > F.lit(b.upper), F.lit(b.upper)).otherwise(c)
    return with_columns(df, exprs)


def iqr_clip(df: DataFrame, column: str) -> DataFrame:
    return clip(df, iqr_bounds(df, [column]).values())


@dataclass(frozen=True)
class ZScale:
    column: str
    mean: float | None
    std: float | None

    def far(self, c: Column) -> Column:
        if self.mean is None or not self.std:
            return F.lit(False)
        return F.abs((c - F.lit(self.mean)) / F.lit(self.std)) > FAR


def fit_zscale(df: DataFrame, column: str) -> ZScale:
    s = moments(df, [column])[column]
    return ZScale(column, s["mean"], s["std_pop"])


def remove_far(df: DataFrame, scale: ZScale, mode: str = "nullify") -> DataFrame:
    """Values more than three population deviations from the mean: blank the cell, or drop the row."""
    c = known(scale.column, df)
    far = F.coalesce(scale.far(c), F.lit(False))
    if mode == "drop_rows":
        return df.where(~far)
    if mode != "nullify":
        raise ValueError(f"unknown mode {mode}")
    return with_columns(df, {scale.column: F.when(~far, c)})


def zscore_removal(df: DataFrame, column: str, mode: str = "nullify") -> DataFrame:
    return remove_far(df, fit_zscale(df, column), mode)


@dataclass(frozen=True)
class ForestFit:
    column: str
    steps: AnomalySteps
    median: float | None


def fit_forest(df: DataFrame, column: str, contamination: float = 0.1, seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> ForestFit:
    """A forest of ``trees`` trees over ``sample`` values each, as published; every row is scored by it."""
    median = exact_quantiles(df, {column: [0.5]})[column][0]
    return ForestFit(column, fit_many(df, {column: (contamination, seed)}, trees, sample)[column][0], median)


def replace_anomalies(df: DataFrame, fit: ForestFit) -> DataFrame:
    """Anomalous values become the column median; NULL is left alone."""
    c = known(fit.column, df).cast("double")
    if fit.median is None:
        return df
    return with_columns(df, {fit.column: F.when(fit.steps.anomalous(c), F.lit(fit.median)).otherwise(c)})


def isolation_forest(df: DataFrame, column: str, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    return replace_anomalies(df, fit_forest(df, column, contamination, seed))


def handle_outliers(df: DataFrame, wanted: dict[str, dict]) -> tuple[DataFrame, dict[str, int]]:
    """Treat several columns, each by the method of its operation, and count the values touched.

    The fits share their jobs, so their number does not grow with the columns. A column without outliers
    outside its fences is left alone, type included.
    """
    forests = {c: op for c, op in wanted.items() if op.get("method") == "isolation_forest"}
    scales = {c: op for c, op in wanted.items() if op.get("method") == "z_score_removal"}
    clips = [c for c in wanted if c not in forests and c not in scales]
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in clips} | {c: [0.5] for c in forests})
    bounds = {c: Bounds(c, *quartiles[c]) for c in clips}
    stats = moments(df, list(scales)) if scales else {}
    far = {c: ZScale(c, stats[c]["mean"], stats[c]["std_pop"]) for c in scales}
    grown = fit_many(df, {c: (op.get("contamination", 0.1), op.get("seed", 42)) for c, op in forests.items()})
    hits = {c: n for c, (_, n) in grown.items()}
    tests = {c: b.outside(known(c, df)) for c, b in bounds.items()} | {c: z.far(col(c).cast("double")) for c, z in far.items()}
    if tests:
        row = df.agg(*[F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests.values())]).first()
        hits |= {c: row[f"n{i}"] for i, c in enumerate(tests)}
    for c, op in scales.items():
        if op.get("mode", "nullify") != "nullify":
            df = remove_far(df, far[c], op["mode"])
    df = clip(df, [b for c, b in bounds.items() if hits[c]])
    exprs = {}
    for c, (steps, _) in grown.items():
        v = known(c, df).cast("double")
        if quartiles[c][0] is not None:
            exprs[c] = F.when(steps.anomalous(v), F.lit(quartiles[c][0])).otherwise(v)
    for c, op in scales.items():
        if op.get("mode", "nullify") == "nullify":
            exprs[c] = F.when(~F.coalesce(far[c].far(known(c, df)), F.lit(False)), known(c, df))
    return with_columns(df, exprs), hits


def outlier_report(df: DataFrame, names: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(column, outliers, sample): columns with values outside their fences and the k smallest of them."""
    bounds = {c: b for c, b in iqr_bounds(df, names).items() if b.q1 is not None}
    schema = "column string, outliers bigint, sample array<double>"
    if not bounds:
        return df.sparkSession.createDataFrame([], schema)
    cells = [
        F.struct(F.lit(c).alias("column"), F.when(b.outside(known(c, df)), col(c).cast("double")).alias("v"))
        for c, b in bounds.items()
    ]
    outside = (
        df.select(F.explode(F.array(*cells)).alias("x"))
        .where(F.col("x.v").isNotNull())
        .groupBy(F.col("x.column").alias("column"), F.col("x.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = outside.groupBy("column").agg(F.sum("n").alias("outliers"))
    order = Window.partitionBy("column").orderBy("v")
    first = outside.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    copies = first.select("column", F.explode(F.array_repeat("v", F.least(F.col("n"), F.lit(k)).cast("int"))).alias("v"))
    samples = copies.groupBy("column").agg(F.slice(F.sort_array(F.collect_list("v")), 1, k).alias("sample"))
    return totals.join(samples, "column")
