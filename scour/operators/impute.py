"""Missing values: census, per-column fills, and the whole-table imputation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scour.functions.columns import dtype, is_numeric, known, with_columns
from scour.functions.stats import approximate_quantiles, exact_quantiles, modes, moments
from scour.operators.outliers import Bounds, count_outside

ALIASES = {"mean_imputation": "mean", "median_imputation": "median", "mode_imputation": "mode"}
MANY_OUTLIERS = 0.05
STRONG_SKEW = 1.0


@dataclass(frozen=True)
class Fill:
    """A fitted imputation: what stands in for NULL in one column."""

    column: str
    method: str
    value: object
    nulls: int


def null_counts(df: DataFrame) -> dict[str, int]:
    if not df.columns:
        return {}
    row = df.agg(*[F.count_if(known(c, df).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return {c: row[i] for i, c in enumerate(df.columns)}


def null_census(df: DataFrame) -> DataFrame:
    """(column, nulls), from one aggregate."""
    return df.sparkSession.createDataFrame(list(null_counts(df).items()), "column string, nulls bigint")


def asked_method(df: DataFrame, name: str, method: str | None, adaptive: str) -> str | None:
    """The method that needs no statistic to choose: mode for non-numeric columns, a known name, else None."""
    if not is_numeric(df, name):
        return "mode"
    if adaptive == "skew":
        method = ALIASES.get(method, method)
        return method if method in ("mean", "median", "mode") else None
    return method if method in ("mean", "median") else None


def fit_fills(
    df: DataFrame,
    methods: dict[str, str | None] | None = None,
    columns: Sequence[str] | None = None,
    adaptive: str = "outliers",
    exact: bool = True,
) -> list[Fill]:
    """Fit a fill for every column with missing values (or the given ones): few aggregates for all columns together.

    Numeric columns without a method get the median when more than 5 % of their values are outliers
    (``adaptive='outliers'``) or the skew exceeds 1 (``'skew'``), else the mean.
    """
    flat = [c for c in columns or df.columns if not isinstance(dtype(df, c), (T.ArrayType, T.MapType, T.StructType))]
    asked = {c: asked_method(df, c, (methods or {}).get(c), adaptive) for c in flat}
    moment = moments(df, [c for c in flat if asked[c] in (None, "mean")], null_counts=flat)
    names = [c for c in flat if moment[c]["nulls"]]
    chosen = {c: asked[c] for c in names}
    unsure = [c for c in names if chosen[c] is None]
    if adaptive == "skew":
        for c in unsure:
            skew = moment[c]["skew"]
            chosen[c] = "median" if skew is not None and abs(skew) > STRONG_SKEW else "mean"
    wanted = {c: [0.5] for c in names if chosen[c] == "median"} | {c: [0.25, 0.5, 0.75] for c in names if chosen[c] is None}
    quantiles = (exact_quantiles if exact else approximate_quantiles)(df, wanted)
    medians = {c: q[len(q) // 2] for c, q in quantiles.items()}
    fences = {c: Bounds(c, quantiles[c][0], quantiles[c][2]) for c in names if chosen[c] is None}
    for c, (n, known_rows, _) in count_outside(df, fences).items():
        chosen[c] = "median" if known_rows and n / known_rows > MANY_OUTLIERS else "mean"
    values: dict[str, object] = {c: moment[c]["mean"] if chosen[c] == "mean" else medians.get(c) for c in names}
    values |= modes(df, [c for c in names if chosen[c] == "mode"])
    return [Fill(c, chosen[c], values[c], moment[c]["nulls"]) for c in names]


def apply_fills(df: DataFrame, fills: Sequence[Fill]) -> DataFrame:
    """Put the fitted values in place of NULL; a column without any known value stays NULL."""
    exprs = {}
    for f in fills:
        if f.column not in df.columns or f.value is None:
            continue
        c = known(f.column, df)
        if f.method in ("mean", "median"):
            exprs[f.column] = F.coalesce(c.cast("double"), F.lit(float(f.value)))
        else:
            exprs[f.column] = F.coalesce(c, F.lit(f.value).cast(dtype(df, f.column)))
    return with_columns(df, exprs)


def impute(df: DataFrame, column: str, method: str | None = None, **options) -> DataFrame:
    """Fit and apply a fill for one column."""
    return apply_fills(df, fit_fills(df, {column: method}, [column], **options))


def impute_table(df: DataFrame, methods: dict[str, str | None] | None = None, **options) -> DataFrame:
    """Fill every column with missing values, each by its own method or adaptively."""
    return apply_fills(df, fit_fills(df, methods, **options))


def fills_frame(spark: SparkSession, fills: Sequence[Fill]) -> DataFrame:
    rows = [(f.column, f.method, None if f.value is None else str(f.value), f.nulls) for f in fills]
    return spark.createDataFrame(rows, "column string, method string, value string, nulls bigint")


