"""Check a table after a stage and recommend operations for what is left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from scour.functions.columns import col, is_numeric, is_string, known, string_columns
from scour.operators.categories import similar_pairs
from scour.operators.duplicates import duplicate_census
from scour.operators.impute import null_counts
from scour.operators.outliers import count_outside, iqr_bounds
from scour.plans.stages import STAGES, Entry

CHECK_SCHEMA = """
check string, column string, status string, observed double, expected string, recommended_operation string, recommended_method string
"""


@dataclass(frozen=True)
class Check:
    check: str
    column: str
    status: str
    observed: float | None
    expected: str
    operation: str | None = None
    method: str | None = None


def _judge(check: str, column: str, ok: bool, observed, expected: str, operation: str, method: str | None = None) -> Check:
    value = None if observed is None else float(observed)
    return Check(check, column, "passed" if ok else "failed", value, expected, None if ok else operation, None if ok else method)


def check_missing(df: DataFrame) -> list[Check]:
    return [
        _judge("missing_values", c, n == 0, n, "0", "handle_missing_values", "median" if is_numeric(df, c) else "mode")
        for c, n in null_counts(df).items()
    ]


def check_duplicates(df: DataFrame) -> list[Check]:
    excess = duplicate_census(df).first()["excess"]
    return [_judge("duplicates", "global", excess == 0, excess, "0", "remove_duplicates")]


def check_outliers(df: DataFrame, names: Sequence[str] | None = None) -> list[Check]:
    counted = count_outside(df, iqr_bounds(df, names))
    return [_judge("outliers", c, n == 0, n, "0", "handle_outliers", "isolation_forest") for c, (n, _, _) in counted.items()]


def check_spelling(df: DataFrame, names: Sequence[str] | None = None) -> list[Check]:
    names = string_columns(df) if names is None else list(names)
    if not names:
        return []
    found = {r["column"]: r["n"] for r in similar_pairs(df, names).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [_judge("similar_values", c, not found.get(c), found.get(c, 0), "0", "handle_inconsistencies") for c in names]


def validate_cleaning(df: DataFrame, spelling: bool = True) -> list[Check]:
    checks = check_missing(df) + check_duplicates(df) + check_outliers(df)
    return checks + check_spelling(df) if spelling else checks


def check_feature(df: DataFrame, name: str) -> Check:
    """The column exists, is not all NULL, and is not constant over more than one row."""
    operation = "create_new_feature"
    if name not in df.columns:
        return _judge("feature_exists", name, False, 0, "column present", operation)
    c = known(name, df)
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    if row["n"] == 0:
        return _judge("feature_not_null", name, False, 0, "some known value", operation)
    varied = row["rows"] <= 1 or row["lo"] != row["hi"]
    return _judge("feature_varies", name, varied, row["n"], "more than one value", operation)


def check_shrunk(before: int, after: int) -> Check:
    return _judge("aggregation_shrinks", "global", after < before, after, f"less than {before} rows", "aggregate")


def check_scaled(df: DataFrame, name: str, method: str) -> Check:
    c = known(name, df)
    if method == "min_max_scaler":
        row = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        ok = row["lo"] is not None and row["lo"] >= -0.01 and row["hi"] <= 1.01
        return _judge("scaled_range", name, ok, row["hi"], "between 0 and 1", "scale_normalize", method)
    row = df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).first()
    ok = row["std"] is not None and abs(row["mean"]) < 0.01 and abs(row["std"] - 1) < 0.01
    return _judge("scaled_distribution", name, ok, row["std"], "mean 0, deviation 1", "scale_normalize", method)


def check_binned(df: DataFrame, name: str, bins: int | Sequence | None) -> list[Check]:
    operation = "discretize_bin"
    if name not in df.columns:
        return [_judge("bin_exists", name, False, 0, "column present", operation)]
    out = [_judge("bin_type", name, not is_numeric(df, name), None, "text labels", operation)]
    if isinstance(bins, int):
        n = df.agg(F.count_distinct(col(name))).first()[0]
        out.append(_judge("bin_count", name, n == bins, n, str(bins), operation))
    return out


def check_text(df: DataFrame, name: str, method: str) -> list[Check]:
    if name not in df.columns or not is_string(df, name):
        return [_judge("text_exists", name, False, 0, "text column present", "text_processing", method)]
    out = [_judge("text_exists", name, True, 1, "text column present", "text_processing", method)]
    if method == "lowercase":
        n = df.agg(F.count_if(col(name) != F.lower(col(name)))).first()[0]
        out.append(_judge("text_lowercase", name, n == 0, n, "0", "text_processing", method))
    return out


def check_encoded(df: DataFrame, column: str, method: str) -> list[Check]:
    """Schema only: no job runs."""
    operation = "encode_categorical"
    flags = (T.NumericType, T.BooleanType)
    if method == "one_hot":
        made = [f for f in df.schema if f.name.startswith(f"{column}_") and isinstance(f.dataType, flags)]
        return [
            _judge("one_hot_original_dropped", column, column not in df.columns, None, "column gone", operation, method),
            _judge("one_hot_columns", column, bool(made), len(made), "at least 1", operation, method),
        ]
    name = f"{column}_encoded" if method == "label_encode" else f"{column}_freq_encoded"
    ok = name in df.columns and is_numeric(df, name)
    return [_judge("encoded_column", name, ok, None, "numeric column present", operation, method)]


def validate_changes(df: DataFrame, log: Sequence[Entry], rows_before: int | None = None) -> list[Check]:
    """Checks for the modification and transformation operations that were run, from their log."""
    out: list[Check] = []
    for e in log:
        if e.status != "completed":
            continue
        target = e.params.get("target", e.column)
        if e.operation == "create_new_feature":
            out.append(check_feature(df, e.column))
        elif e.operation == "aggregate" and rows_before is not None:
            out.append(check_shrunk(rows_before, df.count()))
        elif e.operation == "scale_normalize" and target in df.columns and is_numeric(df, target):
            out.append(check_scaled(df, target, e.details))
        elif e.operation == "discretize_bin":
            out += check_binned(df, e.column, e.params.get("bins"))
        elif e.operation == "text_processing":
            out += check_text(df, e.column, e.method or "")
        elif e.operation == "encode_categorical":
            out += check_encoded(df, target, e.details)
    return out


def checks_frame(spark: SparkSession, checks: Sequence[Check]) -> DataFrame:
    return spark.createDataFrame([astuple(c) for c in checks], CHECK_SCHEMA)


def passed(checks: Sequence[Check]) -> bool:
    return all(c.status == "passed" for c in checks)


def recommendations(checks: Sequence[Check], stage: str) -> Mapping[str, dict[str, list[dict]]]:
    """What to run next: ``{stage key: {target: [ops]}}``."""
    out: dict[str, list[dict]] = {}
    for c in checks:
        if c.status == "failed":
            op = {"operation": c.operation, "reason": f"{c.check}: observed {c.observed}, expected {c.expected}"}
            out.setdefault(c.column, []).append(op | ({"method": c.method} if c.method else {}))
    return {STAGES[stage]: out}
