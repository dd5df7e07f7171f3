"""Suggest a plan from column statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from scour.operators.profile import profile_rows
from scour.plans.stages import STAGES

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
DEFAULT_PLAN = ["cleaning", "modification", "transformation"]
PLAN_SCHEMA = "target string, seq int, stage string, operation string, method string, reason string"


def _numeric(row: Mapping) -> bool:
    return row["dtype"].startswith(NUMERIC)


def suggest_imputation(row: Mapping) -> dict | None:
    if not row["nulls"]:
        return None
    method = "median" if _numeric(row) else "mode"
    return {"operation": "handle_missing_values", "method": method, "reason": f"{row['nulls']} missing values"}


def suggest_outliers(row: Mapping) -> dict | None:
    """Isolation forest for a numeric column with gaps or a deviation above half its mean."""
    spread = row["std"] is not None and row["mean"] is not None and row["std"] > 0.5 * row["mean"]
    if not _numeric(row) or not (row["nulls"] or spread):
        return None
    return {"operation": "handle_outliers", "method": "isolation_forest", "reason": "missing values or wide spread"}


def suggest_encoding(row: Mapping) -> dict | None:
    if row["dtype"] != "string" or not row["rows"]:
        return None
    ratio = row["distinct"] / row["rows"]
    if ratio < 0.1 and row["distinct"] > 2:
        return {"operation": "encode_categorical", "method": "one_hot", "reason": "few distinct values"}
    if ratio < 0.5 and row["distinct"] > 50:
        return {"operation": "encode_categorical", "method": "frequency_encode", "reason": "many distinct values"}
    return None


def suggest_spelling(row: Mapping) -> dict | None:
    if row["dtype"] != "string":
        return None
    return {"operation": "handle_inconsistencies", "method": "fuzzy_match", "reason": "text column"}


def suggest_plan(df: DataFrame, user: Mapping | None = None, relevant: Sequence[str] | None = None) -> dict:
    """User operations first, then suggestions per column, drops of irrelevant columns, and a final duplicate removal."""
    user = user or {}
    given = user.get("suggested_operations", {})
    plan = {key: {t: list(ops) for t, ops in (given.get(key) or {}).items()} for key in STAGES.values()}
    kept = [c for c in df.columns if not relevant or c in relevant]
    dropped = [c for c in df.columns if c not in kept]
    for name in dropped:
        drop = {"operation": "drop_column", "column_name": name, "reason": "not relevant to the questions"}
        plan["modification_operations"].setdefault("global", []).append(drop)
    for row in profile_rows(df.select(*[f"`{c}`" for c in kept])):
        for stage, rule in (
            ("cleaning", suggest_imputation),
            ("cleaning", suggest_outliers),
            ("transformation", suggest_encoding),
            ("cleaning", suggest_spelling),
        ):
            op = rule(row)
            if op:
                plan[STAGES[stage]].setdefault(row["column"], []).append(op)
    dedup = {"operation": "remove_duplicates", "method": None, "reason": "duplicate check of the whole table"}
    plan["cleaning_operations"].setdefault("global", []).append(dedup)
    return {
        "pipeline_plan": list(user.get("pipeline_plan") or DEFAULT_PLAN),
        "suggested_operations": plan,
        "questions": list(user.get("questions") or []),
        "removed_columns": dropped,
        "column_types": {f.name: f.dataType.simpleString() for f in df.schema if f.name in kept},
    }


def plan_frame(spark: SparkSession, plan: Mapping) -> DataFrame:
    """The plan as rows: (target, seq, stage, operation, method, reason); seq counts within a stage and target."""
    rows = [
        (target, i, stage, op.get("operation"), op.get("method"), op.get("reason"))
        for stage, key in STAGES.items()
        for target, ops in plan["suggested_operations"].get(key, {}).items()
        for i, op in enumerate(ops)
    ]
    return spark.createDataFrame(rows, PLAN_SCHEMA)
