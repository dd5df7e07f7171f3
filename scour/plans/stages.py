"""Apply the operations of one stage: ``{target: [{operation, method, ...}]}``.

Every operation ends as completed, failed or skipped. A failed or skipped one leaves the
table as it was and never stops the stage. Errors of the cluster are not caught.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ArithmeticException, DateTimeException, NumberFormatException, ParseException, SparkRuntimeException
from pyspark.sql import DataFrame, functions as F

from scour.functions.columns import is_numeric, is_string
from scour.operators import categories, duplicates, encode, features, impute, outliers, reshape, schema, text
from scour.session import cut_lineage

STAGES = {
    "cleaning": "cleaning_operations",
    "modification": "modification_operations",
    "transformation": "transformation_operations",
}


@dataclass
class Entry:
    """One line of the operation log; ``affected`` counts rows, cells, spellings or columns."""

    stage: str
    operation: str
    method: str | None
    column: str
    status: str
    affected: int
    details: str
    params: dict = field(default_factory=dict)


@dataclass
class Result:
    df: DataFrame
    status: str = "completed"
    details: str = ""
    affected: int = 0


@dataclass
class Context:
    """What an operation may need besides its own parameters."""

    stage: str
    instructions: Mapping
    tables: Mapping[str, DataFrame]
    config: Mapping
    filled: str | None = None  # how imputation, which treats all columns at once, ended, as long as no operation may have made NULLs since


class Stop(Exception):
    """An operation that cannot run: carries its status."""

    def __init__(self, status: str, details: str):
        super().__init__(details)
        self.status = status


# What a formula may raise while it runs; any other error is the cluster's and is passed on.
DATA_ERRORS = (ArithmeticException, DateTimeException, NumberFormatException, SparkRuntimeException)


def _need(ok: bool, status: str, details: str) -> None:
    if not ok:
        raise Stop(status, details)


def _missing_values(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    methods = {}
    for name, ops in ctx.instructions.items():
        for other in ops if isinstance(ops, list) else []:
            if other.get("operation") == "handle_missing_values":
                methods.setdefault(name, other.get("method"))
    fills = impute.fit_fills(df, methods, adaptive=ctx.config.get("adaptive", "outliers"))
    done = [f for f in fills if f.value is not None]
    empty = [f.column for f in fills if f.value is None]
    note = f"; no known value in {', '.join(empty)}" if empty else ""
    status = "skipped" if empty and not done else "completed"
    ctx.filled = status
    text_ = f"filled {', '.join(f'{f.column} ({f.method})' for f in done) or 'nothing'}{note}"
    return Result(impute.apply_fills(df, fills), status, text_, sum(f.nulls for f in done))


def _outliers(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    _need(target in df.columns, "skipped", f"column {target} not found")
    _need(is_numeric(df, target), "skipped", f"column {target} is not numeric")
    return _outlier_batch(df, [(target, op)], ctx)[-1]


WORDS = {"isolation_forest": "replaced {} values by the median", "z_score_removal": "removed {} values"}


def _outlier_batch(df: DataFrame, batch: list[tuple[str, dict]], ctx: Context) -> list[Result]:
    """Outliers of several columns, fitted together, and calls of imputation that find nothing left to fill."""
    out, hits = outliers.handle_outliers(df, {t: op for t, op in batch if op["operation"] == "handle_outliers"})
    results = []
    for target, op in batch:
        if op["operation"] == "handle_outliers":
            note = WORDS.get(op.get("method"), "clipped {} values").format(hits[target])
            results.append(Result(out, details=note, affected=hits[target]))
            if op.get("method") == "z_score_removal":
                ctx.filled = None
        else:
            results.append(Result(out, ctx.filled or "completed", "all columns were filled before"))
    return results


def _batch(df: DataFrame, rest: list[tuple[str, dict]], ctx: Context) -> list[tuple[str, dict]]:
    """The operations at the head of ``rest`` that may be fitted together: outliers of different numeric columns.

    Their fits do not see each other. Imputation between them is done already; after a removal of values it is not.
    """
    batch: list[tuple[str, dict]] = []
    seen: set[str] = set()
    for target, op in rest:
        kind = op.get("operation")
        if kind == "handle_missing_values" and ctx.filled and not any(o.get("method") == "z_score_removal" for _, o in batch):
            batch.append((target, op))
        elif kind == "handle_outliers" and target in df.columns and target not in seen and is_numeric(df, target) and op.get("mode", "nullify") == "nullify":
            batch.append((target, op))
            seen.add(target)
        else:
            break
    return batch


def _duplicates(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    subset = op.get("subset")
    _need(target == "global" or subset is None, "skipped", f"duplicate removal for column {target} needs the global target")
    out = duplicates.remove_duplicates(df, subset, op.get("order"))
    if ctx.config.get("checkpoints"):
        out = cut_lineage(out)  # the shuffle runs once, for the count and for all later operations
    removed = df.count() - out.count() if ctx.config.get("count_rows", True) else 0
    return Result(out, details=f"removed {removed} duplicate rows", affected=removed)


def _inconsistencies(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    _need(ctx.config.get("enable_fuzzy_matching", True), "skipped", "fuzzy matching is disabled")
    _need(target in df.columns, "skipped", f"column {target} not found")
    _need(is_string(df, target), "completed", "column is not text")
    if not categories.categorical_test(df, [target])[target]["categorical"]:
        return Result(df, details="column is not categorical")
    method = op.get("method")
    if method == "standardize_case":
        return Result(categories.standardise_case(df, target), details="trimmed and lower-cased")
    options = {"max_unique": ctx.config.get("max_unique_for_fuzzy_matching")}
    if "scorers" in op:
        options["scorers"] = tuple(op["scorers"])
    base = df if method == "fuzzy_match" else categories.standardise_case(df, target)
    mapping = categories.fit_merge(base, target, **options)
    _need(mapping is not None, "skipped", f"column {target} has more than {options['max_unique']} values")
    merged = categories.merged_spellings(mapping)
    return Result(categories.apply_merge(base, target, mapping), details=f"merged {merged} spellings", affected=merged)


def _rename(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    old = op.get("old_name")
    _need(old in df.columns, "skipped", f"column {old} not found")
    return Result(schema.rename_column(df, old, op["new_name"]), details=f"renamed to {op['new_name']}", affected=1)


def _drop(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    name = op.get("column_name")
    _need(name in df.columns, "skipped", f"column {name} not found")
    return Result(schema.drop_column(df, name), details="dropped", affected=1)


def _feature(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    name = op.get("new_feature_name", "engineered_feature")
    if op.get("formula") is not None:
        out = schema.derive(df, op["formula"], name)
        out.agg(F.count(F.col(f"`{name}`"))).collect()  # an error in a row shows here, not in a later stage
        return Result(out, details="derived from a formula", affected=1)
    groupings = {"age_grouping": ("age", features.age_groups), "bmi_categories": ("bmi", features.bmi_classes)}
    _need(op.get("method") in groupings, "skipped", f"unknown feature method {op.get('method')}")
    default, make = groupings[op["method"]]
    source = op.get("column", default)
    _need(source in df.columns and is_numeric(df, source), "skipped", f"column {source} not found or not numeric")
    return Result(make(df, source, name), details=op["method"], affected=1)


def _aggregate(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    keys, column, method = op.get("group_by_cols"), op.get("target_column"), op.get("method")
    _need(bool(keys and column and method), "failed", "aggregation needs group_by_cols, target_column and method")
    names = [k.strip() for k in keys.split(",")] if isinstance(keys, str) else list(keys)
    missing = [c for c in [*names, column] if c not in df.columns]
    _need(not missing, "failed", f"columns not found: {missing}")
    return Result(features.aggregate(df, names, column, method, op.get("order")), details=f"{method} by {', '.join(names)}")


def _bin(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    _need(target in df.columns and is_numeric(df, target), "failed", f"column {target} not found or not numeric")
    name = op.get("new_column_name", f"{target}_binned")
    method, bins, labels = op.get("method"), op.get("bins"), op.get("labels")
    if method == "equal_width":
        fitted = features.fit_equal_width(df, target, bins, labels, include_lowest=ctx.stage == "transformation")
    elif method == "equal_frequency":
        fitted = features.fit_equal_frequency(df, target, bins, labels)
    else:
        raise Stop("failed", f"unknown binning method {method}")
    return Result(features.discretise(df, target, fitted, name), details=f"{len(fitted.labels)} bins", affected=1)


def _scale(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    _need(target in df.columns and is_numeric(df, target), "failed", f"column {target} not found or not numeric")
    fitted = features.fit_scale(df, target, op.get("method"))
    return Result(fitted.apply(df), details=fitted.method, affected=1)


def _encode(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    _need(target in df.columns and is_string(df, target), "failed", f"column {target} not found or not text")
    method = op.get("method")
    if method not in ("one_hot", "label_encode", "frequency_encode"):
        method = encode.adaptive_method(df, target)
    out = encode.encode(df, target, method, op.get("limit"))
    return Result(out, details=method, affected=len([c for c in out.columns if c not in df.columns]))


def _text(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    _need(target in df.columns and is_string(df, target), "failed", f"column {target} not found or not text")
    method = op.get("method")
    name = op.get("new_column_name", f"{target}_{method}")
    options = {k: op[k] for k in ("stopwords", "table", "lexicon") if k in op}
    _need(method != "lemmatize" or "lexicon" in options, "failed", "lemmatize needs a lexicon")
    return Result(text.process_text(df, target, method, name, **options), details=method or "", affected=1)


def _pivot(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    out = reshape.pivot(df, op["index"], op["columns"], op["values"], op.get("agg_func", "mean"), op.get("order"), op.get("limit"))
    return Result(out, details=op.get("agg_func", "mean"), affected=len(out.columns))


def _unpivot(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    out = reshape.unpivot(df, op.get("id_vars"), op.get("value_vars"), op.get("var_name", "variable"), op.get("value_name", "value"))
    return Result(out, details="unpivoted")


def _merge(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    name = op.get("right_df_name")
    _need(name in ctx.tables, "skipped", f"table {name} is not known")
    out = reshape.merge(df, ctx.tables[name], op["on"], op.get("how", "inner"), op.get("null_safe", False), tuple(op.get("suffixes", ("_x", "_y"))))
    return Result(out, details=f"{op.get('how', 'inner')} join with {name}")


def _label(target: str, op: dict) -> str:
    """The column the log names for an operation, whatever its outcome."""
    name = op.get("operation")
    if name == "handle_missing_values":
        return "All relevant columns"
    if name in ("pivot", "unpivot", "merge", "join"):
        return "global"
    keys = {
        "create_new_feature": "new_feature_name", "aggregate": "target_column", "rename_column": "old_name", "drop_column": "column_name",
        "discretize_bin": "new_column_name", "text_processing": "new_column_name", "encode_categorical": "new_column_name",
    }
    defaults = {"create_new_feature": "engineered_feature", "discretize_bin": f"{target}_binned", "text_processing": f"{target}_{op.get('method')}"}
    return op.get(keys.get(name, ""), defaults.get(name, target))


Handler = Callable[[DataFrame, str, dict, Context], Result]

OPERATIONS: dict[str, dict[str, Handler]] = {
    "cleaning": {
        "handle_missing_values": _missing_values,
        "handle_outliers": _outliers,
        "remove_duplicates": _duplicates,
        "handle_inconsistencies": _inconsistencies,
    },
    "modification": {
        "create_new_feature": _feature,
        "aggregate": _aggregate,
        "rename_column": _rename,
        "drop_column": _drop,
        "discretize_bin": _bin,
    },
    "transformation": {
        "scale_normalize": _scale,
        "pivot": _pivot,
        "unpivot": _unpivot,
        "merge": _merge,
        "join": _merge,
        "text_processing": _text,
        "encode_categorical": _encode,
        "discretize_bin": _bin,
    },
}


def stage_map(instructions: Mapping | None, stage: str) -> dict:
    """The ``{target: [ops]}`` map, given flat or nested under the stage's key."""
    instructions = instructions or {}
    nested = instructions.get(STAGES[stage])
    return dict(nested) if isinstance(nested, Mapping) else dict(instructions)


def apply_stage(
    df: DataFrame, instructions: Mapping | None, stage: str,
    tables: Mapping[str, DataFrame] | None = None, config: Mapping | None = None,
) -> tuple[DataFrame, list[Entry]]:
    """Run every operation of the stage in order."""
    ops_by_target = stage_map(instructions, stage)
    ctx = Context(stage, ops_by_target, tables or {}, config or {})
    log: list[Entry] = []
    rest = [(target, op) for target, ops in ops_by_target.items() for op in (ops if isinstance(ops, list) else [])]
    while rest:
        batch = _batch(df, rest, ctx) if stage == "cleaning" else []
        if len(batch) < 2:
            batch = rest[:1]
        try:
            if len(batch) > 1:
                results = _outlier_batch(df, batch, ctx)
            else:
                (target, op), name = batch[0], batch[0][1].get("operation")
                handler = OPERATIONS[stage].get(name)
                _need(handler is not None, "skipped", f"unknown {stage} operation {name}")
                results = [handler(df, target, op, ctx)]
                twice = sorted(n for n, k in Counter(c.lower() for c in results[0].df.columns).items() if k > 1)
                _need(not twice, "failed", f"columns of one name: {', '.join(twice)}")
        except Stop as stop:
            results = [Result(df, stop.status, str(stop))]
        except (AnalysisException, ParseException, ValueError, KeyError, TypeError, *DATA_ERRORS) as e:
            if len(batch) > 1:  # find out one by one which of them it was
                batch, results = rest[:1], [_alone(df, *rest[0], ctx)]
            else:
                results = [Result(df, "failed", f"{type(e).__name__}: {e}".splitlines()[0])]
        for (target, op), result in zip(batch, results):
            plain = {k: v for k, v in op.items() if k not in ("lexicon", "table")}
            log.append(Entry(stage, str(op.get("operation")), op.get("method"), _label(target, op), result.status, result.affected, result.details, plain | {"target": target}))
        df = results[-1].df
        rest = rest[len(batch) :]
    return df, log


def _alone(df: DataFrame, target: str, op: dict, ctx: Context) -> Result:
    try:
        return OPERATIONS["cleaning"][op["operation"]](df, target, op, ctx)
    except (AnalysisException, ParseException, ValueError, KeyError, TypeError, *DATA_ERRORS) as e:
        return Result(df, "failed", f"{type(e).__name__}: {e}".splitlines()[0])
