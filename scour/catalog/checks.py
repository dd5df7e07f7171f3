"""Profiles, suggested plans, validation, runs and the audit trail."""

from pyspark.sql import functions as F

from scour.catalog.base import DIRTY_SQL, GAPS_SQL, HEAVY_SQL, Tables, q6, query, r6, rounded
from scour.catalog.cleaning import MODE_SQL, _adaptive, _fences
from scour.catalog.spelling import similar_sql
from scour.operators import profile
from scour.plans import audit, suggest, validate
from scour.plans.runner import run_plan
from scour.plans.stages import apply_stage
from scour.session import scratch_path

SUMMARY_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def _summary_sql() -> str:
    one = """SELECT {i} AS position, '{c}' AS column_name, '{d}' AS dtype, (SELECT COUNT(*) FROM customer) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
 (SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM customer ORDER BY v LIMIT 3)) AS samples"""
    return " UNION ALL ".join(one.format(i=i, c=c, d=d) for i, (c, d) in enumerate(SUMMARY_TYPES.items()))


@query("table_summary", _summary_sql())
def table_summary(t: Tables):
    out = profile.summary(t.customer).withColumn("samples", F.array_join("samples", " | "))
    return out.withColumnsRenamed({"column": "column_name", "rows": "n_rows", "columns": "n_columns"})


def _profile_sql(kinds: dict[str, str], table: str) -> str:
    parts = []
    for c, kind in kinds.items():
        head = f"SELECT '{c}' AS column_name, '{kind}' AS dtype, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS n_distinct"
        if kind == "string":
            exprs = dict.fromkeys(("mean", "std", "skew", "min", "q1", "median", "q3", "max"), "CAST(NULL AS DOUBLE)")
        else:
            exprs = {
                "mean": q6(f"AVG({c})"), "std": q6(f"stddev_samp({c})"), "skew": q6(f"skewness({c})"), "min": f"CAST(MIN({c}) AS DOUBLE)",
                "q1": q6(f"quantile_cont({c}, 0.25)"), "median": q6(f"quantile_cont({c}, 0.5)"), "q3": q6(f"quantile_cont({c}, 0.75)"),
                "max": f"CAST(MAX({c}) AS DOUBLE)",
            }
        parts.append(f"{head}, {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {table}")
    return " UNION ALL ".join(parts)


PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}


@query("column_profile", _profile_sql(PART_TYPES, "part"))
def column_profile(t: Tables):
    out = profile.profile(t.part).withColumnsRenamed({"column": "column_name", "rows": "n_rows", "distinct": "n_distinct"})
    return rounded(out, "mean", "std", "skew", "q1", "median", "q3")


DIRTY_NUMBERS = ["c_custkey", "c_acctbal", "c_nationkey"]
DIRTY_TEXTS = ["c_name", "c_mktsegment"]
STATS = (
    f"{DIRTY_SQL}, st AS ("
    + " UNION ALL ".join(
        [
            f"SELECT '{c}' AS target, true AS num, COUNT(*) AS r, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS d, AVG({c}) AS m, stddev_samp({c}) AS s FROM g"
            for c in DIRTY_NUMBERS
        ]
        + [f"SELECT '{c}', false, COUNT(*), COUNT(*) - COUNT({c}), COUNT(DISTINCT {c}), NULL, NULL FROM g" for c in DIRTY_TEXTS]
    )
    + ")"
)
RULES = {
    "suggest_imputation": "SELECT target, 'handle_missing_values' AS operation, CASE WHEN num THEN 'median' ELSE 'mode' END AS method FROM st WHERE nulls > 0",
    "suggest_outliers": "SELECT target, 'handle_outliers' AS operation, 'isolation_forest' AS method FROM st WHERE num AND (nulls > 0 OR s > 0.5 * m)",
    "suggest_encoding": """SELECT target, 'encode_categorical' AS operation, CASE WHEN d < 0.1 * r AND d > 2 THEN 'one_hot' ELSE 'frequency_encode' END AS method
 FROM st WHERE NOT num AND (d < 0.1 * r AND d > 2 OR d < 0.5 * r AND d > 50)""",
    "suggest_spelling": "SELECT target, 'handle_inconsistencies' AS operation, 'fuzzy_match' AS method FROM st WHERE NOT num",
}


def _suggested(t: Tables, rule):
    ops = [(r["column"], rule(r)) for r in profile.profile_rows(t.dirty)]
    rows = [(c, op["operation"], op["method"]) for c, op in ops if op]
    return t.spark.createDataFrame(rows, "target string, operation string, method string")


for _name, _sql in RULES.items():
    query(_name, f"{STATS} {_sql}")(lambda t, rule=getattr(suggest, _name): _suggested(t, rule))


PLAN_SQL = (
    f"{STATS}, ops AS ("
    + " UNION ALL ".join(
        f"SELECT target, {i} AS ord, '{'transformation' if n == 'suggest_encoding' else 'cleaning'}' AS stage, operation, method FROM ({s})"
        for i, (n, s) in enumerate(RULES.items())
    )
    + """ UNION ALL SELECT 'global', 9, 'cleaning', 'remove_duplicates', NULL UNION ALL SELECT 'global', 8, 'modification', 'drop_column', NULL
 UNION ALL SELECT 'c_acctbal', -1, 'cleaning', 'handle_outliers', 'iqr_clipping')
 SELECT target, CAST(row_number() OVER (PARTITION BY stage, target ORDER BY ord) - 1 AS INTEGER) AS seq, stage, operation, method FROM ops WHERE target <> 'c_custkey'"""
)


@query("suggest_plan", PLAN_SQL)
def suggest_plan(t: Tables):
    """The user's own operation first, suggestions per kept column, the unwanted key column dropped."""
    user = {"suggested_operations": {"cleaning_operations": {"c_acctbal": [{"operation": "handle_outliers", "method": "iqr_clipping"}]}}}
    plan = suggest.suggest_plan(t.dirty, user, relevant=["c_name", "c_acctbal", "c_nationkey", "c_mktsegment"])
    return suggest.plan_frame(t.spark, plan).drop("reason")


def _checks(t: Tables, checks):
    names = {"check": "check_name", "column": "column_name"}
    return validate.checks_frame(t.spark, checks).withColumnsRenamed(names).drop("expected")


def _check_sql(check: str, column: str, observed: str, source: str, operation: str, method: str | None, ok: str = "{o} = 0") -> str:
    good = ok.format(o=f"({observed})")
    m = "CAST(NULL AS VARCHAR)" if method is None else f"'{method}'"
    return f"""SELECT '{check}' AS check_name, '{column}' AS column_name, CASE WHEN {good} THEN 'passed' ELSE 'failed' END AS status,
 CAST({observed} AS DOUBLE) AS observed, CASE WHEN {good} THEN NULL ELSE '{operation}' END AS recommended_operation,
 CASE WHEN {good} THEN NULL ELSE {m} END AS recommended_method FROM {source}"""


GAP_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]
MISSING_SQL = " UNION ALL ".join(
    _check_sql("missing_values", c, f"COUNT(*) - COUNT({c})", "g", "handle_missing_values", "mode" if c == "l_returnflag" else "median") for c in GAP_COLUMNS
)


@query("validate_missing", f"{GAPS_SQL} {MISSING_SQL}")
def validate_missing(t: Tables):
    return _checks(t, validate.check_missing(t.gaps))


def _duplicates_sql(columns: str, source: str) -> str:
    counted = f"(SELECT (SELECT COUNT(*) FROM {source}) - (SELECT COUNT(*) FROM (SELECT DISTINCT {columns} FROM {source})) AS n)"
    return _check_sql("duplicates", "global", "n", counted, "remove_duplicates", None)


@query("validate_duplicates", _duplicates_sql("l_partkey, l_quantity", "lineitem"))
def validate_duplicates(t: Tables):
    return _checks(t, validate.check_duplicates(t.lineitem.select("l_partkey", "l_quantity")))


def _outliers_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        _check_sql("outliers", c, "n", f"(SELECT COUNT(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n FROM g, ({_fences(c)}))", "handle_outliers", "isolation_forest")
        for c in columns
    )


HEAVY_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@query("validate_outliers", f"{HEAVY_SQL} {_outliers_sql(HEAVY_COLUMNS)}")
def validate_outliers(t: Tables):
    return _checks(t, validate.check_outliers(t.heavy))


def _spelling_sql() -> str:
    names = ["p_name", "p_brand", "p_type"]
    found = similar_sql("part", names)
    head, tail = found.rsplit("\n SELECT x.c", 1)
    parts = [_check_sql("similar_values", c, "n", f"(SELECT COUNT(*) AS n FROM f WHERE column_name = '{c}')", "handle_inconsistencies", None) for c in names]
    return f"{head}, f AS (SELECT x.c{tail}) {' UNION ALL '.join(parts)}"


@query("validate_spelling", _spelling_sql())
def validate_spelling(t: Tables):
    return _checks(t, validate.check_spelling(t.part))


@query(
    "validate_cleaning",
    f"{GAPS_SQL} {MISSING_SQL} UNION ALL {_duplicates_sql(', '.join(GAP_COLUMNS), 'g')} UNION ALL {_outliers_sql(GAP_COLUMNS[:4])}"
    " UNION ALL SELECT 'similar_values', 'l_returnflag', 'passed', 0.0, NULL, NULL",
)
def validate_cleaning(t: Tables):
    return _checks(t, validate.validate_cleaning(t.gaps))


CREATE = "create_new_feature"


@query(
    "validate_features",
    " UNION ALL ".join(
        [
            _check_sql("feature_varies", "net", "COUNT(l_extendedprice * l_discount)", "lineitem", CREATE, None, "COUNT(DISTINCT l_extendedprice * l_discount) > 1 OR COUNT(*) < 2"),
            _check_sql("feature_not_null", "empty", "0", "(SELECT 1)", CREATE, None, "false"),
            _check_sql("feature_varies", "constant", "COUNT(*)", "lineitem", CREATE, None, "COUNT(*) < 2"),
            _check_sql("feature_exists", "absent", "0", "(SELECT 1)", CREATE, None, "false"),
        ]
    ),
)
def validate_features(t: Tables):
    ops = [
        {"operation": CREATE, "formula": "l_extendedprice * l_discount", "new_feature_name": "net"},
        {"operation": CREATE, "formula": "CAST(NULL AS DOUBLE)", "new_feature_name": "empty"},
        {"operation": CREATE, "formula": "1", "new_feature_name": "constant"},
    ]
    out, log = apply_stage(t.lineitem, {"global": ops}, "modification")
    return _checks(t, validate.validate_changes(out, log) + [validate.check_feature(out, "absent")])


@query(
    "validate_aggregation",
    _check_sql("aggregation_shrinks", "global", "COUNT(DISTINCT l_orderkey)", "lineitem", "aggregate", None, "COUNT(DISTINCT l_orderkey) < COUNT(*)"),
)
def validate_aggregation(t: Tables):
    rows = t.lineitem.count()
    op = {"operation": "aggregate", "group_by_cols": "l_orderkey", "target_column": "l_quantity", "method": "sum"}
    out, log = apply_stage(t.lineitem, {"global": [op]}, "modification")
    return _checks(t, validate.validate_changes(out, log, rows))


SCALE = "scale_normalize"


@query(
    "validate_scaling",
    f"""SELECT check_name, column_name, status, {q6('observed')} AS observed, recommended_operation, recommended_method FROM (
 SELECT 'scaled_range' AS check_name, 'l_quantity' AS column_name, 'passed' AS status, 1.0 AS observed, NULL AS recommended_operation, NULL AS recommended_method
 UNION ALL SELECT 'scaled_distribution', 'l_extendedprice', 'passed', 1.0, NULL, NULL
 UNION ALL SELECT 'scaled_range', 'l_tax', 'passed', MAX(l_tax), NULL, NULL FROM lineitem
 UNION ALL SELECT 'scaled_distribution', 'l_discount', 'failed', stddev_samp(l_discount), 'scale_normalize', 'standard_scaler' FROM lineitem)""",
)
def validate_scaling(t: Tables):
    ops = {"l_quantity": [{"operation": SCALE, "method": "min_max_scaler"}], "l_extendedprice": [{"operation": SCALE, "method": "standard_scaler"}]}
    out, log = apply_stage(t.lineitem, ops, "transformation")
    raw = [validate.check_scaled(out, "l_tax", "min_max_scaler"), validate.check_scaled(out, "l_discount", "standard_scaler")]
    return rounded(_checks(t, validate.validate_changes(out, log) + raw), "observed")


@query(
    "validate_binning",
    "SELECT 'bin_type' AS check_name, 'price_band' AS column_name, 'passed' AS status, CAST(NULL AS DOUBLE) AS observed, NULL AS recommended_operation, CAST(NULL AS VARCHAR) AS recommended_method"
    " UNION ALL SELECT 'bin_count', 'price_band', 'passed', 4, NULL, NULL UNION ALL SELECT 'bin_type', 'size_band', 'passed', NULL, NULL, NULL"
    " UNION ALL SELECT 'bin_count', 'size_band', CASE WHEN n = 40 THEN 'passed' ELSE 'failed' END, n, CASE WHEN n = 40 THEN NULL ELSE 'discretize_bin' END, NULL"
    " FROM (SELECT COUNT(DISTINCT p_size % 4) AS n FROM part) UNION ALL SELECT 'bin_exists', 'absent', 'failed', 0, 'discretize_bin', NULL",
)
def validate_binning(t: Tables):
    table = t.part.withColumn("kind", F.expr("p_size % 4"))
    ops = {
        "p_retailprice": [{"operation": "discretize_bin", "method": "equal_frequency", "bins": 4, "new_column_name": "price_band"}],
        "kind": [{"operation": "discretize_bin", "method": "equal_width", "bins": 40, "new_column_name": "size_band"}],
    }
    out, log = apply_stage(table, ops, "transformation")
    return _checks(t, validate.validate_changes(out, log) + validate.check_binned(out, "absent", 3))


@query(
    "validate_text",
    "SELECT 'text_exists' AS check_name, 'text_lowercase' AS column_name, 'passed' AS status, CAST(1 AS DOUBLE) AS observed, NULL AS recommended_operation, NULL AS recommended_method"
    " UNION ALL SELECT 'text_lowercase', 'text_lowercase', 'passed', 0, NULL, NULL UNION ALL SELECT 'text_exists', 'text', 'passed', 1, NULL, NULL"
    " UNION ALL SELECT 'text_lowercase', 'text', CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END, n, CASE WHEN n = 0 THEN NULL ELSE 'text_processing' END,"
    " CASE WHEN n = 0 THEN NULL ELSE 'lowercase' END FROM (SELECT COUNT(*) AS n FROM documents WHERE text <> lower(text))"
    " UNION ALL SELECT 'text_exists', 'absent', 'failed', 0, 'text_processing', 'lowercase'",
)
def validate_text(t: Tables):
    out, log = apply_stage(t.documents, {"text": [{"operation": "text_processing", "method": "lowercase"}]}, "transformation")
    raw = validate.check_text(out, "text", "lowercase") + validate.check_text(out, "absent", "lowercase")
    return _checks(t, validate.validate_changes(out, log) + raw)


@query(
    "validate_encoding",
    "SELECT 'one_hot_original_dropped' AS check_name, 'p_type' AS column_name, 'passed' AS status, CAST(NULL AS DOUBLE) AS observed,"
    " NULL AS recommended_operation, NULL AS recommended_method"
    " UNION ALL SELECT 'one_hot_columns', 'p_type', 'passed', COUNT(DISTINCT p_type), NULL, NULL FROM part"
    " UNION ALL SELECT 'encoded_column', 'p_brand_encoded', 'passed', NULL, NULL, NULL UNION ALL SELECT 'encoded_column', 'p_name_freq_encoded', 'passed', NULL, NULL, NULL"
    " UNION ALL SELECT 'one_hot_original_dropped', 'p_name', 'failed', NULL, 'encode_categorical', 'one_hot'"
    " UNION ALL SELECT 'one_hot_columns', 'p_name', 'passed', 1, NULL, NULL",
)
def validate_encoding(t: Tables):
    methods = {"p_type": "one_hot", "p_brand": "label_encode", "p_name": "frequency_encode"}
    ops = {c: [{"operation": "encode_categorical", "method": m}] for c, m in methods.items()}
    out, log = apply_stage(t.part, ops, "transformation")
    return _checks(t, validate.validate_changes(out, log) + validate.check_encoded(out, "p_name", "one_hot"))


CLEAN_PLAN = {
    "l_extendedprice": [{"operation": "handle_missing_values", "method": "median"}, {"operation": "handle_outliers", "method": "iqr_clipping"}],
    "global": [{"operation": "remove_duplicates"}],
    "not_there": [{"operation": "handle_outliers"}],
    "l_returnflag": [{"operation": "handle_outliers"}, {"operation": "sharpen"}],
}
CLEANED = f"""{GAPS_SQL}, i AS (SELECT l_orderkey, l_linenumber, COALESCE(l_quantity, {_adaptive('l_quantity')}) AS l_quantity,
 COALESCE(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM g)) AS p, {MODE_SQL} AS l_returnflag FROM g),
 c AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, CASE WHEN p < lo THEN lo WHEN p > hi THEN hi ELSE p END AS l_extendedprice, l_returnflag
 FROM i, ({_fences('p', 'i')}))"""


@query("clean_stage", f"{CLEANED} SELECT l_orderkey, l_linenumber, {q6('l_quantity')} AS l_quantity, {q6('l_extendedprice')} AS l_extendedprice, l_returnflag FROM c")
def clean_stage(t: Tables):
    out, _ = apply_stage(t.gaps, CLEAN_PLAN, "cleaning")
    return rounded(out, "l_quantity", "l_extendedprice")


@query(
    "clean_and_aggregate",
    f"{CLEANED} SELECT l_returnflag, CAST(ROUND(SUM(CAST({q6('l_extendedprice')} AS DECIMAL(24, 6))), 2) AS DOUBLE) AS l_extendedprice FROM c GROUP BY 1",
)
def clean_and_aggregate(t: Tables):
    """Sums of decimals: a sum of doubles depends on the order of its terms."""
    clean, _ = apply_stage(t.gaps, CLEAN_PLAN, "cleaning", config={"count_rows": False})
    clean = clean.withColumn("l_extendedprice", r6("l_extendedprice").cast("decimal(24, 6)"))
    op = {"operation": "aggregate", "group_by_cols": "l_returnflag", "target_column": "l_extendedprice", "method": "sum"}
    out, _ = apply_stage(clean, {"global": [op]}, "modification")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 2).cast("double"))


def _run(t: Tables):
    plan = {
        "cleaning_operations": CLEAN_PLAN,
        "modification_operations": {
            "global": [
                {"operation": CREATE, "formula": "l_extendedprice * l_quantity", "new_feature_name": "total"},
                {"operation": "drop_column", "column_name": "l_linenumber"},
                {"operation": "rename_column", "old_name": "absent", "new_name": "x"},
            ]
        },
        "transformation_operations": {"total": [{"operation": SCALE, "method": "min_max_scaler"}], "l_returnflag": [{"operation": SCALE}]},
    }
    return run_plan(t.gaps, plan, max_retries=1, spelling=False)


@query(
    "planned_run",
    f"""{CLEANED} SELECT l_orderkey, {q6('l_quantity')} AS l_quantity, {q6('l_extendedprice')} AS l_extendedprice, l_returnflag,
 {q6('(l_extendedprice * l_quantity - lo) / (hi - lo)')} AS total
 FROM c, (SELECT MIN(l_extendedprice * l_quantity) AS lo, MAX(l_extendedprice * l_quantity) AS hi FROM c)""",
)
def planned_run(t: Tables):
    """All three stages with validation between them; the table is read back from the checkpoint folder after each."""
    return rounded(_run(t).df, "l_quantity", "l_extendedprice", "total")


# The numbers of the log: cells filled, values clipped, rows removed.
AFFECTED = f"""{CLEANED}, a AS (SELECT
 (SELECT 3 * COUNT(*) - COUNT(l_quantity) - COUNT(l_extendedprice) - COUNT(l_returnflag) FROM g) AS filled,
 (SELECT COUNT(*) FILTER (WHERE p < lo OR p > hi) FROM i, ({_fences('p', 'i')})) AS clipped,
 (SELECT COUNT(*) FROM g) - (SELECT COUNT(*) FROM c) AS removed)"""
LOG_SQL = f"""{AFFECTED} SELECT CAST(seq AS INTEGER) AS seq, stage, operation, method, column_name, status, CAST(affected AS BIGINT) AS affected FROM (
 SELECT 0 AS seq, 'cleaning' AS stage, 'handle_missing_values' AS operation, 'median' AS method, 'All relevant columns' AS column_name, 'completed' AS status, filled AS affected FROM a
 UNION ALL SELECT 1, 'cleaning', 'handle_outliers', 'iqr_clipping', 'l_extendedprice', 'completed', clipped FROM a
 UNION ALL SELECT 2, 'cleaning', 'remove_duplicates', NULL, 'global', 'completed', removed FROM a
 UNION ALL SELECT 3, 'cleaning', 'handle_outliers', NULL, 'not_there', 'skipped', 0 UNION ALL SELECT 4, 'cleaning', 'handle_outliers', NULL, 'l_returnflag', 'skipped', 0
 UNION ALL SELECT 5, 'cleaning', 'sharpen', NULL, 'l_returnflag', 'skipped', 0
 UNION ALL SELECT 6, 'modification', 'create_new_feature', NULL, 'total', 'completed', 1
 UNION ALL SELECT 7, 'modification', 'drop_column', NULL, 'l_linenumber', 'completed', 1
 UNION ALL SELECT 8, 'modification', 'rename_column', NULL, 'absent', 'skipped', 0
 UNION ALL SELECT 9, 'transformation', 'scale_normalize', 'min_max_scaler', 'total', 'completed', 1
 UNION ALL SELECT 10, 'transformation', 'scale_normalize', NULL, 'l_returnflag', 'failed', 0)"""


@query("operation_log", LOG_SQL)
def operation_log(t: Tables):
    """Written to Parquet by append, and read back."""
    path = scratch_path(t.spark, "log")
    audit.append_log(audit.log_frame(t.spark, _run(t).log), path)
    log = t.spark.read.parquet(path)
    return log.drop("run", "details").withColumnRenamed("column", "column_name")


RESIDUAL = " + ".join(f"(SELECT COUNT(*) FILTER (WHERE {c} < lo OR {c} > hi) FROM c, ({_fences(c, 'c')}))" for c in GAP_COLUMNS[:4])


@query(
    "activity_log",
    f"""{CLEANED}, v AS (SELECT CASE WHEN {RESIDUAL} = 0 THEN 'Success' ELSE 'Failed' END AS s)
 SELECT agent_name, task_description, coalesce(status, s) AS status FROM v, (VALUES ('runner', 'start', 'Initiated'), ('cleaning', 'attempt 1', 'Success'),
 ('cleaning', 'validation', NULL), ('modification', 'attempt 1', 'Success'), ('modification', 'validation', 'Success'), ('transformation', 'attempt 1', 'Success'),
 ('transformation', 'validation', 'Success'), ('runner', 'finished', NULL)) AS r(agent_name, task_description, status)""",
)
def activity_log(t: Tables):
    """Who did what, without the times of day."""
    return _run(t).recorder.frame(t.spark).select("agent_name", "task_description", "status")


@query(
    "run_totals",
    f"""{AFFECTED} SELECT measure, CAST(total AS BIGINT) AS total FROM (SELECT 'duplicates_removed' AS measure, removed AS total FROM a
 UNION ALL SELECT 'missing_values_imputed', filled FROM a UNION ALL SELECT 'outliers_handled', clipped FROM a UNION ALL SELECT 'inconsistencies_resolved', 0
 UNION ALL SELECT 'new_features_created', 1 UNION ALL SELECT 'columns_removed', 1)""",
)
def run_totals(t: Tables):
    return audit.run_totals(audit.log_frame(t.spark, _run(t).log))


@query(
    "report_json",
    f"""{AFFECTED} SELECT 'cleaning' AS stage, 3 AS completed, 0 AS failed, 3 AS skipped, CAST(filled + clipped + removed AS BIGINT) AS affected FROM a
 UNION ALL SELECT 'modification', 2, 0, 1, 2 UNION ALL SELECT 'transformation', 1, 1, 0, 1
 UNION ALL SELECT 'overview', 6, 1, 4, CAST(removed AS BIGINT) FROM a""",
)
def report_json(t: Tables):
    """The JSON report, written and read back: its stage summaries, and its overview with the duplicates removed."""
    run = _run(t)
    path = scratch_path(t.spark, "report.json")
    summary = audit.overview(t.spark, run.log, run.checks, run.ok, run.recorder.seconds())
    audit.write_report(path, run.recorder.frame(t.spark), audit.stage_summary(t.spark, run.log, run.checks), summary)
    records = t.spark.read.schema("kind string, record string").json(path).where("kind <> 'activity'")
    parsed = F.from_json("record", "stage string, completed int, failed int, skipped int, affected bigint, totals map<string,bigint>")
    rows = records.select("kind", parsed.alias("r"))
    return rows.select(
        F.coalesce("r.stage", "kind").alias("stage"), "r.completed", "r.failed", "r.skipped", F.coalesce("r.affected", F.col("r.totals")["duplicates_removed"]).alias("affected")
    )


def _state_sql(source: str) -> str:
    distinct = f"SELECT {', '.join(GAP_COLUMNS)}, COUNT(*) AS n FROM {source} GROUP BY ALL"
    parts = [f"SELECT 'rows' AS measure, 'global' AS column_name, COUNT(*) AS value FROM {source}", "SELECT 'columns', 'global', 5"]
    parts += [f"SELECT 'missing_values', '{c}', COUNT(*) - COUNT({c}) FROM {source}" for c in GAP_COLUMNS]
    parts += [
        f"SELECT 'outliers', '{c}', n FROM (SELECT COUNT(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n FROM {source}, ({_fences(c, source)})) WHERE n > 0"
        for c in GAP_COLUMNS[:4]
    ]
    parts.append(f"SELECT 'duplicates', 'global', CAST(coalesce(SUM(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM ({distinct})")
    return " UNION ALL ".join(parts)


@query("table_state", f"{GAPS_SQL} {_state_sql('g')}")
def table_state(t: Tables):
    return audit.table_state(t.gaps).withColumnRenamed("column", "column_name")


@query("state_before_after", f"{CLEANED} SELECT 'before' AS phase, * FROM ({_state_sql('g')}) UNION ALL SELECT 'after', * FROM ({_state_sql('c')})")
def state_before_after(t: Tables):
    """What cleaning changed: the same measures of the raw and of the cleaned table."""
    clean, _ = apply_stage(t.gaps, CLEAN_PLAN, "cleaning", config={"count_rows": False, "checkpoints": True})
    phases = [audit.table_state(df).withColumn("phase", F.lit(p)) for p, df in (("before", t.gaps), ("after", clean))]
    return phases[0].unionByName(phases[1]).withColumnRenamed("column", "column_name")
