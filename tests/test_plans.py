"""Plans end to end, suggestions, validation, the audit trail, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from scour.operators import impute, outliers, profile, schema
from scour.operators.features import fit_scale
from scour.plans import audit, suggest, validate
from scour.plans.runner import run_plan
from scour.plans.stages import apply_stage
from scour.sources import tables as io
from scour.streaming.fitted import apply_fitted, remove_stream_duplicates
from tests.conftest import values

ROWS = [(3.5, "barge", 7), (4.0, "tug", 9), (4.0, "tug", 9), (None, "ferry", 12), (4.5, "barge", 8), (5.0, "ferry", 11), (480.0, "liner", 30)]
SCHEMA = "length double, ship string, crew long"
PLAN = {
    "cleaning_operations": {
        "global": [{"operation": "remove_duplicates"}],
        "length": [{"operation": "handle_missing_values", "method": "mean"}, {"operation": "handle_outliers", "method": "isolation_forest"}],
        "ship": [{"operation": "handle_missing_values", "method": "mode"}],
    },
    "transformation_operations": {
        "length": [{"operation": "scale_normalize", "method": "standard_scaler"}],
        "ship": [{"operation": "encode_categorical", "method": "one_hot"}],
    },
}


def test_clean_then_transform(frame):
    clean, log = apply_stage(frame(ROWS, SCHEMA), PLAN, "cleaning")
    assert clean.count() == 6 and clean.where("length IS NULL").count() == 0 and 480.0 not in values(clean, "length")
    out, more = apply_stage(clean, PLAN, "transformation")
    assert {e.status for e in log + more} == {"completed"} and "ship_tug" in out.columns


def test_run_plan_warns_or_halts(frame):
    df = frame(ROWS, SCHEMA)
    run = run_plan(df, PLAN, max_retries=2)
    assert run.df.count() == 6 and set(run.checks) == {"cleaning", "modification", "transformation"}
    assert run.recorder.seconds() >= 0 and run.recorder.records[-1][1:3] == ("runner", "finished")
    heavy = frame([(float(i),) for i in range(30)] + [(9999.0,)], "x double")
    stopped = run_plan(heavy, {"cleaning_operations": {}}, on_fail="halt", max_retries=1)
    assert stopped.df is None and not stopped.ok
    warned = run_plan(heavy, {"cleaning_operations": {}}, max_retries=1)
    assert not warned.ok and warned.df.count() == 31


def test_retry_runs_the_recommended_operations(frame):
    df = frame([(1.0,), (None,), (3.0,), (2.0,), (2.5,)], "x double")
    run = run_plan(df, {"cleaning_operations": {}})
    assert run.df.where("x IS NULL").count() == 0
    assert ("handle_missing_values", "median") in {(e.operation, e.method) for e in run.log}


def test_unknown_stage_and_empty_plan(frame):
    run = run_plan(frame([(1,)], "a int"), {"pipeline_plan": ["painting", "cleaning"], "suggested_operations": {}})
    assert run.ok and list(run.checks) == ["cleaning"]


BERTHS = [
    ("p1", "2031-04-02", 31.5, "tidal", "yes", 3),
    ("p2", "2031-04-09", 12.0, None, "no", 0),
    ("p3", "2031-05-01", None, "tidal", "yes", 7),
    ("p4", "2031-06-11", 44.25, "locked", "no", 2),
]
BERTH_COLUMNS = "berth string, opened string, metres double, basin string, lit string, cranes long"


def test_suggested_plan(frame):
    df, warnings = schema.standardise_types(frame(BERTHS, BERTH_COLUMNS), {"opened": "datetime", "lit": "bool", "metres": "float"})
    plan = suggest.suggest_plan(df)
    ops = plan["suggested_operations"]
    assert not warnings and len(plan["column_types"]) == 6 and plan["column_types"]["lit"] == "boolean"
    assert [o["operation"] for o in ops["cleaning_operations"]["metres"]] == ["handle_missing_values", "handle_outliers"]
    assert ops["cleaning_operations"]["basin"][0]["method"] == "mode"
    assert ops["cleaning_operations"]["global"] == [{"operation": "remove_duplicates", "method": None, "reason": "duplicate check of the whole table"}]
    narrow = suggest.suggest_plan(df, {"pipeline_plan": ["cleaning"], "questions": ["q"]}, relevant=["berth"])
    assert narrow["pipeline_plan"] == ["cleaning"] and narrow["questions"] == ["q"] and len(narrow["removed_columns"]) == 5
    assert suggest.plan_frame(df.sparkSession, narrow).where("operation = 'drop_column'").count() == 5


def test_recommendations_follow_failed_checks(frame):
    df = frame([(1.0, "a"), (1.0, "a"), (None, None)], "x double, s string")
    checks = validate.validate_cleaning(df)
    again = validate.recommendations(checks, "cleaning")["cleaning_operations"]
    assert {t: [(o["operation"], o.get("method")) for o in ops] for t, ops in again.items()} == {
        "x": [("handle_missing_values", "median")], "s": [("handle_missing_values", "mode")], "global": [("remove_duplicates", None)],
    }
    fixed, _ = apply_stage(df, again, "cleaning")
    assert validate.passed(validate.validate_cleaning(fixed)) and fixed.count() == 1


def test_log_report_and_totals(spark, frame, tmp_path):
    run = run_plan(frame(ROWS, SCHEMA), PLAN, max_retries=1)
    log = audit.log_frame(spark, run.log)
    audit.append_log(log, str(tmp_path / "log"))
    audit.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 * len(run.log)
    totals = {r["measure"]: r["total"] for r in audit.run_totals(log).collect()}
    assert totals["duplicates_removed"] == 1 and totals["missing_values_imputed"] == 1 and totals["columns_removed"] == 0
    path = str(tmp_path / "report.json")
    audit.write_report(path, run.recorder.frame(spark), audit.stage_summary(spark, run.log, run.checks))
    records = [json.loads(r["record"]) for r in spark.read.json(path).where("kind = 'stage'").collect()]
    assert {r["stage"] for r in records} == {"cleaning", "modification", "transformation"}


def test_summary_of_empty_and_small_tables(spark, frame):
    df = frame([(3, "b"), (1, None), (2, "a")], "n int, s string")
    rows = [tuple(r) for r in profile.summary(df).collect()]
    assert rows == [(0, "n", "int", 3, 2, ["1", "2", "3"]), (1, "s", "string", 3, 2, ["a", "b"])]
    assert "Rows: 3, Columns: 2" in profile.summary_text(df, "t")
    assert profile.summary(df.where("false")).first()["rows"] == 0


def test_readers_and_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        io.read_table(spark, str(tmp_path / "x.pdf"))
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, str(tmp_path / "x.csv"))
    (tmp_path / "Up.CSV").write_text('a,b,c,d,e\n1,1.5,True,"x, ""y""",NA\n2,,False,\n')
    with pytest.raises(Exception):
        io.read_csv(spark, str(tmp_path / "Up.CSV")).collect()
    (tmp_path / "ok.CSV").write_text('a,b,c,d,e\n1,1.5,True,"x, ""y""",NA\n2,,False,nan,\n')
    df = io.read_table(spark, str(tmp_path / "ok.CSV"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 1.5, True, 'x, "y"', None), (2, None, False, None, None)]
    (tmp_path / "doc.json").write_text('[{"a": 1,\n "b": "x"}, {"a": 2}]')
    assert values(io.read_table(spark, str(tmp_path / "doc.json")), "a") == [1, 2]
    found, errors = io.load_datasets(spark, [str(tmp_path / "ok.CSV"), str(tmp_path / "gone.json")])
    assert list(found) == ["ok.CSV"] and list(errors) == ["gone.json"]


def test_fitted_steps_on_a_stream(spark, frame, tmp_path):
    batch = frame([(float(i), "a") for i in range(20)] + [(900.0, None), (None, "b")], "x double, s string")
    fills = impute.fit_fills(batch)
    bounds = outliers.iqr_bounds(batch, ["x"])["x"]
    steps = [*fills, bounds]
    scaled = fit_scale(apply_fitted(batch, steps), "x", "min_max_scaler")
    want = sorted(map(tuple, apply_fitted(batch, [*steps, scaled]).collect()))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = apply_fitted(stream, [*steps, scaled]).writeStream.format("memory").queryName("fitted").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("fitted").collect())) == want


def test_stream_duplicates(spark, tmp_path):
    rows = spark.range(6).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = remove_stream_duplicates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "ts")
    query = stream.writeStream.format("memory").queryName("once").start()
    query.processAllAvailable()
    query.stop()
    assert values(spark.table("once"), "k") == [0, 1, 2]


def test_jobs_do_not_grow_with_columns(spark):
    """The suggested cleaning of 2 and of 12 columns takes the same number of jobs."""
    jobs = {}
    for n in (2, 12):
        cells = ", ".join(f"CASE WHEN id % 17 = {i} THEN NULL ELSE CAST((id * {i + 3}) % 101 AS DOUBLE) END AS c{i}" for i in range(n))
        df = spark.range(400).selectExpr(*[c.strip() for c in cells.split(", CASE")][:1], *["CASE" + c for c in cells.split(", CASE")[1:]])
        plan = {c: [{"operation": "handle_missing_values", "method": "median"}, {"operation": "handle_outliers", "method": "isolation_forest"}] for c in df.columns}
        spark.sparkContext.setJobGroup(f"columns-{n}", "cleaning")
        out, log = apply_stage(df, plan, "cleaning")
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"columns-{n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(log) == 2 * n and {e.status for e in log} == {"completed"}
        assert out.where(" OR ".join(f"c{i} IS NULL" for i in range(n))).count() == 0
    assert jobs[2] == jobs[12] > 0
