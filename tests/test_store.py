"""Writes that can fail, admission, snapshots with live raw content, retention of single partitions."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from faultlines.operators import history as H
from faultlines.operators import privacy as V
from faultlines.sources import commits, intake, sinks
from faultlines.sources.logs import LOG_SCHEMA


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def test_a_failed_batch_is_not_read_and_stops_no_other(spark, folder):
    df = spark.createDataFrame([(i, f"b{i % 4}" if i % 5 else None) for i in range(40)], "id long, batch string")

    def sink(own, path):
        if own.first().batch == "b2":
            commits.write_parquet(own.limit(2), path)
            raise TimeoutError("sink")
        commits.write_parquet(own, path)

    failed = commits.commit(df, folder, "batch", sink)
    assert [tuple(r) for r in failed.collect()] == [("b2", "TimeoutError")]
    readable = {r.id for r in commits.read(spark, folder, df.schema).collect()}
    assert readable == {r.id for r in df.collect() if r.batch != "b2"}
    assert {r.batch: r.n_rows for r in commits.committed(spark, folder).collect()} == {"b0": 8, "b1": 8, "b3": 8, None: 8}
    # the batch is written again, another one is replaced
    more = spark.createDataFrame([(100, "b2"), (101, "b1")], df.schema)
    assert commits.commit(more, folder, "batch").count() == 0
    readable = {r.id for r in commits.read(spark, folder, df.schema).collect()}
    assert readable == {r.id for r in df.collect() if r.batch not in ("b1", "b2")} | {100, 101}


def test_a_write_that_spark_fails(spark, folder):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, batch string")
    checked = df.withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("bad row")).cast("int")).otherwise(F.lit(1)))
    assert [r.batch for r in commits.commit(checked, folder, "batch").collect()] == ["y"]
    assert [r.id for r in commits.read(spark, folder, checked.schema).collect()] == [1]


def test_nothing_committed(spark, folder):
    assert commits.read(spark, folder, "id int").count() == 0 and commits.committed(spark, folder).count() == 0


def test_admission_writes_both_sides_once(spark, folder):
    rows = [
        ("good", "text", "BuildLog", "tsc", "p", "r", None, True, True), ("blank", " \n", "BuildLog", None, "p", "r", None, True, False),
        ("tool", "text", "BuildLog", "cobol", None, None, None, True, False), ("two", None, "BuildLog", "cobol", "p", "r", None, False, True),
        ("nulls", "text", "BuildLog", None, None, None, None, None, None),
    ]
    found = intake.admit(spark.createDataFrame(rows, LOG_SCHEMA), folder)
    assert (found.accepted_count, found.rejected_count) == (2, 3)
    assert {r.log_id for r in found.accepted.collect()} == {"good", "nulls"}
    assert found.accepted.columns == LOG_SCHEMA.fieldNames()
    by_log = {}
    for r in intake.rejections(found.rejected).collect():
        by_log.setdefault(r.log_id, []).append(r.field)
    assert {k: sorted(v) for k, v in by_log.items()} == {"blank": ["content"], "tool": ["tool"], "two": ["content", "options.persistRawContent", "tool"]}
    assert found.rejected.filter("content is not null").count() == 0
    none = intake.admit(spark.createDataFrame([], LOG_SCHEMA), folder + "/none")
    assert (none.accepted_count, none.rejected_count, none.accepted.count()) == (0, 0, 0)


def _analyses(spark, days):
    rows = [(i, f"raw {i}" if i % 2 else None, bool(i % 2)) for i in range(days * 3)]
    df = spark.createDataFrame(rows, "analysis_id long, raw_content string, raw_content_redacted boolean")
    return df.withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("analysis_id") / 3).cast("int") * 86400))


def _files(tmp_path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path / "table") for f in fs if f.endswith(".parquet")}


def test_retention_rewrites_only_the_partitions_that_are_due(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    df = _analyses(spark, 30)
    sinks.write_table(df, path, "created_at")

    def as_of(day):
        return F.timestamp_seconds(F.lit(1_700_000_000 + day * 86400 + 60))

    report = V.retention_report(spark.read.parquet(path), as_of(20), 10, 15)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan and "created_date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = V.apply_retention(df, as_of(20), 10, 15)
    counts = tuple(report.first())
    assert counts == (sum(i % 2 for i in range(33)), 18)
    before = _files(tmp_path)
    touched = V.retain(spark, path, as_of(20), 10, 15, f"file://{tmp_path}/rest1")
    assert len(touched) == 11
    assert sorted(map(tuple, spark.read.parquet(path).drop("created_date").select(df.columns).collect())) == sorted(map(tuple, want.collect()))
    after = _files(tmp_path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("created_date=")[1][:10] for f in same} == {r[0] for r in df.selectExpr("cast(to_date(created_at) as string)").distinct().collect()} - set(touched)
    # seven days later only days with rows to delete (6 to 12) or to purge (11 to 17) are written again
    touched = V.retain(spark, path, as_of(27), 10, 15, f"file://{tmp_path}/rest2")
    assert len(touched) == 12 and sorted(r[0] for r in spark.read.parquet(path).filter("raw_content is not null").select("analysis_id").collect()) == [i for i in range(90) if i % 2 and i // 3 > 17]
    assert V.retain(spark, path, as_of(27), 10, 15, f"file://{tmp_path}/rest3") == []
    assert V.retain(spark, path, as_of(27), None, 0, f"file://{tmp_path}/rest4") == []


def test_snapshot_with_live_raw_content_and_rebuilt_document(spark):
    analyses = spark.createDataFrame(
        [(1, "live", False, None), (2, "old", True, {"branch": "main"})], "analysis_id long, raw_content string, raw_content_redacted boolean, context map<string,string>"
    )
    for name, kind in {
        "input_type": "string", "tool_detected": "string", "created_at": "timestamp", "project_name": "string", "repository": "string", "raw_content_hash": "string",
        "total_diagnostics": "int", "group_count": "int", "primary_issue_count": "int", "error_count": "int", "warning_count": "int", "narrative_summary": "string",
        "group_summaries": "array<string>", "next_steps": "array<string>", "narrative_source": "string", "narrative_status": "string", "narrative_provider": "string",
        "narrative_model": "string", "narrative_reason": "string", "used_ai": "boolean", "parser_name": "string", "parse_confidence": "double", "total_segments": "int",
    }.items():
        analyses = analyses.withColumn(name, F.lit(None).cast(kind))
    d = spark.sql(
        """SELECT * FROM VALUES ('d0', 2L, 'Cobol', 'Severe', 'Odd', ' ', 0), ('d1', 2L, 'DotNet', 'Warning', 'Syntax', 'fp', 1)
        AS t(id, analysis_id, tool_kind, severity, category, fingerprint, order_index)"""
    ).selectExpr(
        "*", "'s' source", "'c' code", "'m' message", "'m' normalized_message", "named_struct('file_path', 'f', 'line', 1) location", "'r' raw_snippet", "'' subcategory",
        "true is_primary_candidate", "map('k', 'v') metadata",
    )
    g = spark.sql(
        """SELECT * FROM VALUES ('g0', 2L, 'fp', 2, NULL, '', array('d1', 'd0'), 0), ('g1', 2L, 'fq', 1, 'why', NULL, array(), 1)
        AS t(id, analysis_id, fingerprint, count, group_reason, primary_diagnostic_id, related_diagnostic_ids, order_index)"""
    ).withColumn("related_diagnostic_ids", F.col("related_diagnostic_ids").cast("array<string>"))
    c = spark.createDataFrame([], "analysis_id long, rank int, fingerprint string, title string, explanation string, confidence double, signals array<string>, likely_causes array<string>, suggested_fixes array<string>")
    m = spark.createDataFrame([(1, 7, "group", "d9")], "analysis_id long, rule_id int, target_type string, target_id string").selectExpr(
        "*", "array('tool') matched_conditions", "array('title') applied_actions", "current_timestamp() applied_at"
    )
    snapshots = sinks.snapshots(analyses.filter("analysis_id = 1").withColumn("raw_content", F.lit("stale")), d, g, c, m)
    found = {r.analysis_id: r for r in H.get_analyses(analyses.select("analysis_id"), analyses, snapshots, d, g).collect()}
    assert (found[1].origin, found[1].raw_content, found[1].matched_rules[0].rule_id) == ("snapshot", "live", 7)
    old = found[2]
    assert (old.origin, old.raw_content, old.context, old.matched_rules) == ("rebuilt", "old", {"branch": "main"}, None)
    assert [(x.tool_kind, x.severity, x.category, x.fingerprint) for x in old.diagnostics] == [("Unknown", "Error", "Unknown", None), ("DotNet", "Warning", "Syntax", "fp")]
    assert [(x.primary_diagnostic_id, x.group_reason) for x in old.groups] == [("d1", "exact-fingerprint-dedupe"), ("diag_unknown", "why")]
