from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultlines.functions.redact import redact_log, redact_raw
from faultlines.functions.similarity import tokens
from faultlines.functions.text import ci_distinct, round_half_up, utf16_length
from faultlines.operators import enrich as EN
from faultlines.operators.history import snippet
from faultlines.sources import logs as S


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v")).alias("r")).first()["r"]


def test_log_redaction(spark):
    text = (
        "Failure at C:\\repo\\app\\Program.cs while calling https://api.example.com/v1/chat?api_key=secret123 for "
        "admin@example.com with token=abc123"
    )
    got = one(spark, text, redact_log)
    for gone in ("C:\\repo", "https://", "admin@example.com", "secret123", "abc123"):
        assert gone not in got
    for kept in ("<redacted:path>", "<redacted:url>", "<redacted:email>", "token=<redacted>"):
        assert kept in got
    assert one(spark, "a" * 400, lambda c: redact_log(c, 32)) == "a" * 32 + "…"
    assert one(spark, "  ", redact_log) == "  " and one(spark, None, redact_log) is None
    again = one(spark, got, redact_log)
    assert again == got


def test_raw_redaction(spark):
    text = "error. token=abc123 contact dev@example.com see https://example.com and C:\\src\\Program.cs\nsecret: token=x /usr/bin/x"
    got = one(spark, text, redact_raw)
    assert got == (
        "error. token=[redacted-token] contact [redacted-email] see [redacted-url] and [redacted-path]\n"
        "secret=[redacted-secret] [redacted-path]"
    )


def test_snippet(spark):
    text = "x" * 100 + " needle\n\n here " + "y" * 100
    got = one(spark, text, lambda c: snippet(c, "NEEDLE"))
    assert got == "..." + ("x" * 100 + " needle here " + "y" * 100)[41:167] + "..."
    assert one(spark, "z" * 200, lambda c: snippet(c, "q")) == "z" * 140 + "..."


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aAbB", max_size=3), max_size=8))
def test_ci_distinct(spark, values):
    df = spark.createDataFrame([(values,)], "v array<string>")
    seen, want = set(), []
    for v in values:
        if v.lower() not in seen:
            seen.add(v.lower())
            want.append(v)
    assert df.select(ci_distinct(F.col("v")).alias("r")).first()["r"] == want


@pytest.mark.parametrize(("value", "want"), [(0.545, 0.55), (0.125, 0.13), (1.005, 1.0), (0.99, 0.99)])
def test_round_half_up(spark, value, want):
    assert spark.range(1).select(round_half_up(F.lit(value), 2).alias("r")).first()["r"] == want


def test_tokens(spark):
    assert one(spark, "Cannot find_name 'x' in\u00a0Scope: cannot", tokens) == ["cannot", "find", "name", "in\u00a0scope"]
    assert one(spark, "\u00a0ab\u00a0 abc\u2003", tokens) == ["abc"]


def test_oversize_logs_are_left_out_before_assembly(spark):
    small = [(1, i, "abc") for i in range(3)]
    chunks = spark.createDataFrame(small, "log_id long, n int, chunk string").unionByName(
        spark.range(40_000).select(F.lit(2).cast("long").alias("log_id"), F.col("id").cast("int").alias("n"), F.lit("step 1 ok").alias("chunk"))
    )
    assert [r["log_id"] for r in S.oversize_logs(chunks, utf16_length(F.col("chunk"))).collect()] == [2]
    assert [tuple(r) for r in S.assemble_logs(chunks).collect()] == [(1, "abc\nabc\nabc")]


def test_length_is_counted_in_utf16_units(spark):
    text = "\U0001f600" * 130_000
    row = spark.createDataFrame([("x", text, None, True, False)], "log_id string, content string, tool_hint string, persist boolean, store_raw boolean")
    assert [r["field"] for r in S.request_errors(row).collect()] == ["content"]
    assert S.accepted(row).count() == 0


def test_text_file_source(spark, tmp_path):
    (tmp_path / "a.log").write_text("Traceback (most recent call last):\nValueError: x\n")
    row = S.read_log_files(spark, str(tmp_path)).first()
    assert row["log_id"].endswith("a.log") and row["content"].startswith("Traceback") and row["created_at"]


def test_answers(spark):
    raw = [
        ("a", "  plain\n\n text "),
        ("b", '```json\n{"explanation": " x\\n y", "likelyCauses": ["A", 5, " a ", ""], "suggestedFixes": "no"}\n```'),
        ("c", '{"explanation": 5}'),
        ("d", '{"explanation": '),
        ("e", None),
    ]
    rows = {r["log_id"]: r for r in EN.parse_explanations(spark.createDataFrame(raw, "log_id string, raw_output string")).collect()}
    assert rows["a"]["text"] == "plain text" and rows["a"]["readable"]
    assert (rows["b"]["text"], rows["b"]["first_list"], rows["b"]["second_list"]) == ("x y", ["A"], [])
    assert rows["c"]["text"] == "" and rows["c"]["readable"]
    assert not rows["d"]["readable"] and rows["e"]["text"] == ""
