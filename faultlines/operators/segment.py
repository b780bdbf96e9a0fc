"""Segmentation: the stretches of a log that each describe one diagnostic.

A segment is a run of neighbouring lines, so one possessive regex per tool finds all segments of a log
in a single pass inside the row: no line explosion, no window, no shuffle. Possessive repetition is
iterative, so long segments cannot overflow the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlines.functions.text import IGNORE_CASE_LINES, capture, normalize_newlines, pattern, rtrim_lines, ws_trim
from faultlines.operators import patterns_text as P
from faultlines.session import per_session

PASS_THROUGH = [
    "log_id", "input_type", "tool_detected", "parser_tool", "parser_name", "project_name", "repository", "created_at",
]


def dotnet_segments(lines: Column) -> Column:
    found = F.regexp_extract_all(lines, pattern(P.DOTNET_SEGMENT, IGNORE_CASE_LINES), F.lit(0))
    return F.transform(found, lambda s: F.regexp_replace(s, rf"(?U)\n{P.H}+", "\n"))


def typescript_segments(lines: Column) -> Column:
    return F.regexp_extract_all(lines, pattern(P.TYPESCRIPT_SEGMENT, IGNORE_CASE_LINES), F.lit(0))


def python_segments(lines: Column, content: Column) -> Column:
    parts = F.split(lines, f"(?Uidm)^(?={P.PYTHON_HEADER})")
    found = F.filter(parts, lambda p: F.regexp_like(p, pattern(rf"\A{P.PYTHON_HEADER}", "Uid")))
    whole = F.when(
        capture(normalize_newlines(content), P.PYTHON_EXCEPTION, 3, anchored=True).isNotNull(),
        F.array(ws_trim(content)),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, F.transform(found, ws_trim)).otherwise(whole)


def segment_logs(selected: DataFrame) -> DataFrame:
    """Adds segments ARRAY<STRING> and total_segments; the content itself is dropped."""
    lines, segments = _segment_columns()
    keep = [c for c in selected.columns if c != "content"]
    return (
        selected.withColumn("_lines", lines)
        .select(*keep, segments.alias("segments"))
        .withColumn("total_segments", F.size("segments"))
    )


@per_session
def _segment_columns() -> tuple[Column, Column]:
    tool, content = F.col("parser_tool"), F.col("content")
    segments = (
        F.when(tool == "DotNet", dotnet_segments(F.col("_lines")))
        .when(tool == "TypeScript", typescript_segments(F.col("_lines")))
        .when(tool == "Python", python_segments(F.col("_lines"), content))
        .when(tool.isin("Npm", "Vite"), F.array(ws_trim(content)))
        .otherwise(F.array().cast("array<string>"))
    )
    lines = F.when(tool.isin("DotNet", "TypeScript", "Python"), rtrim_lines(normalize_newlines(content)))
    return lines, segments


def explode_segments(segmented: DataFrame) -> DataFrame:
    """One row per segment; a log without segments keeps one row with a null segment."""
    keep = [c for c in segmented.columns if c != "segments"]
    return segmented.select(*keep, F.posexplode_outer("segments").alias("seg", "segment"))
