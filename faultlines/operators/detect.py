"""Tool detection and parser selection: narrow, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import (
    IGNORE_CASE,
    IGNORE_CASE_LINES,
    ci_contains,
    ci_contains_any,
    lookup,
    matches,
    normalize_newlines,
    text_lit,
)
from faultlines.operators.patterns_text import PYTHON_LAST_LINE_EXCEPTION
from faultlines.sources.logs import parse_tool


def detect_tool(logs: DataFrame) -> DataFrame:
    """Adds tool_detected, detection_confidence, detection_reason and was_explicit_hint."""
    content, lowered = F.col("content"), F.col("_lowered")
    dotnet = (
        matches(content, C.DETECT_DOTNET_CODE, IGNORE_CASE)
        | ci_contains(lowered, C.DETECT_DOTNET_MARKER)
        | matches(content, C.DETECT_DOTNET_PROJECT_END, IGNORE_CASE_LINES)
    )
    found = (
        F.when(F.col("_hint").isNotNull(), F.lit("hint"))
        .when(ci_contains_any(lowered, C.DETECT_VITE_MARKERS), F.lit("Vite"))
        .when(dotnet, F.lit("DotNet"))
        .when(matches(content, C.DETECT_TYPESCRIPT_CODE, IGNORE_CASE), F.lit("TypeScript"))
        .when(ci_contains_any(lowered, C.DETECT_NPM_MARKERS), F.lit("Npm"))
        .when(ci_contains(lowered, C.DETECT_PYTHON_MARKER), F.lit("Python"))
        .otherwise(F.lit("Unknown"))
    )
    return (
        logs.withColumns({"_lowered": F.lower("content"), "_hint": parse_tool(F.col("tool_hint"))})
        .withColumn("_found", found)
        .withColumns(
            {
                "tool_detected": F.coalesce(F.col("_hint"), F.col("_found")),
                "detection_confidence": lookup(F.col("_found"), {k: v[0] for k, v in C.DETECTION.items()}),
                "detection_reason": lookup(F.col("_found"), {k: v[1] for k, v in C.DETECTION.items()}),
                "was_explicit_hint": F.col("_hint").isNotNull(),
            }
        )
        .drop("_lowered", "_hint", "_found")
    )


def _acceptance(content: Column, lowered: Column) -> list[tuple[str, Column]]:
    """What each parser accepts when no tool was named, in order of registration."""
    last_line = F.regexp_replace(normalize_newlines(content), r"(?Ud)\s+\z", "")
    return [
        (
            "DotNet",
            ci_contains_any(lowered, C.ACCEPT_DOTNET_MARKERS) | matches(content, C.ACCEPT_DOTNET_CODE, IGNORE_CASE),
        ),
        (
            "TypeScript",
            ci_contains_any(lowered, C.ACCEPT_TYPESCRIPT_MARKERS)
            | matches(content, C.ACCEPT_TYPESCRIPT_CODE, IGNORE_CASE)
            | matches(content, C.TYPESCRIPT_HEADER, IGNORE_CASE),
        ),
        ("Vite", ci_contains_any(lowered, C.DETECT_VITE_MARKERS)),
        ("Npm", ci_contains_any(lowered, C.DETECT_NPM_MARKERS)),
        ("Python", ci_contains(lowered, C.DETECT_PYTHON_MARKER) | matches(last_line, PYTHON_LAST_LINE_EXCEPTION)),
    ]


def select_parser(detected: DataFrame) -> DataFrame:
    """Adds parser_tool, parser_name and failure_reason."""
    tool = F.col("tool_detected")
    chosen = F.when(tool.isin(list(C.PARSER_NAMES)), tool)
    for kind, accepts in _acceptance(F.col("content"), F.lower("content")):
        chosen = chosen.when(accepts, F.lit(kind))
    return detected.withColumn("parser_tool", chosen).withColumns(
        {
            "parser_name": lookup(F.col("parser_tool"), C.PARSER_NAMES),
            "failure_reason": F.when(F.col("parser_tool").isNotNull(), text_lit(None))
            .when(tool == "Unknown", F.lit(C.NO_PARSER_UNKNOWN))
            .otherwise(F.format_string(C.NO_PARSER_TOOL, tool)),
        }
    )
