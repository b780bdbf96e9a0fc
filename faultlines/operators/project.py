"""Result views: single diagnostic, whole log, public enum texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import lookup, string_list


def tool_text(value: Column) -> Column:
    return lookup(value, C.TOOL_TEXT, "unknown")


def severity_text(value: Column) -> Column:
    return lookup(value, C.SEVERITY_TEXT, "unknown")


def category_text(value: Column) -> Column:
    return F.coalesce(lookup(value, C.CATEGORY_TEXT), F.lower(value))


def input_type_text(value: Column) -> Column:
    return F.coalesce(lookup(value, C.INPUT_TYPE_TEXT), F.lower(value))


def fallback_causes(code: Column, category: Column) -> Column:
    """Cause list of a diagnostic that has no candidate."""
    chain = F.when(F.upper(code) == "CS0103", string_list(C.INSIGHTS_BY_CODE["CS0103"][2]))
    for name, causes in C.SINGLE_CAUSES_BY_CATEGORY.items():
        chain = chain.when(category == name, string_list(causes))
    return chain.otherwise(string_list(C.INSIGHT_DEFAULT[2]))


def single_view(candidates: DataFrame) -> DataFrame:
    """One row per log: its top candidate with that candidate's primary diagnostic.

    Rows with a null fingerprint stand for logs without diagnostics and get the fallbacks. Every diagnostic
    belongs to a group and every group gives a candidate, so the first-diagnostic fallback is the same row.
    """
    found = F.col("fingerprint").isNotNull()
    none = F.array().cast("array<string>")
    fields = F.struct(
        F.coalesce("rank", F.lit(2**30)).alias("rank"), "fingerprint", "primary", "explanation", "likely_causes",
        "suggested_fixes", "confidence", "tool_detected",
    )
    top = candidates.groupBy("log_id").agg(F.min_by(fields, fields["rank"]).alias("t")).select("log_id", "t.*")
    return top.select(
        "log_id",
        F.coalesce("fingerprint", F.lit(C.UNKNOWN_FINGERPRINT)).alias("fingerprint"),
        tool_text(F.col("tool_detected")).alias("tool"),
        F.col("primary.id").alias("diagnostic_id"),
        F.col("primary.code").alias("code"),
        F.when(found, severity_text(F.col("primary.severity"))).alias("severity"),
        F.when(found, category_text(F.col("primary.category"))).alias("category"),
        F.col("primary.message").alias("message"),
        F.when(found, F.col("explanation")).otherwise(F.lit(C.SINGLE_DEFAULT_EXPLANATION)).alias("explanation"),
        F.when(found, F.col("likely_causes")).otherwise(none).alias("likely_causes"),
        F.when(found, F.col("suggested_fixes")).otherwise(none).alias("suggested_fixes"),
        F.when(found, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
    )


def build_log_view(
    snapshots: DataFrame, include_diagnostics: bool = True, include_groups: bool = True, include_processing: bool = True
) -> DataFrame:
    """Whole-log view; parts that are switched off come out empty."""

    def part(flag: bool, column: str) -> Column:
        if flag:
            return F.col(column)
        kind = snapshots.schema[column].dataType
        empty = F.array() if kind.typeName() == "array" else F.lit(None)
        return empty.cast(kind).alias(column)

    return snapshots.select(
        "analysis_id", tool_text(F.col("tool_detected")).alias("tool"), "summary", "candidates",
        part(include_groups, "groups"), part(include_diagnostics, "diagnostics"), "narrative",
        part(include_processing, "processing"),
    )
