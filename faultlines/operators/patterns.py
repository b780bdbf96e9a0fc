"""Recurring patterns: occurrences, fold, merge and top lists.

The fold state keeps each value next to the (time, log) it was seen at, so folding is associative:
batches can be folded on their own and merged later, and map-side partial aggregation takes the load of
a hot fingerprint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import blank_to_null


def occurrences(diags: DataFrame) -> DataFrame:
    return diags.filter(F.col("fingerprint").isNotNull()).select(
        "fingerprint", F.col("log_id").alias("analysis_id"), "diagnostic_id", F.col("created_at").alias("seen_at")
    )


def pattern_rows(candidates: DataFrame) -> DataFrame:
    """One state row per (log, fingerprint), from candidates with ``latest`` and ``created_at``."""
    key = [F.col("created_at").alias("at"), F.col("log_id").alias("log_id")]
    code, fix = F.col("latest.code"), F.get("suggested_fixes", F.lit(0))
    return candidates.filter(F.col("fingerprint").isNotNull()).select(
        "fingerprint",
        F.col("count").cast("long").alias("occurrence_count"),
        F.struct(*key, F.col("title")).alias("first"),
        F.struct(
            *key, "latest.normalized_message", "latest.tool_kind", "latest.category"
        ).alias("last"),
        F.when(code.isNotNull(), F.struct(*key, code.alias("code"))).alias("code"),
        F.when(fix.isNotNull(), F.struct(*key, fix.alias("fix"))).alias("fix"),
    )


def fold_patterns(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fingerprint").agg(
        F.sum("occurrence_count").alias("occurrence_count"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.max("code").alias("code"),
        F.max("fix").alias("fix"),
    )


def merge_patterns(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return fold_patterns(stored.unionByName(batch))


def patterns(state: DataFrame) -> DataFrame:
    """The pattern table of a fold state."""
    fallback = F.when(F.col("code").isNull(), F.lit(C.PATTERN_TITLE_PLAIN)).otherwise(
        F.format_string(C.PATTERN_TITLE_CODE, F.col("code.code"))
    )
    return state.select(
        "fingerprint",
        F.coalesce(blank_to_null(F.col("first.title")), fallback).alias("title"),
        F.col("last.normalized_message").alias("canonical_message"),
        F.col("last.tool_kind").alias("tool_kind"),
        F.col("last.category").alias("category"),
        F.col("code.code").alias("diagnostic_code"),
        F.col("first.at").alias("first_seen_at"),
        F.col("last.at").alias("last_seen_at"),
        "occurrence_count",
        F.col("fix.fix").alias("last_suggested_fix"),
    )


def pattern_details(patterns: DataFrame, wanted: DataFrame) -> DataFrame:
    fixes = F.array_compact(F.array(blank_to_null(F.col("last_suggested_fix"))))
    return patterns.join(wanted.select("fingerprint").distinct(), "fingerprint", "left_semi").withColumn(
        "known_fixes", fixes
    )


def pattern_summaries(patterns: DataFrame, wanted: DataFrame) -> DataFrame:
    """Summaries of a fingerprint set, most frequent first."""
    return (
        patterns.join(wanted.select("fingerprint").distinct(), "fingerprint", "left_semi")
        .select(
            "fingerprint", "title", "tool_kind", "category", "occurrence_count", "last_seen_at", "diagnostic_code",
            "last_suggested_fix",
        )
        .orderBy(F.desc("occurrence_count"), F.desc("last_seen_at"), "fingerprint")
    )


def top_patterns(patterns: DataFrame, limit: int = C.DEFAULT_TOP_PATTERNS, tool: str | None = None) -> DataFrame:
    if not 1 <= limit <= C.MAX_TOP_PATTERNS:
        raise ValueError(f"Limit must be between 1 and {C.MAX_TOP_PATTERNS}.")
    chosen = patterns if tool is None else patterns.filter(F.col("tool_kind") == tool)
    return chosen.orderBy(F.desc("occurrence_count"), F.desc("last_seen_at"), "fingerprint").limit(limit)


def top_patterns_per_tool(patterns: DataFrame, limit: int = C.DEFAULT_TOP_PATTERNS) -> DataFrame:
    ranked = W.partitionBy("tool_kind").orderBy(F.desc("occurrence_count"), F.desc("last_seen_at"), "fingerprint")
    return patterns.withColumn("position", F.row_number().over(ranked)).filter(F.col("position") <= limit)
