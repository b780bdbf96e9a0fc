"""Telemetry roll-ups over analysis events and HTTP accesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlines.functions.text import blank_to_null, ws_trim


def events(analyses: DataFrame) -> DataFrame:
    """One event per analysis row; see ``analysis_totals`` for what is counted."""
    return analyses.select(
        F.col("log_id"),
        "input_type",
        "tool_detected",
        F.col("parser_name").alias("parser"),
        F.lit(True).alias("succeeded"),
        (F.col("parser_name").isNotNull() & (F.col("total_diagnostics") > 0)).alias("parse_succeeded"),
        "ai_requested",
        "ai_completed",
        "persistence_requested",
        "persistence_succeeded",
        (
            (F.col("tool_detected") == "Unknown")
            | (F.col("total_diagnostics") == 0)
            | (F.col("primary_issue_count") == 0)
        ).alias("is_unmatched"),
        "duration_ms",
        F.col("total_diagnostics").alias("diagnostics_count"),
        "group_count",
        F.col("primary_issue_count").alias("candidate_count"),
        "fingerprints",
        "created_at",
    )


def _average(total: Column) -> Column:
    n = F.count(F.lit(1))
    return F.when(n == 0, F.lit(0.0)).otherwise(total.cast("double") / n)


def _duration() -> Column:
    return F.greatest(F.lit(1), F.col("duration_ms"))


def analysis_totals(events: DataFrame) -> DataFrame:
    """Totals, averages and rates in one global partial aggregation."""
    return events.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("succeeded").alias("completed"),
        F.count_if(~F.col("succeeded")).alias("failed"),
        F.count_if(~F.col("parse_succeeded")).alias("parse_failures"),
        F.count_if("ai_requested").alias("ai_requested"),
        F.count_if("ai_completed").alias("ai_completed"),
        F.count_if(F.col("persistence_requested") & ~F.col("persistence_succeeded")).alias("persistence_failures"),
        F.count_if("is_unmatched").alias("unmatched"),
        _average(F.sum(_duration())).alias("average_duration_ms"),
        _average(F.sum(F.greatest(F.lit(0), F.col("diagnostics_count")))).alias("average_diagnostics"),
        _average(F.count_if("ai_requested")).alias("ai_request_rate"),
        _average(F.count_if("is_unmatched")).alias("unmatched_rate"),
    )


def counts_by(df: DataFrame, value: Column, fallback: str | None = "unknown", limit: int | None = None) -> DataFrame:
    """name, count: most frequent first, then by name with case ignored."""
    name = blank_to_null(ws_trim(value.cast("string")))
    named = df.select((F.coalesce(name, F.lit(fallback)) if fallback is not None else name).alias("name"))
    counted = named.filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("count"))
    ordered = counted.orderBy(F.desc("count"), F.lower("name"), "name")
    return ordered if limit is None else ordered.limit(limit)


def fingerprint_counts(events: DataFrame, limit: int) -> DataFrame:
    exploded = events.select(F.explode("fingerprints").alias("fingerprint"))
    return counts_by(exploded, F.col("fingerprint"), None, limit)


def top_counts(events: DataFrame, fingerprint_limit: int) -> DataFrame:
    """section, name, count of tools, parsers and the most frequent fingerprints, from one pass over the events."""

    def entry(section: str, name: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), blank_to_null(ws_trim(name)).alias("name"))

    tool = F.coalesce(blank_to_null(ws_trim(F.col("tool_detected"))), F.lit("unknown"))
    named = F.concat(
        F.array(entry("tool", tool), entry("parser", F.col("parser"))),
        F.transform(F.coalesce("fingerprints", F.array().cast("array<string>")), lambda f: entry("fingerprint", f)),
    )
    counted = events.select(F.explode(named).alias("e")).select("e.*").filter(F.col("name").isNotNull()).groupBy("section", "name").agg(
        F.count(F.lit(1)).alias("count")
    )
    order = W.partitionBy("section").orderBy(F.desc("count"), F.lower("name"), "name")
    kept = (F.col("section") != "fingerprint") | (F.col("position") <= fingerprint_limit)
    return counted.withColumn("position", F.row_number().over(order)).filter(kept).drop("position")


def metric_tags(events: DataFrame) -> DataFrame:
    """Counts and durations by tool, input type and parser, with sub-totals per tool and in total."""

    def tag(column: str, fallback: str) -> Column:
        return F.coalesce(blank_to_null(ws_trim(F.col(column))), F.lit(fallback)).alias(f"{column}_tag")

    tagged = events.select(
        tag("tool_detected", "unknown"), tag("input_type", "unknown"), tag("parser", "none"), "succeeded",
        "parse_succeeded", _duration().alias("duration_ms"),
        F.greatest(F.lit(0), F.col("diagnostics_count")).alias("diagnostics_count"),
    )
    return (
        tagged.rollup("tool_detected_tag", "input_type_tag", "parser_tag")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("requests"),
            F.count_if("succeeded").alias("succeeded"),
            F.count_if("parse_succeeded").alias("parsed"),
            F.sum("duration_ms").alias("duration_ms"),
            F.sum("diagnostics_count").alias("diagnostics"),
        )
    )


def http_totals(accesses: DataFrame) -> DataFrame:
    """section, name, count rows: methods, status codes and routes of an access table."""
    sections = F.explode(
        F.array(
            F.struct(F.lit("method").alias("section"), F.col("method").alias("name")),
            F.struct(F.lit("route").alias("section"), F.col("route").alias("name")),
            F.struct(F.lit("status").alias("section"), F.col("status").cast("string").alias("name")),
        )
    )
    named = accesses.select(sections.alias("s"), _duration().alias("duration_ms")).select(
        "s.section", F.coalesce(blank_to_null(ws_trim(F.col("s.name"))), F.lit("unknown")).alias("name"), "duration_ms"
    )
    return named.groupBy("section", "name").agg(
        F.count(F.lit(1)).alias("count"), F.avg("duration_ms").alias("average_duration_ms")
    )


def http_summary(accesses: DataFrame, routes: int) -> DataFrame:
    """``http_totals`` in order within each section, at most max(5, routes) routes, and one row for all requests."""
    sections = http_totals(accesses)
    order = W.partitionBy("section").orderBy(F.desc("count"), F.lower("name"), "name")
    total = accesses.agg(F.count(F.lit(1)).alias("count"), F.avg(_duration()).alias("average_duration_ms")).select(
        F.lit("all").alias("section"), F.lit("requests").alias("name"), "count", "average_duration_ms"
    )
    return (
        sections.unionByName(total)
        .withColumn("position", F.row_number().over(order))
        .filter((F.col("section") != "route") | (F.col("position") <= max(5, routes)))
    )
