"""Grouping per log and fingerprint, and the per-log summary.

All aggregates are keyed by log_id first. When the input is already hash-partitioned by log_id (logs
assembled from chunks are), grouping by (log_id, fingerprint) and the windows per log add no exchange.
A log is bounded by the size limit, so none of these groups can grow without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import lookup, round_half_up

LOG_FIELDS = [
    "input_type", "tool_detected", "parser_name", "project_name", "repository", "created_at", "total_segments",
]


def signal_score(severity: Column) -> Column:
    return lookup(severity, C.SEVERITY_SCORE, 0)


def group_rows(extracted: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per (log, fingerprint); a log without diagnostics keeps one row with a null fingerprint.

    ``primary`` is the member with the strongest severity, then the first in source order; ``latest`` the
    last member in source order.
    """
    order = [(-signal_score(F.col("severity"))).alias("weight"), F.col("seg")]
    log_fields = [c for c in LOG_FIELDS if c in extracted.columns]
    member = F.struct(*order, F.col("diagnostic_id").alias("id"))
    primary = F.struct(
        *order, F.col("diagnostic_id").alias("id"), "code", "severity", "category", "message", "normalized_message",
        F.col("parser_tool").alias("tool_kind"), "location",
    )
    latest = F.struct("seg", "normalized_message", F.col("parser_tool").alias("tool_kind"), "category", "code")
    rows = extracted.groupBy("log_id", "fingerprint").agg(
        *[F.first(c).alias(c) for c in log_fields],
        F.count_if("parsed").cast("int").alias("count"),
        F.count_if(F.col("severity").isin("Error", "Fatal")).cast("int").alias("error_count"),
        F.count_if(F.col("severity") == "Warning").cast("int").alias("warning_count"),
        F.sort_array(F.collect_list(F.when(F.col("parsed"), member))).alias("members"),
        F.min(F.when(F.col("parsed"), primary)).alias("primary"),
        F.max(F.when(F.col("parsed"), latest)).alias("latest"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    parsed = F.sum("count").over(W.partitionBy("log_id"))
    ratio = round_half_up(parsed / F.col("total_segments"), 4)
    return rows.withColumn(
        "parse_confidence", F.when(F.col("total_segments") > 0, ratio).otherwise(F.lit(0.0))
    )


def groups(rows: DataFrame) -> DataFrame:
    """Groups in order: largest first, then by primary diagnostic."""
    ordered = W.partitionBy("log_id").orderBy(F.desc("count"), F.col("primary.seg"))
    return rows.filter(F.col("fingerprint").isNotNull()).withColumns(
        {
            "primary_diagnostic_id": F.col("primary.id"),
            "related_diagnostic_ids": F.transform("members", lambda m: m["id"]),
            "group_reason": F.when(F.col("count") == 1, F.lit(C.GROUP_REASON_SINGLE)).otherwise(
                F.lit(C.GROUP_REASON_MANY)
            ),
            "order_index": F.row_number().over(ordered) - 1,
        }
    )


def summary(rows: DataFrame) -> DataFrame:
    """Five counts per log and the fingerprint of each diagnostic; every group gives exactly one candidate,
    so primary issues equal groups."""
    found = F.count("fingerprint").cast("int")
    fields = [c for c in LOG_FIELDS if c in rows.columns]
    return rows.groupBy("log_id").agg(
        *[F.first(c).alias(c) for c in fields],
        F.first("parse_confidence").alias("parse_confidence"),
        F.sum("count").cast("int").alias("total_diagnostics"),
        found.alias("group_count"),
        found.alias("primary_issue_count"),
        F.sum("error_count").cast("int").alias("error_count"),
        F.sum("warning_count").cast("int").alias("warning_count"),
        F.sort_array(
            F.flatten(F.collect_list(F.when(F.col("count") > 0, F.array_repeat("fingerprint", F.col("count")))))
        ).alias("fingerprints"),
    )
