"""The analysis job: logs -> segments -> diagnostics, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.operators import narrative, rules as R
from faultlines.operators.detect import detect_tool, select_parser
from faultlines.operators.extract import extract_segments, recognise_segments
from faultlines.operators.group import LOG_FIELDS, group_rows, groups
from faultlines.operators.rank import candidates
from faultlines.operators.segment import explode_segments, segment_logs

LOG_COLUMNS = ["log_id", "content", "input_type", "tool_hint", "project_name", "repository", "created_at"]


def selected(logs: DataFrame) -> DataFrame:
    return select_parser(detect_tool(logs.select(*LOG_COLUMNS)))


def extracted(logs: DataFrame) -> DataFrame:
    """Narrow from logs to segment rows with diagnostic fields: no exchange of its own."""
    return extract_segments(explode_segments(segment_logs(selected(logs))))


def recognised(logs: DataFrame) -> DataFrame:
    """Segment rows with ``parsed`` only, for counts and for what no format fits."""
    return recognise_segments(explode_segments(segment_logs(selected(logs))))


def ranked(segment_rows: DataFrame) -> DataFrame:
    """Candidates of every log, before rules."""
    return candidates(groups(group_rows(segment_rows)))


def applied(segment_rows: DataFrame, rules: DataFrame, stored: bool = True) -> DataFrame:
    """Candidates after rules. With an inlinable rule table this is one pass over the segment rows:
    rule hits are collected while grouping, so diagnostics are not read again to match them."""
    local = R.local_rules(rules)
    if local is None:
        grouped = groups(group_rows(segment_rows))
        applications = R.match_diagnostics(segment_rows.filter("parsed"), rules, stored).unionByName(
            R.match_groups(grouped, rules, stored)
        )
        return R.apply_applications(candidates(grouped), applications, rules)
    hits = R.inline_hits(local, R.diagnostic_predicate, stored)
    marked = segment_rows.withColumn("_diagnostic_hits", F.when(F.col("parsed"), hits))
    rows = group_rows(marked, {"diagnostic_hits": F.flatten(F.collect_list("_diagnostic_hits"))})
    own = candidates(groups(rows))
    all_hits = F.concat("diagnostic_hits", R.inline_hits(local, R.group_predicate, stored))
    return R.apply_hits(own, local, all_hits).drop("diagnostic_hits")


def with_empty_logs(candidate_rows: DataFrame, segment_rows: DataFrame) -> DataFrame:
    """Adds one row with a null fingerprint for each log without diagnostics."""
    empty = (
        segment_rows.groupBy("log_id")
        .agg(F.count_if("parsed").cast("int").alias("count"), *[F.first(c).alias(c) for c in LOG_FIELDS])
        .filter("count = 0")
        .withColumns(
            {"parse_confidence": F.lit(0.0), "error_count": F.lit(0), "warning_count": F.lit(0)}
        )
    )
    return candidate_rows.unionByName(empty, allowMissingColumns=True)


def narrated(candidate_rows: DataFrame) -> DataFrame:
    """One row per log with summary counts and narrative."""
    return narrative.with_narrative(narrative.log_rows(candidate_rows))
