"""Persisted tables: row layouts and writers.

Tables are Parquet. Analyses are partitioned by creation date where that is asked for; rows are brought
together by that date first, so a write makes few files per date, and a hot date is split by a second key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlines.functions.text import text_lit
from faultlines.sources.logs import content_hash

LOG_FACTS = ["log_id", "raw_content_hash", "raw_content", "raw_content_redacted"]


def persisted_only(logs: DataFrame) -> DataFrame:
    return logs.filter(F.coalesce(F.col("persist"), F.lit(False)))


def log_facts(logs_with_policy: DataFrame) -> DataFrame:
    """What is kept of the content itself, and the context map; input has gone through ``stored_raw_content``."""
    context = F.col("context") if "context" in logs_with_policy.columns else F.lit(None).cast("map<string,string>")
    return logs_with_policy.withColumn("raw_content_hash", content_hash(F.col("content"))).select(*LOG_FACTS, context.alias("context"))


def analysis_rows(narrated: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per analysis, from per-log narrative rows and the log facts."""
    return (
        narrated.drop("top_candidates", "top_groups", "fixes")
        .join(facts, "log_id", "left")
        .withColumnRenamed("log_id", "analysis_id")
        .withColumns(
            {
                "narrative_reason": text_lit(None),
                "narrative_provider": text_lit(None),
                "narrative_model": text_lit(None),
                "used_ai": F.lit(False),
            }
        )
    )


def diagnostic_rows(ordered: DataFrame) -> DataFrame:
    """One row per diagnostic; input has order_index."""
    return ordered.select(
        F.col("diagnostic_id").alias("id"), F.col("log_id").alias("analysis_id"), "tool_kind", "source", "code", "severity",
        "message", "normalized_message", "location", "raw_snippet", "category", "subcategory", "is_primary_candidate",
        "fingerprint", "metadata", "order_index",
    )


def group_rows(groups: DataFrame) -> DataFrame:
    """One row per group with a numbered id."""
    number = (F.col("order_index") + 1).cast("string")
    return groups.select(
        F.concat(F.lit("grp_"), F.col("log_id").cast("string"), F.lit("_"), number).alias("id"),
        F.col("log_id").alias("analysis_id"), "fingerprint", "count", "group_reason", "primary_diagnostic_id",
        "related_diagnostic_ids", "order_index",
    )


def snapshots(analyses: DataFrame, diagnostics: DataFrame, groups: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """One nested document per analysis: everything that its result had. All children are bounded by the log size limit."""

    def nested(child: DataFrame, order: list[str], name: str, *columns: str) -> DataFrame:
        item = F.struct(*order, *columns)
        return child.groupBy("analysis_id").agg(F.sort_array(F.collect_list(item)).alias(name))

    d = nested(
        diagnostics, ["order_index"], "diagnostics", "id", "tool_kind", "source", "code", "severity", "message", "normalized_message", "location", "raw_snippet",
        "category", "subcategory", "is_primary_candidate", "fingerprint", F.map_entries("metadata").alias("metadata"),
    )
    g = nested(groups, ["order_index"], "groups", "id", "fingerprint", "count", "group_reason", "primary_diagnostic_id", "related_diagnostic_ids")
    c = nested(candidates, ["rank"], "candidates", "fingerprint", "title", "explanation", "confidence", "signals", "likely_causes", "suggested_fixes")
    r = nested(matches, ["rule_id", "target_type", "target_id"], "matched_rules", "matched_conditions", "applied_actions", "applied_at")
    summary = F.struct("total_diagnostics", "group_count", "primary_issue_count", "error_count", "warning_count")
    none = F.array().cast("array<string>")
    return (
        analyses.select(
            "analysis_id", "input_type", "tool_detected", "created_at", "project_name", "repository", "raw_content_hash",
            "raw_content", "raw_content_redacted", "context", summary.alias("summary"), narrative_field().alias("narrative"),
            processing_field().alias("processing"), none.alias("warnings"),
        )
        .join(d, "analysis_id", "left")
        .join(g, "analysis_id", "left")
        .join(c, "analysis_id", "left")
        .join(r, "analysis_id", "left")
    )


def narrative_field() -> Column:
    return F.when(
        F.col("narrative_summary").isNotNull(),
        F.struct("narrative_summary", "group_summaries", "next_steps", "narrative_source", "narrative_status", "narrative_provider", "narrative_model", "narrative_reason"),
    )


def processing_field() -> Column:
    """Model tasks are those of answers that arrive as a table; a stored analysis starts without any."""
    return F.struct("used_ai", "parser_name", "parse_confidence", "total_segments", F.array().cast("array<string>").alias("tasks"))


def document_rows(documents: DataFrame, *keep: str) -> DataFrame:
    """Documents as flat rows: analysis_id, part, position, item. Parts whose column is absent, null or empty have no rows."""

    def line(*columns: Column) -> Column:
        return F.concat_ws("|", *[c.cast("string") for c in columns])

    def row(part: str, position: Column, item: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), position.cast("int").alias("position"), item.alias("item"))

    def each(part: str, item):
        return lambda x, i: row(part, i, item(x))

    lists = {
        "diagnostics": ("diagnostic", lambda d: line(d["id"], d["severity"], d["code"], d["category"], d["fingerprint"], d["message"], d["location"]["file_path"], d["location"]["line"])),
        "groups": ("group", lambda g: line(g["fingerprint"], g["count"], g["group_reason"], g["primary_diagnostic_id"], F.array_join(g["related_diagnostic_ids"], ","))),
        "candidates": ("candidate", lambda c: line(c["fingerprint"], c["title"], c["explanation"], F.array_join(c["suggested_fixes"], ","))),
        "matched_rules": ("rule", lambda r: line(r["rule_id"], r["target_type"], r["target_id"])),
        "warnings": ("warning", lambda w: w),
    }
    single = {
        "summary": ("summary", lambda s: line(s["total_diagnostics"], s["group_count"], s["primary_issue_count"], s["error_count"], s["warning_count"])),
        "narrative": ("narrative", lambda n: line(n["narrative_summary"], F.array_join(n["group_summaries"], " | "), F.array_join(n["next_steps"], " | "))),
        "processing": ("processing", lambda p: line(p["used_ai"], p["parser_name"])),
    }
    have, parts = set(documents.columns), []
    for name, (part, item) in lists.items():
        if name in have:
            parts.append(F.transform(F.col(name), each(part, item)))
    for name, (part, item) in single.items():
        if name in have:
            parts.append(F.when(F.col(name).isNotNull(), F.array(row(part, F.lit(0), item(F.col(name))))))
    if "context" in have:
        keys = F.array_sort(F.map_keys("context"))
        parts.append(F.transform(keys, lambda k, i: row("context", i, F.concat(k, F.lit("="), F.col("context")[k]))))
    if "raw_content_hash" in have:
        content = line(F.col("raw_content_hash"), F.col("raw_content").isNotNull(), F.col("raw_content_redacted"))
        parts.append(F.array(row("content", F.lit(0), content)))
    rows = F.flatten(F.array_compact(F.array(*parts)))
    return documents.select("analysis_id", *keep, F.explode(rows).alias("r")).select("analysis_id", *keep, "r.*")


def status_notes(logs: DataFrame, failed: DataFrame, notes: Column) -> DataFrame:
    """Note per log after a write: a failed write is appended to the notes, it is not an error.

    failed: log_id, error - the logs of the batches whose write failed.
    """
    reason = F.concat(F.lit("persistence-failure:"), F.col("error"))
    return logs.join(failed, "log_id", "left").select(
        "log_id",
        (F.coalesce(F.col("persist"), F.lit(False)) & F.col("error").isNull()).alias("persisted"),
        F.nullif(F.concat_ws("; ", notes, F.when(F.col("persist"), reason)), F.lit("")).alias("notes"),
    )


DATE = "created_date"


def dated(df: DataFrame, by_date: str, unit: str = "day") -> DataFrame:
    """Adds the partition column: the first day of the unit (day, month) that the time lies in."""
    return df.withColumn(DATE, F.to_date(F.date_trunc(unit, by_date)))


def write_table(df: DataFrame, path: str, by_date: str | None = None, mode: str = "overwrite", unit: str = "day") -> None:
    """Writes a table; with ``by_date`` the partition column created_date is derived from that column."""
    if by_date is None:
        df.write.mode(mode).parquet(path)
        return
    spread = F.pmod(F.xxhash64(*[c for c in ("analysis_id", "log_id") if c in df.columns][:1]), F.lit(16))
    dated(df, by_date, unit).repartition(DATE, spread).write.mode(mode).partitionBy(DATE).parquet(path)
