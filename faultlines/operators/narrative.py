"""Deterministic narrative of a log: summary text, group texts and next steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import (
    bound,
    ci_distinct,
    clean_list,
    is_blank,
    join_lines,
    lookup,
    plural,
    string_list,
    two_decimals,
    ws_trim,
)
from faultlines.operators.group import LOG_FIELDS


def log_rows(candidates: DataFrame) -> DataFrame:
    """Candidates folded to one row per log: counts, the top three candidates and groups, all fixes.

    Also accepts rows with a null fingerprint, which only keep logs without diagnostics alive.
    """
    found = F.col("fingerprint").isNotNull()
    candidate = F.struct("rank", "title", "confidence", "signals", "fingerprint")
    group = F.struct("order_index", "title", "count", "fingerprint")
    fields = [c for c in LOG_FIELDS if c in candidates.columns]
    return (
        candidates.groupBy("log_id")
        .agg(
            *[F.first(c).alias(c) for c in fields],
            F.first("parse_confidence").alias("parse_confidence"),
            F.sum("count").cast("int").alias("total_diagnostics"),
            F.count("fingerprint").cast("int").alias("group_count"),
            F.sum("error_count").cast("int").alias("error_count"),
            F.sum("warning_count").cast("int").alias("warning_count"),
            F.sort_array(F.collect_list(F.when(found & (F.col("rank") <= 3), candidate))).alias("top_candidates"),
            F.sort_array(F.collect_list(F.when(found & (F.col("order_index") < 3), group))).alias("top_groups"),
            F.sort_array(F.collect_list(F.when(found, F.struct("rank", "suggested_fixes", "fingerprint")))).alias("_fixes"),
        )
        .withColumns(
            {
                "primary_issue_count": F.col("group_count"),
                "fingerprints": F.transform("_fixes", lambda x: x["fingerprint"]),
            }
        )
        .withColumn("fixes", F.array_distinct(F.flatten(F.transform("_fixes", lambda x: x["suggested_fixes"]))))
        .drop("_fixes")
    )


def wants_narrative() -> Column:
    return (F.col("input_type") == "BuildLog") & ((F.col("total_diagnostics") > 1) | (F.col("group_count") > 1))


def _joined_titles(titles: Column) -> Column:
    lowered = F.transform(F.filter(titles, lambda t: ~is_blank(t)), lambda t: F.lower(ws_trim(t)))
    first, second = F.get(lowered, F.lit(0)), F.get(lowered, F.lit(1))
    return (
        F.when(F.size(lowered) == 0, F.lit(C.NARRATIVE_NO_SECONDARY))
        .when(F.size(lowered) == 1, first)
        .otherwise(F.concat(first, F.lit(" and "), second))
    )


def summary_text() -> Column:
    total, groups = F.col("total_diagnostics"), F.col("group_count")
    top = F.col("top_candidates")
    secondary = F.slice(top, 2, 2)
    tool = lookup(F.col("tool_detected"), C.TOOL_FRIENDLY, "build")
    parts = F.array_compact(
        F.array(
            F.concat(
                F.lit("The "), tool, F.lit(" log contains "), total.cast("string"), F.lit(" diagnostic"), plural(total),
                F.lit(", grouped into "), groups.cast("string"), F.lit(" likely issue cluster"), plural(groups),
                F.lit("."),
            ),
            F.when(
                F.size(top) > 0,
                F.concat(F.lit("The strongest starting point is "), F.lower(F.get(top, F.lit(0))["title"]), F.lit(".")),
            ),
            F.when(
                F.size(secondary) > 0,
                F.concat(
                    F.lit("Secondary issue"), plural(F.size(secondary)), F.lit(" include "),
                    _joined_titles(F.transform(secondary, lambda c: c["title"])), F.lit("."),
                ),
            ),
            F.when((F.col("warning_count") > 0) & (F.col("error_count") > 0), F.lit(C.NARRATIVE_NOISE)),
        )
    )
    return join_lines(F.array_join(parts, " "))


def group_texts() -> Column:
    from_groups = F.transform(
        F.col("top_groups"),
        lambda g: F.concat(
            F.coalesce(g["title"], F.lit(C.NARRATIVE_NO_TITLE)), F.lit(": "), g["count"].cast("string"),
            F.lit(" related diagnostic"), plural(g["count"]), F.lit(" matched fingerprint "), g["fingerprint"],
            F.lit("."),
        ),
    )

    def fill(items: Column, c: Column) -> Column:
        text = F.concat(
            c["title"], F.lit(": confidence "), two_decimals(c["confidence"]), F.lit(" based on "),
            F.array_join(F.slice(c["signals"], 1, 3), ", "), F.lit("."),
        )
        mentioned = F.exists(items, lambda i: F.contains(F.lower(i), F.lower(c["title"])))
        return F.when((F.size(items) >= 3) | mentioned, items).otherwise(F.array_append(items, text))

    filled = F.aggregate(F.col("top_candidates"), from_groups, fill)
    return ci_distinct(filled)


def next_steps() -> Column:
    steps = F.slice(clean_list(F.col("fixes")), 1, 4)
    return bound(steps, lambda own: F.when(F.size(own) > 0, own).otherwise(string_list(C.NARRATIVE_DEFAULT_STEPS)))


def narratives(logs: DataFrame) -> DataFrame:
    """Logs that get a narrative, with its texts; input is ``log_rows``."""
    return logs.filter(wants_narrative()).withColumns(
        {
            "narrative_summary": summary_text(),
            "group_summaries": group_texts(),
            "next_steps": next_steps(),
            "narrative_source": F.lit("deterministic"),
            "narrative_status": F.lit("completed"),
        }
    )


def with_narrative(logs: DataFrame) -> DataFrame:
    """All logs; narrative columns are null where no narrative is due."""
    gate = wants_narrative()
    return logs.withColumns(
        {
            "narrative_summary": F.when(gate, summary_text()),
            "group_summaries": F.when(gate, group_texts()),
            "next_steps": F.when(gate, next_steps()),
            "narrative_source": F.when(gate, F.lit("deterministic")),
            "narrative_status": F.when(gate, F.lit("completed")),
        }
    )
