"""Merging of model answers that arrive as a table; nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import clean_list, is_blank, join_lines, replace, ws_trim


def unfence(raw: Column) -> Column:
    """Content between a leading code fence line and the last fence, otherwise the trimmed text."""
    text = ws_trim(raw)
    inner = ws_trim(replace(text, r"\A```[^\n]*\n((?s:.*))```(?s:.*)\z", "$1"))
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def _string_at(document: Column, path: str) -> Column:
    value = F.try_variant_get(document, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(document, path, "string"))


def _strings_at(document: Column, path: str) -> Column:
    items = F.coalesce(F.try_variant_get(document, path, "array<variant>"), F.array().cast("array<variant>"))
    texts = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return clean_list(F.transform(texts, lambda x: x.cast("string")))


def parse_answers(answers: DataFrame, text: str, first_list: str, second_list: str) -> DataFrame:
    """Adds text, first_list, second_list and readable from raw_output: a JSON object or plain text."""
    body = F.col("_body")
    is_json = F.startswith(body, F.lit("{"))
    document = F.col("_document")
    none = F.array().cast("array<string>")
    return (
        answers.withColumn("_body", unfence(F.coalesce("raw_output", F.lit(""))))
        .withColumn("_document", F.when(is_json, F.try_parse_json(body)))
        .withColumns(
            {
                "text": F.coalesce(
                    F.when(is_json, join_lines(_string_at(document, f"$.{text}"))).otherwise(join_lines(body)),
                    F.lit(""),
                ),
                "first_list": F.when(document.isNotNull(), _strings_at(document, f"$.{first_list}")).otherwise(none),
                "second_list": F.when(document.isNotNull(), _strings_at(document, f"$.{second_list}")).otherwise(none),
                "readable": ~is_json | document.isNotNull(),
            }
        )
        .drop("_body", "_document")
    )


def parse_explanations(answers: DataFrame) -> DataFrame:
    return parse_answers(answers, "explanation", "likelyCauses", "suggestedFixes")


def parse_narratives(answers: DataFrame) -> DataFrame:
    return parse_answers(answers, "summary", "groupSummaries", "recommendedNextSteps")


def overlay_candidates(candidates: DataFrame, parsed: DataFrame) -> DataFrame:
    """The top candidate of each answered log takes over the explanation, and lists that are not empty."""
    a = parsed.select(
        "log_id", F.lit(1).alias("rank"), F.col("text").alias("_text"), F.col("first_list").alias("_causes"),
        F.col("second_list").alias("_fixes"), "readable",
    )
    asked = F.col("_text").isNotNull()
    usable = asked & F.col("readable") & ~is_blank(F.col("_text")) & ~is_blank(F.col("explanation"))
    return (
        candidates.join(a, ["log_id", "rank"], "left")
        .withColumns(
            {
                "enrich_status": F.when(~asked, F.lit("none"))
                .when(usable, F.lit("completed"))
                .otherwise(F.lit("failed")),
                "enrich_warning": F.when(asked & ~usable, F.lit(C.ENRICH_FALLBACK_WARNING)),
                "explanation": F.when(usable, F.col("_text")).otherwise(F.col("explanation")),
                "likely_causes": F.when(usable & (F.size("_causes") > 0), F.col("_causes")).otherwise(
                    F.col("likely_causes")
                ),
                "suggested_fixes": F.when(usable & (F.size("_fixes") > 0), F.col("_fixes")).otherwise(
                    F.col("suggested_fixes")
                ),
            }
        )
        .drop("_text", "_causes", "_fixes", "readable")
    )


def overlay_narratives(narratives: DataFrame, parsed: DataFrame, provider: str, model: str) -> DataFrame:
    """Narratives with a usable answer become model narratives; the others stay as they are."""
    a = parsed.select(
        "log_id", F.col("text").alias("_text"), F.col("first_list").alias("_groups"),
        F.col("second_list").alias("_steps"), "readable",
    )
    asked = F.col("_text").isNotNull()
    usable = asked & F.col("readable") & ~is_blank(F.col("_text"))
    return (
        narratives.join(a, "log_id", "left")
        .withColumns(
            {
                "narrative_warning": F.when(asked & ~usable, F.lit(C.NARRATIVE_FALLBACK_WARNING)),
                "narrative_source": F.when(usable, F.lit("ai")).otherwise(F.col("narrative_source")),
                "narrative_provider": F.when(usable, F.lit(provider)),
                "narrative_model": F.when(usable, F.lit(model)),
                "narrative_summary": F.when(usable, F.col("_text")).otherwise(F.col("narrative_summary")),
                "group_summaries": F.when(usable & (F.size("_groups") > 0), F.col("_groups")).otherwise(
                    F.col("group_summaries")
                ),
                "next_steps": F.when(usable & (F.size("_steps") > 0), F.col("_steps")).otherwise(F.col("next_steps")),
            }
        )
        .drop("_text", "_groups", "_steps", "readable")
    )


def task_rows(logs: DataFrame) -> DataFrame:
    """Adds ai_tasks, used_ai and the single-task summary.

    logs: log_id, want_explanation, want_narrative, has_candidate, has_narrative, explanation_status and
    narrative_status_ai (null where no answer came), explanation_configured, narrative_configured.
    """

    def task(feature: str, wanted: str, possible: str, configured: str, status: str, skipped: str, absent: str):
        # An explanation asked for without its service is unavailable even when there is no candidate;
        # a narrative without a target is skipped first.
        skip = ~F.col(possible)
        missing = ~F.col(configured)
        order = [(missing, "unavailable", absent), (skip, "skipped", skipped)]
        if feature == C.NARRATIVE_FEATURE:
            order.reverse()
        outcome = F.when(order[0][0], F.lit(order[0][1])).when(order[1][0], F.lit(order[1][1]))
        reason = F.when(order[0][0], F.lit(order[0][2])).when(order[1][0], F.lit(order[1][2]))
        return F.when(
            F.col(wanted),
            F.struct(
                F.lit(feature).alias("feature"),
                outcome.otherwise(F.coalesce(F.col(status), F.lit("failed"))).alias("status"),
                reason.alias("reason"),
            ),
        )

    tasks = F.array_compact(
        F.array(
            task(
                C.ENRICH_FEATURE, "want_explanation", "has_candidate", "explanation_configured", "explanation_status",
                C.ENRICH_SKIPPED, "AI explanation enrichment service is not configured.",
            ),
            task(
                C.NARRATIVE_FEATURE, "want_narrative", "has_narrative", "narrative_configured", "narrative_status_ai",
                C.NARRATIVE_SKIPPED, "AI root-cause narrative service is not configured.",
            ),
        )
    )
    return logs.withColumn("ai_tasks", tasks).withColumns(
        {
            "used_ai": F.exists("ai_tasks", lambda t: F.lower(t["status"]) == "completed"),
            "single_task": F.when(F.size("ai_tasks") == 1, F.get("ai_tasks", F.lit(0))),
        }
    )
