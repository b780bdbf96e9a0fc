"""Lookups over stored analyses: related and similar analyses, narratives and search.

``analyses`` has one row per log with its distinct ``fingerprints``; ``diagnostics`` one row per diagnostic
with created_at, project_name and repository of its log.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.similarity import match_type, score, tokens
from faultlines.functions.text import (
    blank_to_null,
    ci_distinct,
    is_blank,
    replace,
    round_half_even,
    string_list,
    text_lit,
    ws_trim,
)
from faultlines.sources.sinks import narrative_field, processing_field

SCOPE = ["project_name", "repository"]


def summary_or_counts() -> Column:
    counts = F.concat(
        F.col("total_diagnostics").cast("string"), F.lit(" diagnostics across "),
        F.col("group_count").cast("string"), F.lit(" groups; "), F.col("primary_issue_count").cast("string"),
        F.lit(" primary issues identified."),
    )
    return F.coalesce(blank_to_null(F.col("narrative_summary")), counts)


# ---------------------------------------------------------------- scope


def _by_scope(requests: DataFrame, search) -> DataFrame:
    """A request without project or repository is not filtered by it: one join per combination."""
    result = None
    for present in product([True, False], repeat=len(SCOPE)):
        chosen, scope = requests, []
        for column, wanted in zip(SCOPE, present):
            blank = is_blank(F.col(column))
            chosen = chosen.filter(~blank if wanted else blank)
            scope += [column] if wanted else []
        part = search(chosen, scope)
        result = part if result is None else result.unionByName(part)
    return result


def _another() -> Column:
    """The request itself is left out; a request need not be an analysis, so ids are compared as text."""
    return F.col("analysis_id").cast("string") != F.col("request_id").cast("string")


# ---------------------------------------------------------------- related analyses


def related_in_scope(requests: DataFrame, analyses: DataFrame, limit: int, scope: list[str]) -> DataFrame:
    """Newest other analyses that share a fingerprint with each request.

    Only the newest ``limit + 1`` analyses per fingerprint and scope can be among a request's newest
    ``limit``, so a hot fingerprint meets each request with that many rows, never with all its pairs.
    """
    newest = W.partitionBy("fingerprint", *scope).orderBy(F.desc("created_at"), "analysis_id")
    recent = (
        analyses.select("analysis_id", "created_at", *scope, F.explode("fingerprints").alias("fingerprint"))
        .withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= limit + 1)
        .drop("_n")
    )
    wanted = requests.select("request_id", *scope, F.explode(F.array_distinct("fingerprints")).alias("fingerprint"))
    ranked = W.partitionBy("request_id").orderBy(F.desc("created_at"), "analysis_id")
    return (
        wanted.join(recent, ["fingerprint", *scope])
        .filter(_another())
        .groupBy("request_id", "analysis_id")
        .agg(
            F.first("created_at").alias("created_at"),
            F.sort_array(F.collect_set("fingerprint")).alias("matching_fingerprints"),
        )
        .withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= limit)
    )


def related_analyses(
    requests: DataFrame, analyses: DataFrame, limit: int, scope: list[str] | None = None
) -> DataFrame:
    """requests: request_id, fingerprints, project_name, repository. Give ``scope`` when every request
    names the same scope columns; without it each combination is looked up on its own."""
    if limit <= 0:
        raise ValueError("Limit must be positive.")
    if scope is not None:
        return related_in_scope(requests, analyses, limit, scope)
    return _by_scope(requests, lambda chosen, columns: related_in_scope(chosen, analyses, limit, columns))


def with_analysis_text(matches: DataFrame, analyses: DataFrame) -> DataFrame:
    """Adds tool, scope and summary text of the matched analysis."""
    texts = analyses.select(
        "analysis_id", F.col("tool_detected"), "project_name", "repository", summary_or_counts().alias("summary_text")
    )
    return matches.join(texts, "analysis_id")


# ---------------------------------------------------------------- similar analyses


def _search_keys(fingerprints: Column, codes: Column) -> Column:
    return F.array_distinct(
        F.concat(
            F.transform(F.array_compact(fingerprints), lambda x: F.concat(F.lit("f:"), x)),
            F.transform(F.array_compact(codes), lambda x: F.concat(F.lit("c:"), F.lower(x))),
        )
    )


def _scored(joined: DataFrame) -> DataFrame:
    fp_hit = F.coalesce(F.array_contains("fingerprints", F.col("fingerprint")), F.lit(False))
    code_hit = F.coalesce(
        F.exists("codes", lambda c: F.lower(c) == F.lower(F.col("code"))), F.lit(False)
    )
    category_hit = F.coalesce(F.array_contains("categories", F.col("category")), F.lit(False))
    return joined.withColumns(
        {
            "score": score(fp_hit, code_hit, category_hit, F.col("query_tokens"), F.col("own_tokens")),
            "match_type": match_type(fp_hit, code_hit),
        }
    ).filter(F.col("score") >= C.SIM_THRESHOLD)


def _best(pairs: DataFrame) -> DataFrame:
    """The best diagnostic ``b`` of each request and analysis."""
    fields = F.struct((-F.col("score")).alias("s"), "seg", "created_at", "match_type", "message", "normalized_message")
    return pairs.groupBy("request_id", "analysis_id").agg(F.min(fields).alias("b"))


def _certain(requests: DataFrame, diagnostics: DataFrame, limit: int, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the other requests, answers of the requests that find ``limit`` analyses with the highest score by fingerprint and
    code alone). Equal scores rank by time, so older analyses of a fingerprint and code cannot be among the first."""
    newest = W.partitionBy("tool_kind", "fingerprint", "_code", *scope).orderBy(F.desc("created_at"), "analysis_id")
    recent = (
        diagnostics.select(
            "analysis_id", "created_at", "seg", "message", "tool_kind", "fingerprint", "code", "category", "normalized_message", *scope, F.lower("code").alias("_code")
        )
        .filter(F.col("fingerprint").isNotNull() & F.col("_code").isNotNull())
        .withColumn("_n", F.dense_rank().over(newest))
        .filter(F.col("_n") <= limit + 1)
        .drop("_n", "_code")
    )
    asked = requests.select(
        "request_id", "tool_kind", *scope, "fingerprints", "codes", "categories", "query_tokens", F.explode(F.array_distinct("fingerprints")).alias("fingerprint")
    )
    met = asked.join(recent, ["tool_kind", "fingerprint", *scope]).filter(_another()).withColumn("own_tokens", tokens(F.col("normalized_message")))
    found = _best(_scored(met).filter(F.col("score") >= C.SIM_CAP))
    # where a fingerprint also stands with a code that the request lacks, its score depends on the message
    pairs = diagnostics.select("tool_kind", "fingerprint", F.lower("code").alias("_code")).distinct()
    lacks = ~F.coalesce(F.exists("codes", lambda c: F.lower(c) == F.col("_code")), F.lit(False))
    unsure = asked.join(pairs, ["tool_kind", "fingerprint"]).filter(lacks).select("request_id").distinct()
    enough = found.groupBy("request_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= limit).select("request_id").join(unsure, "request_id", "left_anti")
    return requests.join(enough, "request_id", "left_anti"), found.join(enough, "request_id", "left_semi")


def similar_in_scope(requests: DataFrame, diagnostics: DataFrame, limit: int, scope: list[str]) -> DataFrame:
    """Best scoring other analyses per request.

    A shared fingerprint and code alone reach the highest score there is, whatever the messages say, so of each
    fingerprint and code the newest ``limit + 1`` analyses are looked at first. Only requests that do not find ``limit``
    analyses there are compared by messages.

    Without a shared code or fingerprint a score cannot reach the threshold, so an equi-join on those keys
    loses nothing. Diagnostics with equal score-relevant fields score equally, so of each such group only
    the newest ``limit + 1`` analyses take part; the window limit is applied before its shuffle too.
    """
    everyone, requests, sure = requests, *_certain(requests, diagnostics, limit, scope)
    signature = ["tool_kind", "fingerprint", "code", "category", "normalized_message"]
    newest = W.partitionBy(*signature, *scope).orderBy(F.desc("created_at"), "analysis_id")
    stored = diagnostics.select("analysis_id", "created_at", "seg", "message", *signature, *scope)
    keyed = (
        stored.withColumn("_n", F.dense_rank().over(newest))
        .filter(F.col("_n") <= limit + 1)
        .withColumn("own_tokens", tokens(F.col("normalized_message")))
        .withColumn("key", F.explode(_search_keys(F.array("fingerprint"), F.array("code"))))
        .drop("_n")
    )
    asked = requests.select(
        "request_id", "tool_kind", *scope, "fingerprints", "codes", "categories", "query_tokens",
        F.explode(_search_keys(F.col("fingerprints"), F.col("codes"))).alias("key"),
    )
    # A pair that meets on its fingerprint is not taken again on its code.
    once = F.startswith("key", F.lit("f:")) | ~F.coalesce(
        F.array_contains("fingerprints", F.col("fingerprint")), F.lit(False)
    )
    pairs = _scored(
        asked.join(keyed, ["tool_kind", "key", *scope])
        .filter(_another())
        .filter(once)
    )
    best = _best(pairs).unionByName(sure)
    requests = everyone
    ranked = W.partitionBy("request_id").orderBy("b.s", F.desc("b.created_at"), "analysis_id")
    top = (
        best.withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= limit)
        .select("request_id", "analysis_id", "position", "b")
    )
    # The matched fingerprints and codes come from all diagnostics of the few chosen analyses.
    entries = _scored(
        top.select("request_id", "analysis_id")
        .join(requests.select("request_id", "tool_kind", "fingerprints", "codes", "categories", "query_tokens"), "request_id")
        .join(stored.withColumn("own_tokens", tokens(F.col("normalized_message"))), ["analysis_id", "tool_kind"])
    )
    matched = entries.groupBy("request_id", "analysis_id").agg(
        F.sort_array(F.collect_set("fingerprint")).alias("matching_fingerprints"),
        F.sort_array(F.collect_set("code")).alias("_codes"),
    )
    text = ws_trim(F.when(is_blank(F.col("b.message")), F.col("b.normalized_message")).otherwise(F.col("b.message")))
    prefix = F.element_at(
        F.create_map(*[F.lit(x) for item in C.SIM_SUMMARY_PREFIX.items() for x in item]), F.col("b.match_type")
    )
    shortened = F.when(F.length(text) > 180, F.concat(F.substring(text, 1, 177), F.lit("..."))).otherwise(text)
    return top.join(matched, ["request_id", "analysis_id"]).select(
        "request_id",
        "analysis_id",
        "position",
        F.col("b.created_at").alias("created_at"),
        F.col("b.match_type").alias("match_type"),
        round_half_even(-F.col("b.s"), 2).alias("match_score"),
        F.concat_ws(" ", prefix, shortened).alias("summary_text"),
        "matching_fingerprints",
        ci_distinct(F.col("_codes")).alias("matching_codes"),
    )


def _signed(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, _signature) of every request, and one request for each signature: equal requests have equal answers,
    but for themselves."""
    arrays = ["fingerprints", "codes", "categories", "query_tokens"]
    columns = ["tool_kind", *SCOPE, *[F.sort_array(F.array_distinct(c)).alias(c) for c in arrays]]
    signed = requests.select(
        "request_id", F.concat(F.lit("signature:"), F.sha2(F.to_json(F.struct(*columns)), 256)).alias("_signature"), "tool_kind", *SCOPE, *arrays
    )
    asked = signed.dropDuplicates(["_signature"]).drop("request_id").withColumnRenamed("_signature", "request_id")
    return signed.select("request_id", "_signature"), asked


def similar_analyses(
    requests: DataFrame, diagnostics: DataFrame, limit: int, scope: list[str] | None = None
) -> DataFrame:
    """requests: request_id, tool_kind, fingerprints, codes, categories, query_tokens and scope columns.

    The work is (distinct requests sharing a key) x (distinct messages under the key). Each distinct request is answered
    with one analysis more, so that every request still has ``limit`` without itself.
    """
    if limit <= 0:
        raise ValueError("Limit must be positive.")
    signed, asked = _signed(requests)
    if scope is not None:
        found = similar_in_scope(asked, diagnostics, limit + 1, scope)
    else:
        found = _by_scope(asked, lambda chosen, columns: similar_in_scope(chosen, diagnostics, limit + 1, columns))
    found = found.withColumnRenamed("request_id", "_signature")
    ranked = W.partitionBy("request_id").orderBy("position")
    return (
        signed.join(found, "_signature")
        .filter(_another())
        .withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= limit)
        .drop("_signature")
    )


def scored_diagnostics(requests: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Every stored diagnostic with every request that it scores for; equal requests and equal diagnostics are scored
    once. A request without project or repository is not filtered by it."""
    signed, asked = _signed(requests)
    fields = ["tool_kind", "fingerprint", "code", "category", "normalized_message", *SCOPE]
    stored = diagnostics.select("diagnostic_id", F.sha2(F.to_json(F.struct(*fields)), 256).alias("_stored"), *fields)
    keyed = (
        stored.dropDuplicates(["_stored"])
        .withColumn("own_tokens", tokens(F.col("normalized_message")))
        .withColumn("key", F.explode(_search_keys(F.array("fingerprint"), F.array("code"))))
        .drop("diagnostic_id")
    )

    def pairs(chosen: DataFrame, scope: list[str]) -> DataFrame:
        left = chosen.withColumn("key", F.explode(_search_keys(F.col("fingerprints"), F.col("codes"))))
        rest = [c for c in SCOPE if c not in scope]
        scored = _scored(left.drop(*rest).join(keyed.drop(*rest), ["tool_kind", "key", *scope]))
        return scored.select(F.col("request_id").alias("_signature"), "_stored", "score", "match_type").distinct()

    return signed.join(_by_scope(asked, pairs), "_signature").join(stored.select("diagnostic_id", "_stored"), "_stored").select(
        "request_id", "diagnostic_id", "score", "match_type"
    )


# ---------------------------------------------------------------- narratives


def stored_narratives(analyses: DataFrame) -> DataFrame:
    return analyses.filter(F.col("narrative_summary").isNotNull())


def narrative_history(
    narratives: DataFrame, limit: int, tool: str | None = None, source: str | None = None,
    project_name: str | None = None, repository: str | None = None,
) -> DataFrame:
    """Newest narratives that pass the filters; the filters reach the scan."""
    if not 1 <= limit <= 100:
        raise ValueError("Limit must be between 1 and 100.")
    return _filtered(narratives, tool, source, project_name, repository).orderBy(
        F.desc("created_at"), "analysis_id"
    ).limit(limit)


def _filtered(narratives, tool, source, project_name, repository) -> DataFrame:
    wanted = {
        "tool_detected": tool, "narrative_source": source, "project_name": project_name, "repository": repository,
    }
    for column, value in wanted.items():
        if value is not None and value.strip():
            narratives = narratives.filter(F.col(column) == value)
    return narratives


def search_values() -> dict[str, Column]:
    return {
        "summary": F.col("narrative_summary"),
        "groupSummaries": F.array_join(F.coalesce("group_summaries", F.array().cast("array<string>")), " "),
        "recommendedNextSteps": F.array_join(F.coalesce("next_steps", F.array().cast("array<string>")), " "),
        "reason": F.col("narrative_reason"),
        "projectName": F.col("project_name"),
        "repository": F.col("repository"),
        "provider": F.col("narrative_provider"),
        "model": F.col("narrative_model"),
    }


def search_match(text: str) -> dict[str, Column]:
    """Score, matched fields in order and the first matched value for a search text."""
    needle = F.lit(text.strip().lower())
    values = search_values()
    hits = {n: F.coalesce(F.contains(F.lower(values[n]), needle), F.lit(False)) for n, _ in C.SEARCH_FIELDS}
    total, first = F.lit(0), []
    for name, weight in C.SEARCH_FIELDS:
        total = total + F.when(hits[name], F.lit(weight)).otherwise(F.lit(0))
        first.append(F.when(hits[name], values[name]))
    return {
        "score": total,
        "matched_fields": F.array_compact(F.array(*[F.when(hits[n], F.lit(n)) for n, _ in C.SEARCH_FIELDS])),
        "_matched": F.coalesce(*first),
    }


def snippet(value: Column, text: str) -> Column:
    """Text around the first hit, with ellipses where it was cut."""
    needle = text.strip()
    flat = replace(replace(value, r"[ \r\n\t]+", " "), r"\A\s+|\s+\z", "")
    at = F.instr(F.lower(flat), needle.lower()) - 1
    start = F.greatest(F.lit(0), at - C.SNIPPET_RADIUS)
    end = F.least(F.length(flat), at + len(needle) + C.SNIPPET_RADIUS)
    found = F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
        F.substring(flat, start + 1, end - start),
        F.when(end < F.length(flat), F.lit("...")).otherwise(F.lit("")),
    )
    head = F.concat(F.substring(flat, 1, C.SNIPPET_FALLBACK), F.lit("..."))
    whole = F.when(F.length(flat) <= C.SNIPPET_FALLBACK, flat).otherwise(head)
    return F.when(at < 0, whole).otherwise(found)


def search_narratives(
    narratives: DataFrame, text: str, limit: int, tool: str | None = None, source: str | None = None,
    project_name: str | None = None, repository: str | None = None, pool: int | None = None,
) -> DataFrame:
    """All matches scored by field, the best ``limit`` of them. ``pool`` keeps only that many of the newest matches before
    the scoring; by default none is left out."""
    if not text.strip():
        raise ValueError("Text is required.")
    matches = (
        _filtered(narratives, tool, source, project_name, repository)
        .withColumns(search_match(text))
        .filter(F.col("score") > 0)
    )
    if pool is not None:
        matches = matches.orderBy(F.desc("created_at"), "analysis_id").limit(pool)
    best = matches.orderBy(F.desc("score"), F.desc("created_at"), "analysis_id").limit(limit)
    return (
        best.withColumn("match_snippet", snippet(F.col("_matched"), text))
        .drop("_matched")
        .orderBy(F.desc("score"), F.desc("created_at"), "analysis_id")
    )


# ---------------------------------------------------------------- full documents


def _known(value: Column, names, other: str) -> Column:
    return F.when(value.isin(*names), value).otherwise(F.lit(other))


def rebuilt_documents(analyses: DataFrame, diagnostics: DataFrame, groups: DataFrame) -> DataFrame:
    """Documents from the stored rows, for analyses without a snapshot. Stored names that are not known read as Error
    (severity) or Unknown (tool, category); a group without a primary diagnostic takes its first related one. Candidates,
    matched rules and warnings are only kept in snapshots."""
    fields = F.struct(
        "order_index", "id", _known(F.col("tool_kind"), C.TOOL_TEXT, "Unknown").alias("tool_kind"), "source", "code",
        _known(F.col("severity"), C.SEVERITY_TEXT, "Error").alias("severity"), "message", "normalized_message", "location", "raw_snippet",
        _known(F.col("category"), C.CATEGORY_TEXT, "Unknown").alias("category"), "subcategory", "is_primary_candidate", blank_to_null(F.col("fingerprint")).alias("fingerprint"),
        F.map_entries("metadata").alias("metadata"),
    )
    d = diagnostics.groupBy("analysis_id").agg(F.sort_array(F.collect_list(fields)).alias("diagnostics"))
    related = F.col("related_diagnostic_ids")
    primary = F.coalesce(blank_to_null(F.col("primary_diagnostic_id")), F.get(related, F.lit(0)), F.lit("diag_unknown"))
    reason = F.coalesce("group_reason", F.lit(C.GROUP_REASON_MANY))
    g = groups.groupBy("analysis_id").agg(
        F.sort_array(
            F.collect_list(F.struct("order_index", "id", "fingerprint", "count", reason.alias("group_reason"), primary.alias("primary_diagnostic_id"), "related_diagnostic_ids"))
        ).alias("groups")
    )
    return analyses.join(d, "analysis_id", "left").join(g, "analysis_id", "left")


def get_analyses(wanted: DataFrame, analyses: DataFrame, snapshots: DataFrame, diagnostics: DataFrame, groups: DataFrame) -> DataFrame:
    """Full document per wanted id: the stored snapshot with the raw content as it is now, else rebuilt from the rows.

    ``origin`` tells which. Only the rows of analyses without a snapshot are read for rebuilding.
    """
    chosen = analyses.join(wanted.select("analysis_id").distinct(), "analysis_id", "left_semi")
    live = chosen.select("analysis_id", "raw_content", "raw_content_redacted")
    stored = snapshots.drop("raw_content", "raw_content_redacted").join(live, "analysis_id")
    rest = chosen.join(snapshots.select("analysis_id"), "analysis_id", "left_anti")
    ids = rest.select("analysis_id")
    own = ["analysis_id", "input_type", "tool_detected", "created_at", "project_name", "repository", "raw_content_hash", "raw_content", "raw_content_redacted", "context"]
    summary = F.struct("total_diagnostics", "group_count", "primary_issue_count", "error_count", "warning_count")
    rest = rest.select(*own, summary.alias("summary"), narrative_field().alias("narrative"), processing_field().alias("processing"))
    old = rebuilt_documents(rest, diagnostics.join(ids, "analysis_id", "left_semi"), groups.join(ids, "analysis_id", "left_semi"))
    return stored.withColumn("origin", F.lit("snapshot")).unionByName(old.withColumn("origin", F.lit("rebuilt")), allowMissingColumns=True)


def query_tokens(messages: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(messages, tokens)))
