"""Registered queries: every operator over the whole test tables.

Results are flat (lists joined to text, times as text) so that they compare by value with the checking SQL.
Queries over persisted history read the store, whose tables are written once per session and folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions import normalize as N
from faultlines.functions.classify import classify_dotnet, classify_javascript, classify_python, classify_typescript
from faultlines.functions.fingerprint import canonical_fingerprint, hashed_fingerprint
from faultlines.functions.redact import redact_log, redact_raw
from faultlines.functions.similarity import tokens
from faultlines.functions.text import collapse_ws, forward_slashes, ws_trim
from faultlines.operators import enrich as EN
from faultlines.operators import group as G
from faultlines.operators import history as H
from faultlines.operators import knowledge as K
from faultlines.operators import patterns as P
from faultlines.operators import privacy as V
from faultlines.operators import project as J
from faultlines.operators import rank as RK
from faultlines.operators import rules as R
from faultlines.operators import telemetry as TM
from faultlines.operators import text_index as TI
from faultlines.operators.detect import detect_tool, select_parser
from faultlines.operators.extract import diagnostics, segment_stats, unparsed, with_order_index
from faultlines.operators.segment import explode_segments, segment_logs
from faultlines.plans import analysis, store
from faultlines.session import shared_folder
from faultlines.sources import commits, intake, sinks
from faultlines.sources import fixtures as X
from faultlines.sources import logs as S
from faultlines.streaming import streams as ST

QUERIES: dict = {}
AS_OF = "2000-01-01 00:00:00"
_STORES: dict[tuple[str, str], store.StoredTables] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def lst(column: str | Column) -> Column:
    return F.array_join(column, " | ")


def ts(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def history(spark: SparkSession, sf_dir: str) -> store.StoredTables:
    """The stored history of a folder's logs; a table that no query of the session has read yet is written by reading it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = store.StoredTables(X.with_context(X.logs(spark, sf_dir)), X.rules(spark), scratch(spark, "store"))
    return _STORES[key]


def _segments(spark, sf_dir) -> DataFrame:
    return analysis.extracted(X.logs(spark, sf_dir))


def _diagnostics(spark, sf_dir, tool: str | None = None, code: str | None = None) -> DataFrame:
    rows = diagnostics(_segments(spark, sf_dir))
    if tool is not None:
        rows = rows.filter(F.col("parser_tool") == tool)
    return rows if code is None else rows.filter(F.col("code") == code)


# ---------------------------------------------------------------- sources and ingest


@query
def src_logs(spark, sf_dir):
    return X.logs(spark, sf_dir).select(
        "log_id", F.sha2("content", 256).alias("content_sha"), F.length("content").alias("n_chars"), "input_type",
        "tool_hint", "project_name", "repository", ts("created_at").alias("created"),
    )


@query
def src_validate(spark, sf_dir):
    """All violations of all requests; over-long logs are judged without their content, by everything else they say."""
    asked = X.requests(spark, sf_dir).withColumn("too_long", F.lit(False))
    return S.request_errors(asked.unionByName(X.oversize_requests(spark, sf_dir)))


@query
def src_tool_alias(spark, sf_dir):
    return X.requests(spark, sf_dir).select("log_id", "tool_hint", S.parse_tool(F.col("tool_hint")).alias("tool"))


@query
def src_rejected(spark, sf_dir):
    """Violations of the requests that admission has put apart, with how many requests it accepted and rejected."""
    asked = X.requests(spark, sf_dir).withColumn("too_long", F.lit(False)).unionByName(X.oversize_requests(spark, sf_dir))
    admission = intake.admit(asked, scratch(spark, "admission"))
    return intake.rejections(admission.rejected).withColumns(
        {"accepted": F.lit(admission.accepted_count), "rejected": F.lit(admission.rejected_count)}
    )


@query
def src_context(spark, sf_dir):
    context = F.col("context")
    text = F.transform(F.array_sort(F.map_keys(context)), lambda k: F.concat(k, F.lit("="), context[k]))
    return X.with_context(X.logs(spark, sf_dir)).select("log_id", F.array_join(text, ";").alias("context"))


@query
def src_hash(spark, sf_dir):
    content = F.col("content")
    return X.logs(spark, sf_dir).select(
        "log_id", S.content_hash(content).alias("sha"), F.substring(S.content_hash(content), 1, 12).alias("prefix"),
        S.line_count(content).cast("int").alias("lines"),
    )


@query
def sink_analyses(spark, sf_dir):
    return history(spark, sf_dir)["analyses"].select(
        "analysis_id", "input_type", "tool_detected", "total_diagnostics", "group_count", "primary_issue_count",
        "error_count", "warning_count", F.col("parser_name").alias("parser"), "parse_confidence", "narrative_summary",
        lst("group_summaries").alias("group_summaries"), lst("next_steps").alias("next_steps"), "narrative_source",
        "project_name", "repository", "raw_content_hash", "raw_content_redacted", ts("created_at").alias("created"),
    )


@query
def sink_diagnostics(spark, sf_dir):
    rows = sinks.diagnostic_rows(
        history(spark, sf_dir)["diagnostics"].withColumnRenamed("analysis_id", "log_id")
    )
    return rows.select(
        "id", "analysis_id", "tool_kind", "source", "code", "severity", "message", "normalized_message",
        F.col("location.file_path").alias("file_path"), F.col("location.line").alias("line"), "raw_snippet", "category",
        "fingerprint", "order_index",
    )


@query
def sink_groups(spark, sf_dir):
    rows = sinks.group_rows(history(spark, sf_dir)["groups"].withColumnRenamed("analysis_id", "log_id"))
    return rows.select(
        "id", "analysis_id", "fingerprint", "count", "group_reason", "primary_diagnostic_id",
        lst("related_diagnostic_ids").alias("related"), "order_index",
    )


@query
def sink_snapshot(spark, sf_dir):
    """Every part of every stored document."""
    return sinks.document_rows(history(spark, sf_dir)["snapshots"])


class _Unwritable(OSError):
    pass


def _half_writing(df: DataFrame, path: str) -> None:
    """A sink that breaks off after part of the rows of one repository."""
    if df.filter("repository = 'repoO'").isEmpty():
        return commits.write_parquet(df, path)
    commits.write_parquet(df.filter("log_id % 2 = 0"), path)
    raise _Unwritable(path)


@query
def sink_gate(spark, sf_dir):
    """Logs written in batches by repository, one of which fails half-way: what is readable afterwards, and the notes."""
    path = scratch(spark, "gate")
    logs = staged(X.logs(spark, sf_dir).select("log_id", "repository", "persist", "input_type"), "gate-logs")
    failed = commits.commit(logs.filter("persist"), path, "repository", _half_writing)
    written = commits.read(spark, path, logs.schema).select("log_id", F.lit(True).alias("written"))
    notes = F.when(F.col("input_type") == "SingleDiagnostic", F.lit("single"))
    errors = logs.join(failed.withColumnRenamed("batch", "repository"), "repository").select("log_id", "error")
    return sinks.status_notes(logs, errors, notes).drop("persisted").join(written, "log_id", "left").select(
        "log_id", F.coalesce("written", F.lit(False)).alias("persisted"), "notes"
    )


# ---------------------------------------------------------------- detection


@query
def det_tool(spark, sf_dir):
    return detect_tool(X.logs(spark, sf_dir)).select(
        "log_id", "tool_detected", "detection_confidence", "detection_reason", "was_explicit_hint"
    )


@query
def det_parser(spark, sf_dir):
    accepted = S.accepted(X.requests(spark, sf_dir))
    return select_parser(detect_tool(accepted)).select(
        "log_id", "tool_detected", "parser_tool", "parser_name", "failure_reason"
    )


# ---------------------------------------------------------------- segmentation


@query
def seg_lines(spark, sf_dir):
    return S.log_lines(X.logs(spark, sf_dir))


def _only_segments(spark, sf_dir, *tools: str) -> DataFrame:
    chosen = analysis.selected(X.logs(spark, sf_dir)).filter(F.col("parser_tool").isin(*tools))
    return explode_segments(segment_logs(chosen)).filter(F.col("segment").isNotNull()).select("log_id", "seg", "segment")


@query
def seg_dotnet(spark, sf_dir):
    return _only_segments(spark, sf_dir, "DotNet")


@query
def seg_tsc(spark, sf_dir):
    return _only_segments(spark, sf_dir, "TypeScript")


@query
def seg_python(spark, sf_dir):
    return _only_segments(spark, sf_dir, "Python")


@query
def seg_whole(spark, sf_dir):
    return _only_segments(spark, sf_dir, "Npm", "Vite")


@query
def seg_unparsed(spark, sf_dir):
    return unparsed(analysis.recognised(X.logs(spark, sf_dir)))


@query
def seg_stats(spark, sf_dir):
    return segment_stats(analysis.recognised(X.logs(spark, sf_dir)))


# ---------------------------------------------------------------- extraction


def _place(prefix: str = "location") -> list[Column]:
    names = {"file_path": "file_path", "line": "line", "column": "col", "end_line": "end_line", "end_column": "end_col"}
    return [F.col(f"{prefix}.{k}").alias(v) for k, v in names.items()]


def _meta() -> Column:
    keys = F.array_sort(F.map_keys("metadata"))
    return F.array_join(
        F.transform(keys, lambda k: F.concat(k, F.lit("="), F.col("metadata")[k])), ";"
    ).alias("meta")


@query
def ext_dotnet_loc(spark, sf_dir):
    rows = _diagnostics(spark, sf_dir, "DotNet").filter(F.col("location.line").isNotNull())
    return rows.select("log_id", "seg", "code", "severity", "message", *_place(), _meta())


@query
def ext_dotnet_simple(spark, sf_dir):
    rows = _diagnostics(spark, sf_dir, "DotNet").filter(F.col("location.line").isNull())
    return rows.select("log_id", "seg", "code", "severity", "message", F.col("location.file_path").alias("file_path"), _meta())


@query
def ext_dotnet_source(spark, sf_dir):
    return _diagnostics(spark, sf_dir, "DotNet").select("log_id", "seg", "code", "source")


@query
def ext_severity(spark, sf_dir):
    return (
        _diagnostics(spark, sf_dir)
        .groupBy("parser_tool", "severity")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("log_id").alias("logs"))
    )


@query
def ext_tsc(spark, sf_dir):
    return _diagnostics(spark, sf_dir, "TypeScript").select(
        "log_id", "seg", "code", "severity", "message", "source", *_place()
    )


@query
def ext_py_exception(spark, sf_dir):
    return _diagnostics(spark, sf_dir, "Python").select("log_id", "seg", "code", "message", "source", _meta())


@query
def ext_py_frame(spark, sf_dir):
    m = F.col("metadata")
    return _diagnostics(spark, sf_dir, "Python").select(
        "log_id", "seg", F.col("location.file_path").alias("file_path"), F.col("location.line").alias("line"),
        m["frameCount"].cast("int").alias("frames"), m["function"].alias("function"),
    )


@query
def ext_py_caret(spark, sf_dir):
    return _diagnostics(spark, sf_dir, "Python").filter(F.col("location.column").isNotNull()).select(
        "log_id", "seg", "code", F.col("location.column").alias("col")
    )


@query
def ext_npm_script(spark, sf_dir):
    return _diagnostics(spark, sf_dir, "Npm", "NPM_MISSING_SCRIPT").select("log_id", "seg", "message", _meta())


def _npm_rest(spark, sf_dir) -> DataFrame:
    return _diagnostics(spark, sf_dir, "Npm").filter(F.col("code") != "NPM_MISSING_SCRIPT")


@query
def ext_npm_code(spark, sf_dir):
    return _npm_rest(spark, sf_dir).select("log_id", "code")


@query
def ext_npm_message(spark, sf_dir):
    return _npm_rest(spark, sf_dir).select("log_id", "message")


@query
def ext_npm_path(spark, sf_dir):
    return _npm_rest(spark, sf_dir).select("log_id", F.col("location.file_path").alias("file_path"), _meta())


def _vite(spark, sf_dir, code):
    return _diagnostics(spark, sf_dir, "Vite", code).select("log_id", "message", "normalized_message", *_place(), _meta())


@query
def ext_vite_import(spark, sf_dir):
    return _vite(spark, sf_dir, "VITE_RESOLVE_IMPORT")


@query
def ext_vite_export(spark, sf_dir):
    return _vite(spark, sf_dir, "VITE_MISSING_EXPORT")


@query
def ext_vite_parse(spark, sf_dir):
    return _vite(spark, sf_dir, "VITE_PARSE_ERROR")


@query
def ext_vite_fallback(spark, sf_dir):
    return _vite(spark, sf_dir, "VITE_BUILD_ERROR")


@query
def ext_all(spark, sf_dir):
    return with_order_index(_diagnostics(spark, sf_dir)).select(
        "log_id", "order_index", "tool_detected", "tool_kind", "code", "severity", "message", "normalized_message",
        "source", *_place(), _meta(), "category", "fingerprint", "diagnostic_id",
    )


# ---------------------------------------------------------------- normalisation, category, fingerprint


@query
def nrm_ws(spark, sf_dir):
    documents, pages = X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "pages")
    return documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.sha2(collapse_ws(F.col("text")), 256).alias("value")
    ).unionByName(
        pages.select(
            F.lit("url").alias("kind"), F.col("page_id").alias("id"),
            forward_slashes(F.translate("url", "/", "\\")).alias("value"),
        )
    )


def _normalized(spark, sf_dir, tool, fn):
    return _diagnostics(spark, sf_dir, tool).select("log_id", "seg", "code", "message", fn.alias("normalized"))


@query
def nrm_dotnet(spark, sf_dir):
    return _normalized(spark, sf_dir, "DotNet", N.normalize_dotnet(F.col("message")))


@query
def nrm_tsc(spark, sf_dir):
    return _normalized(spark, sf_dir, "TypeScript", N.normalize_typescript(F.col("message")))


@query
def nrm_python(spark, sf_dir):
    return _normalized(spark, sf_dir, "Python", N.normalize_python(F.col("code"), F.col("message")))


@query
def nrm_js(spark, sf_dir):
    rows = _diagnostics(spark, sf_dir).filter(F.col("parser_tool").isin("Npm", "Vite"))
    return rows.select(
        "log_id", "seg", "code", "message", N.normalize_javascript(F.col("code"), F.col("message")).alias("normalized")
    )


def _classified(spark, sf_dir, tools, fn, by_upper=True):
    code = F.upper("code") if by_upper else F.col("code")
    rows = _diagnostics(spark, sf_dir).filter(F.col("parser_tool").isin(*tools))
    by_text = fn(F.lit("?"), F.lower("normalized_message"))
    return rows.select(
        "log_id", "seg", "code", fn(code, F.lower("normalized_message")).alias("category"), by_text.alias("by_text")
    )


@query
def cls_dotnet(spark, sf_dir):
    return _classified(spark, sf_dir, ["DotNet"], classify_dotnet)


@query
def cls_tsc(spark, sf_dir):
    return _classified(spark, sf_dir, ["TypeScript"], classify_typescript)


@query
def cls_python(spark, sf_dir):
    return _classified(spark, sf_dir, ["Python"], classify_python, by_upper=False)


@query
def cls_js(spark, sf_dir):
    return _classified(spark, sf_dir, ["Npm", "Vite"], classify_javascript)


def _fp_fields():
    return F.col("parser_tool"), F.upper("code"), F.col("category"), F.lower("normalized_message")


@query
def fpr_hash(spark, sf_dir):
    return _diagnostics(spark, sf_dir).select("log_id", "seg", hashed_fingerprint(*_fp_fields()).alias("hashed"))


@query
def fpr_canonical(spark, sf_dir):
    named = _diagnostics(spark, sf_dir).withColumn("named", canonical_fingerprint(*_fp_fields()))
    return named.filter(F.col("named").isNotNull()).select("log_id", "seg", "named")


# ---------------------------------------------------------------- groups, candidates, narrative, views


@query
def grp_fingerprint(spark, sf_dir):
    return G.groups(G.group_rows(_segments(spark, sf_dir))).select(
        "log_id", "fingerprint", "count", "primary_diagnostic_id", lst("related_diagnostic_ids").alias("related"),
        "group_reason", "order_index",
    )


def _ranked(spark, sf_dir):
    return analysis.ranked(_segments(spark, sf_dir))


@query
def rnk_confidence(spark, sf_dir):
    return _ranked(spark, sf_dir).select("log_id", "fingerprint", "parse_confidence", "confidence")


@query
def rnk_signals(spark, sf_dir):
    return _ranked(spark, sf_dir).select("log_id", "fingerprint", lst("signals").alias("signals"))


@query
def rnk_candidates(spark, sf_dir):
    return _ranked(spark, sf_dir).select("log_id", "rank", "fingerprint", "diagnostic_id", "confidence", "title")


@query
def rnk_insight(spark, sf_dir):
    texts = RK.insight(F.col("code"), F.col("category"))
    return _diagnostics(spark, sf_dir).select("log_id", "seg", texts.alias("i")).select(
        "log_id", "seg", "i.title", "i.explanation", lst("i.likely_causes").alias("causes"),
        lst("i.suggested_fixes").alias("fixes"),
    )


@query
def sum_analysis(spark, sf_dir):
    return G.summary(G.group_rows(_segments(spark, sf_dir))).select(
        "log_id", "total_diagnostics", "group_count", "primary_issue_count", "error_count", "warning_count"
    )


def _narrated(spark, sf_dir) -> DataFrame:
    from faultlines.operators.narrative import log_rows, narratives

    return narratives(log_rows(_ranked(spark, sf_dir)))


@query
def nar_gate(spark, sf_dir):
    return _narrated(spark, sf_dir).select("log_id", "total_diagnostics", "group_count")


@query
def nar_summary(spark, sf_dir):
    return _narrated(spark, sf_dir).select("log_id", "narrative_summary")


@query
def nar_groups(spark, sf_dir):
    return _narrated(spark, sf_dir).select("log_id", lst("group_summaries").alias("group_summaries"))


@query
def nar_steps(spark, sf_dir):
    return _narrated(spark, sf_dir).select("log_id", lst("next_steps").alias("next_steps"))


@query
def prj_single(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    rows = analysis.with_empty_logs(analysis.ranked(segments), segments)
    view = J.single_view(rows.filter(F.col("input_type") == "SingleDiagnostic"))
    return view.withColumns({"likely_causes": lst("likely_causes"), "suggested_fixes": lst("suggested_fixes")})


@query
def prj_build_log(spark, sf_dir):
    documents = history(spark, sf_dir)["snapshots"].filter(F.col("input_type") == "BuildLog")
    return sinks.document_rows(J.build_log_view(documents, include_diagnostics=False), "tool")


@query
def prj_enums(spark, sf_dir):
    return (
        _diagnostics(spark, sf_dir)
        .select(
            J.tool_text(F.col("tool_detected")).alias("tool"), J.severity_text(F.col("severity")).alias("severity_text"),
            J.category_text(F.col("category")).alias("category_text"), J.input_type_text(F.col("input_type")).alias("input"),
        )
        .groupBy("tool", "severity_text", "category_text", "input")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---------------------------------------------------------------- rules


@query
def rul_validate(spark, sf_dir):
    return R.rule_errors(X.drafts(spark, sf_dir))


@query
def rul_regex(spark, sf_dir):
    """Drafts made of whole pages. By their making, odd pages have an unclosed group as message regex and every third
    page an unclosed class as path regex; only those are listed."""
    words = F.regexp_replace("html", "[^A-Za-z0-9]+", " ")
    page = F.col("page_id")
    drafts = X.table(spark, sf_dir, "pages").select(
        page.alias("rule_id"),
        F.concat(F.lit("("), words, F.when(page % 2 == 0, F.lit(")")).otherwise("")).alias("message_regex"),
        F.concat(F.lit("["), words, F.when(page % 3 != 0, F.lit("]")).otherwise("")).alias("file_path_regex"),
    )
    return R.bad_regexes(drafts)


@query
def rul_unique_name(spark, sf_dir):
    return R.duplicate_names(X.drafts(spark, sf_dir))


def _stored_drafts(spark, sf_dir) -> DataFrame:
    early = F.lit("1999-01-01 00:00:00").cast("timestamp")
    return X.drafts(spark, sf_dir).withColumns({"created_at": early, "updated_at": early})


@query
def rul_merge(spark, sf_dir):
    stored = _stored_drafts(spark, sf_dir)
    changed = stored.filter(F.col("priority") % 3 != 2).withColumns(
        {
            "only_enabled": F.col("priority") % 3 == 1,
            "is_enabled": F.col("mark_primary") | F.col("is_enabled"),
            "title": F.concat(F.lit("new "), F.coalesce("title", F.lit("title"))),
        }
    )
    added = changed.filter("not only_enabled").withColumn("rule_id", F.col("rule_id") + 1_000_000_000_000)
    merged = R.merge_rules(stored, changed.unionByName(added).drop("created_at", "updated_at"), as_of())
    return merged.select(
        "rule_id", "name", "title", "is_enabled", "match_count", ts("created_at").alias("created"),
        ts("updated_at").alias("updated"),
    )


@query
def rul_list(spark, sf_dir):
    chosen = R.list_rules(X.drafts(spark, sf_dir), is_enabled=True, tag=" brand#2 ")
    return R.page_rules(chosen, limit=20, offset=10).select("rule_id", "name", "priority", "match_count")


@query
def rul_list_count(spark, sf_dir):
    return R.list_rules(X.drafts(spark, sf_dir), is_enabled=False, tool="dotnet").agg(F.count(F.lit(1)).alias("total"))


@query
def rul_enabled(spark, sf_dir):
    tools = detect_tool(X.logs(spark, sf_dir)).groupBy("tool_detected").agg(F.count(F.lit(1)).alias("logs"))
    return R.enabled_rules(X.rules(spark), tools).select("tool_detected", "logs", "rule_id", "priority")


@query
def rul_match_diag(spark, sf_dir):
    hits = R.match_diagnostics(_segments(spark, sf_dir).filter("parsed"), X.rules(spark))
    return hits.select("log_id", "rule_id", "target_id", "fingerprint")


def _rule_totals(rows: DataFrame, rules: DataFrame) -> DataFrame:
    return R.hit_totals(staged(R.tested_kinds(rows.filter("parsed"), rules), "tested-kinds"), rules)


@query
def rul_match_many(spark, sf_dir):
    """As many rules as there are parts against all diagnostics: hits and logs of every rule that matches."""
    return _rule_totals(_segments(spark, sf_dir), X.many_rules(spark, sf_dir))


@query
def rul_match_regex(spark, sf_dir):
    """As many rules of nothing but regexes as there are parts against all stored diagnostics."""
    return _rule_totals(history(spark, sf_dir)["segments"], X.regex_rules(spark, sf_dir))


@query
def rul_match_group(spark, sf_dir):
    hits = R.match_groups(G.groups(G.group_rows(_segments(spark, sf_dir))), X.rules(spark))
    return hits.select("log_id", "rule_id", "target_id", "fingerprint")


@query
def rul_scope(spark, sf_dir):
    return R.scope_hits(X.logs(spark, sf_dir), X.rules(spark))


@query
def rul_actions(spark, sf_dir):
    return R.describe(X.drafts(spark, sf_dir)).select(
        "rule_id", lst("applied_actions").alias("actions"), lst("diagnostic_conditions").alias("conditions"),
        lst("group_conditions").alias("group_conditions"),
    )


def _applied_view(rows: DataFrame) -> DataFrame:
    return rows.select(
        "log_id", "fingerprint", "rank", "applied_rules", F.round("confidence", 6).alias("confidence"), "title",
        "explanation", lst("suggested_fixes").alias("fixes"), lst("signals").alias("signals"),
    )


@query
def rul_apply(spark, sf_dir):
    return _applied_view(analysis.applied(_segments(spark, sf_dir), X.rules(spark)))


@query
def rul_matches(spark, sf_dir):
    h = history(spark, sf_dir)
    matches = h["rule_matches"].withColumnRenamed("analysis_id", "log_id")
    return R.match_audit(matches, X.rules(spark), F.col("applied_at")).select(
        "log_id", "rule_id", "target_type", "target_id", lst("matched_conditions").alias("conditions"),
        lst("applied_actions").alias("actions"), ts("applied_at").alias("applied"),
    )


@query
def rul_record(spark, sf_dir):
    return R.record_matches(X.rules(spark), history(spark, sf_dir)["rule_matches"]).select(
        "rule_id", "match_count", ts("last_matched_at").alias("last_matched")
    )


def _related_contexts(h: dict[str, DataFrame]) -> DataFrame:
    last = F.max(
        F.struct(
            "created_at", (-F.col("order_index")).alias("o"), "analysis_id", "code", "severity",
            F.col("location.file_path").alias("file_path"), "project_name", "repository",
        )
    ).alias("d")
    latest = h["diagnostics"].groupBy("fingerprint").agg(last)
    return h["patterns"].join(latest, "fingerprint").select(
        "fingerprint", "tool_kind", "d.code", "d.severity", "category", "canonical_message", "d.file_path",
        "d.project_name", "d.repository",
    )


@query
def rul_related(spark, sf_dir):
    related = R.related_rules(_related_contexts(history(spark, sf_dir)), X.rules(spark))
    return related.select("fingerprint", "rule_id", lst("matched_by").alias("matched_by"), "score", "position")


@query
def rul_preview(spark, sf_dir):
    rows = analysis.applied(_segments(spark, sf_dir), X.rules(spark), stored=False)
    return rows.select(
        "log_id", "fingerprint", "previous_rank", F.round("previous_confidence", 6).alias("before"), "rank",
        F.round("confidence", 6).alias("after"), "applied_rules", "title",
    )


# ---------------------------------------------------------------- patterns


@query
def pat_occurrences(spark, sf_dir):
    return P.occurrences(_diagnostics(spark, sf_dir)).select(
        "fingerprint", "analysis_id", "diagnostic_id", ts("seen_at").alias("seen")
    )


def _pattern_view(df: DataFrame) -> DataFrame:
    return df.withColumns({"first_seen_at": ts("first_seen_at"), "last_seen_at": ts("last_seen_at")})


@query
def pat_fold(spark, sf_dir):
    rules = X.rules(spark)
    kept = sinks.persisted_only(X.logs(spark, sf_dir))
    rows = P.pattern_rows(analysis.applied(analysis.extracted(kept), rules))
    return _pattern_view(P.patterns(P.fold_patterns(rows)))


@query
def pat_merge(spark, sf_dir):
    rows = P.pattern_rows(history(spark, sf_dir)["candidates"])
    before = F.col("last.at") < as_of()
    stored, batch = P.fold_patterns(rows.filter(before)), P.fold_patterns(rows.filter(~before))
    return _pattern_view(P.patterns(P.merge_patterns(stored, batch)))


@query
def pat_get(spark, sf_dir):
    h = history(spark, sf_dir)
    wanted = h["diagnostics"].filter(F.col("severity") == "Warning").select("fingerprint")
    return P.pattern_details(h["patterns"], wanted).select(
        "fingerprint", "title", "tool_kind", "category", "canonical_message", "occurrence_count",
        lst("known_fixes").alias("known_fixes"), ts("first_seen_at").alias("first_seen"), ts("last_seen_at").alias("last_seen"),
    )


@query
def pat_summaries(spark, sf_dir):
    h = history(spark, sf_dir)
    wanted = h["diagnostics"].filter(F.col("project_name") == "proj1").select("fingerprint")
    return P.pattern_summaries(h["patterns"], wanted).withColumn("last_seen_at", ts("last_seen_at"))


@query
def pat_top(spark, sf_dir):
    return P.top_patterns(history(spark, sf_dir)["patterns"], 20).select(
        "fingerprint", "title", "tool_kind", "occurrence_count", ts("last_seen_at").alias("last_seen")
    )


@query
def pat_top_tool(spark, sf_dir):
    return P.top_patterns_per_tool(history(spark, sf_dir)["patterns"], 3).select(
        "tool_kind", "position", "fingerprint", "occurrence_count"
    )


# ---------------------------------------------------------------- history


def _requests_of(h: dict[str, DataFrame]) -> DataFrame:
    return h["analyses"].withColumnRenamed("analysis_id", "request_id")


@query
def his_get(spark, sf_dir):
    """Every part of every document. A fourth of the analyses is older than the snapshots and is rebuilt, some of them from
    names that are no longer known; the raw content of one project was purged after its snapshots."""
    h = history(spark, sf_dir)
    analyses = V.purge_raw(h["analyses"], h["analyses"].filter(F.col("project_name") == "proj5"))
    d = sinks.diagnostic_rows(h["diagnostics"].withColumnRenamed("analysis_id", "log_id"))
    odd = (F.col("analysis_id") % 8 == 1) & (F.col("order_index") % 3 == 0)
    d = d.withColumn("severity", F.when(odd, F.lit("Severe")).otherwise(F.col("severity")))
    g = sinks.group_rows(h["groups"].withColumnRenamed("analysis_id", "log_id"))
    g = g.withColumn("primary_diagnostic_id", F.when(F.col("analysis_id") % 16 == 1, F.lit(" ")).otherwise(F.col("primary_diagnostic_id")))
    found = H.get_analyses(analyses.select("analysis_id"), analyses, h["snapshots"].filter("analysis_id % 4 <> 1"), d, g)
    return sinks.document_rows(found, "origin")


@query
def his_related(spark, sf_dir):
    h = history(spark, sf_dir)
    related = H.related_analyses(_requests_of(h), h["analyses"], 3)
    return H.with_analysis_text(related, h["analyses"]).select(
        "request_id", "analysis_id", "position", lst("matching_fingerprints").alias("matching"), "tool_detected",
        "summary_text", ts("created_at").alias("created"),
    )


@query
def sim_tokens(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"),
        F.sha2(F.array_join(F.array_sort(tokens(F.col("text"))), " "), 256).alias("token_sha"),
    )


def _reference_requests(h: dict[str, DataFrame], spark) -> DataFrame:
    return K.reference_requests(h["analyses"], h["diagnostics"], h["rule_matches"], X.rules(spark))


def staged(df: DataFrame, name: str) -> DataFrame:
    """A written table in the shared folder: what several later steps read is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _every(h, spark) -> DataFrame:
    return staged(_reference_requests(h, spark), "requests")


@query
def sim_score(spark, sf_dir):
    """Every stored diagnostic against every analysis."""
    h = history(spark, sf_dir)
    return H.scored_diagnostics(_every(h, spark), h["diagnostics"]).select(
        "request_id", "diagnostic_id", F.round("score", 6).alias("score"), "match_type"
    )


@query
def sim_search(spark, sf_dir):
    """Similar analyses of every analysis."""
    h = history(spark, sf_dir)
    return H.similar_analyses(_every(h, spark), h["diagnostics"], C.KNOWLEDGE_SIMILAR).select(
        "request_id", "analysis_id", "position", "match_type", "match_score", "summary_text",
        lst("matching_fingerprints").alias("matching_fingerprints"), lst("matching_codes").alias("matching_codes"),
    )


@query
def nar_get(spark, sf_dir):
    return H.stored_narratives(history(spark, sf_dir)["analyses"]).select(
        "analysis_id", "tool_detected", "narrative_summary", lst("group_summaries").alias("group_summaries"),
        lst("next_steps").alias("next_steps"), "narrative_source",
    )


def _document_narratives(spark, sf_dir) -> DataFrame:
    d, o = X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "orders")
    null = F.lit(None).cast("string")
    return d.join(o, d.doc_id == o.o_orderkey, "left").select(
        F.col("doc_id").alias("analysis_id"), F.col("text").alias("narrative_summary"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("deterministic")).otherwise(F.lit("ai")).alias("narrative_source"),
        F.element_at(F.array(*[F.lit(t) for t in ("DotNet", "Npm", "Vite")]), (F.col("doc_id") % 3 + 1).cast("int")).alias(
            "tool_detected"
        ),
        F.col("source").alias("project_name"), F.col("lang").alias("repository"), F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("array<string>").alias("group_summaries"), F.lit(None).cast("array<string>").alias("next_steps"),
        null.alias("narrative_reason"), F.when(F.col("doc_id") % 2 == 1, F.lit("local")).alias("narrative_provider"),
        null.alias("narrative_model"),
    )


@query
def nar_history(spark, sf_dir):
    rows = H.narrative_history(_document_narratives(spark, sf_dir), 50, tool="Npm", source="ai")
    return rows.select("analysis_id", "project_name", "repository", ts("created_at").alias("created"))


def _found_narratives(rows: DataFrame) -> DataFrame:
    return rows.select(
        "analysis_id", "score", lst("matched_fields").alias("fields"), "match_snippet", ts("created_at").alias("created")
    )


@query
def nar_search(spark, sf_dir):
    return _found_narratives(H.search_narratives(_document_narratives(spark, sf_dir), " EN ", 50))


@query
def nar_search_index(spark, sf_dir):
    """The same search through the trigram index of all narratives, which is written first."""
    narratives, path = _document_narratives(spark, sf_dir), scratch(spark, "narrative-index")
    TI.write_index(narratives, path)
    return _found_narratives(TI.search(narratives, TI.open_index(spark, path), " License", 50))


@query
def nar_snippet(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", H.snippet(F.col("text"), "the ").alias("snippet"))


# ---------------------------------------------------------------- knowledge


def _references(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id", "id", "kind", "source", "title", "summary", "url", "resource_type", "resource_id",
        lst("tags").alias("tags"),
    )


@query
def kno_request(spark, sf_dir):
    rows = _reference_requests(history(spark, sf_dir), spark)
    return rows.select(
        "request_id", "tool_kind", lst("codes").alias("codes"), lst("messages").alias("messages"),
        lst("fingerprints").alias("fingerprints"), lst("categories").alias("categories"),
        F.array_join(F.transform("rule_ids", lambda x: x.cast("string")), " | ").alias("rule_ids"),
    )


@query
def kno_docs_code(spark, sf_dir):
    return _references(K.documents_by_code(_reference_requests(history(spark, sf_dir), spark)))


@query
def kno_docs_category(spark, sf_dir):
    return _references(K.documents_by_category(_reference_requests(history(spark, sf_dir), spark)))


@query
def kno_rules(spark, sf_dir):
    return _references(K.rule_references(_reference_requests(history(spark, sf_dir), spark), X.rules(spark)))


@query
def kno_patterns(spark, sf_dir):
    h = history(spark, sf_dir)
    return _references(K.pattern_references(_reference_requests(h, spark), h["patterns"]))


@query
def kno_prior(spark, sf_dir):
    h = history(spark, sf_dir)
    related = H.related_analyses(_reference_requests(h, spark), h["analyses"], C.KNOWLEDGE_PRIOR)
    return _references(K.prior_references(H.with_analysis_text(related, h["analyses"])))


def _knowledge_parts(h, spark, requests: DataFrame, scope: list[str] | None = None) -> list[DataFrame]:
    related = H.related_analyses(requests, h["analyses"], C.KNOWLEDGE_PRIOR, scope)
    prior = K.prior_references(H.with_analysis_text(related, h["analyses"]))
    rules = K.rule_references(requests, X.rules(spark))
    patterns = K.pattern_references(requests, h["patterns"])
    similar = H.similar_analyses(requests, h["diagnostics"], C.KNOWLEDGE_SIMILAR, scope).join(
        h["analyses"].select("analysis_id", "project_name", "repository"), "analysis_id"
    )
    kinds = requests.select("request_id", "tool_kind")
    so_far = staged(rules.unionByName(patterns).unionByName(prior), "references")
    more = K.similar_references(similar.join(kinds, "request_id"), so_far)
    parts = [so_far.filter(F.col("kind") == kind) for kind in ("rule", "recurring-pattern", "prior-analysis")]
    return [K.documents_by_code(requests), K.documents_by_category(requests), *parts, more]


@query
def kno_similar(spark, sf_dir):
    """References to similar analyses for every analysis."""
    h = history(spark, sf_dir)
    return _references(_knowledge_parts(h, spark, _every(h, spark))[-1])


@query
def kno_merge(spark, sf_dir):
    """Merged references of every analysis."""
    h = history(spark, sf_dir)
    merged = K.merge_references(_knowledge_parts(h, spark, _every(h, spark)))
    return merged.select("request_id", "position", "id", "kind", "title", "summary")


@query
def kno_pattern_detail(spark, sf_dir):
    """Details of every pattern."""
    h = history(spark, sf_dir)
    top = staged(h["patterns"], "all-patterns")
    related = R.related_rules(_related_contexts({"diagnostics": h["diagnostics"], "patterns": top}), X.rules(spark))
    ids = related.groupBy("fingerprint").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "rule_id"))), lambda x: x["rule_id"]).alias("rule_ids")
    )
    none = F.array().cast("array<string>")
    requests = staged(top.join(ids, "fingerprint", "left").select(
        F.col("fingerprint").alias("request_id"), "tool_kind", F.array("fingerprint").alias("fingerprints"),
        F.array_compact(F.array("diagnostic_code")).alias("codes"), F.array("category").alias("categories"),
        F.coalesce("rule_ids", F.array().cast("array<int>")).alias("rule_ids"),
        F.coalesce(tokens(F.col("canonical_message")), none).alias("query_tokens"),
        F.lit(None).cast("string").alias("project_name"), F.lit(None).cast("string").alias("repository"),
    ), "pattern-requests")
    merged = K.merge_references(_knowledge_parts(h, spark, requests, []))
    return K.pattern_documents(top, related, merged).select(
        "fingerprint", "title", "occurrence_count", F.to_json("related_rules").alias("related_rules"),
        F.to_json("references").alias("references"),
    )


# ---------------------------------------------------------------- privacy


@query
def prv_redact_log(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = X.table(spark, sf_dir, "pages")
    p = p.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("text"))
    return d.unionByName(p).select("kind", "id", redact_log(F.col("text")).alias("redacted"))


@query
def prv_redact_raw(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = X.table(spark, sf_dir, "pages")
    p = p.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("text"))
    return (
        d.unionByName(p)
        .withColumn("_redacted", redact_raw(F.col("text")))
        .select(
            "kind", "id", F.length("_redacted").alias("n_chars"), F.sha2("_redacted", 256).alias("sha"),
            (F.col("_redacted") != F.col("text")).alias("was_redacted"),
        )
    )


@query
def prv_store_policy(spark, sf_dir):
    rows = V.stored_raw_content(X.logs(spark, sf_dir))
    return rows.select("log_id", F.sha2("raw_content", 256).alias("raw_sha"), "raw_content_redacted")


@query
def prv_purge_raw(spark, sf_dir):
    a = history(spark, sf_dir)["analyses"]
    purged = V.purge_raw(a, a.filter(F.col("project_name") == "proj5").select("analysis_id"))
    return purged.select("analysis_id", F.col("raw_content").isNotNull().alias("has_raw"), "raw_content_redacted")


@query
def prv_delete(spark, sf_dir):
    h = history(spark, sf_dir)
    tables = {n: h[n].select("analysis_id") for n in ("analyses", "diagnostics", "groups")}
    tables["occurrences"] = P.occurrences(h["diagnostics"].withColumnRenamed("analysis_id", "log_id")).select("analysis_id")
    left = V.delete_analyses(tables, h["analyses"].filter(F.col("project_name") == "proj3"))
    result = h["patterns"].agg(F.lit("patterns").alias("table"), F.sum("occurrence_count").alias("n"))
    for name, table in left.items():
        result = result.unionByName(table.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n")))
    return result


@query
def prv_retention(spark, sf_dir):
    return V.retention_report(history(spark, sf_dir)["analyses"], as_of(), 365, 1000)


@query
def prv_retention_apply(spark, sf_dir):
    """A retention run on a copy of the stored analyses, partition by partition."""
    path = scratch(spark, "retained")
    sinks.write_table(history(spark, sf_dir)["analyses"].drop(sinks.DATE), path, "created_at", unit="month")
    V.retain(spark, path, as_of(), 365, 1000, scratch(spark, "retained-rest"))
    return spark.read.parquet(path).select("analysis_id", F.col("raw_content").isNotNull().alias("has_raw"), "raw_content_redacted")


@query
def prv_expiry(spark, sf_dir):
    created = F.col("created_at").cast("timestamp")
    return X.logs(spark, sf_dir).select(
        "log_id", ts(V.expiry(created, C.RAW_RETENTION_DAYS)).alias("raw_expires"),
        ts(V.expiry(created, C.ANALYSIS_RETENTION_DAYS)).alias("analysis_expires"),
        ts(V.expiry(created, 0)).alias("never"),
    )


# ---------------------------------------------------------------- telemetry


def _events(spark, sf_dir) -> DataFrame:
    per_log = G.summary(G.group_rows(_segments(spark, sf_dir)))
    return TM.events(
        per_log.withColumns(
            {
                "ai_requested": F.col("log_id") % 4 == 0,
                "ai_completed": F.col("log_id") % 8 == 0,
                "persistence_requested": F.col("log_id") % 5 != 0,
                "persistence_succeeded": (F.col("log_id") % 5 != 0) & (F.col("log_id") % 7 != 0),
                "duration_ms": (F.col("log_id") % 97).cast("int"),
            }
        )
    )


@query
def tel_event(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "log_id", "input_type", "tool_detected", "parser", "parse_succeeded", "is_unmatched", "diagnostics_count",
        "group_count", "candidate_count", F.array_join("fingerprints", ",").alias("fingerprints"),
    )


@query
def tel_analysis(spark, sf_dir):
    totals = TM.analysis_totals(_events(spark, sf_dir))
    rates = ["average_duration_ms", "average_diagnostics", "ai_request_rate", "unmatched_rate"]
    return totals.withColumns({c: F.round(c, 6) for c in rates})


@query
def tel_top(spark, sf_dir):
    events = _events(spark, sf_dir)
    return TM.top_counts(events, 15)


@query
def tel_metric_tags(spark, sf_dir):
    return TM.metric_tags(_events(spark, sf_dir))


def _accesses(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return X.table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("route"),
        F.when(F.col("event_id") % 3 == 0, F.lit("GET")).when(F.col("event_id") % 3 == 1, F.lit("POST")).alias("method"),
        (F.lit(200) + k % 10).alias("status"), F.col("value").alias("duration_ms"),
    )


@query
def tel_http(spark, sf_dir):
    return TM.http_totals(_accesses(spark, sf_dir)).withColumn("average_duration_ms", F.round("average_duration_ms", 4))


@query
def tel_http_summary(spark, sf_dir):
    rows = TM.http_summary(_accesses(spark, sf_dir), 3)
    return rows.withColumn("average_duration_ms", F.round("average_duration_ms", 4))


# ---------------------------------------------------------------- enrichment


def _answers(spark, sf_dir) -> DataFrame:
    """Every assistant turn as a raw model answer, for the log whose number is 16 times the conversation plus the turn."""
    turns = X.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    upper = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    items = F.array(F.concat(F.lit(" "), F.col("text")), upper, F.lit("  "), F.lit("Check the log."))
    document = F.to_json(
        F.struct(
            F.col("text").alias("explanation"), items.alias("likelyCauses"), F.array().cast("array<string>").alias("suggestedFixes"),
            F.col("text").alias("summary"), items.alias("groupSummaries"), items.alias("recommendedNextSteps"),
        )
    )
    kind = F.col("conv_id") % 4
    return turns.select(
        (F.col("conv_id") * 16 + F.col("turn")).cast("long").alias("log_id"),
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, document)
        .when(kind == 2, F.concat(F.lit("```json\n"), document, F.lit("\n```")))
        .otherwise(F.concat(F.lit('{"explanation": '), F.col("text")))
        .alias("raw_output"),
    )


@query
def enr_parse(spark, sf_dir):
    return EN.parse_explanations(_answers(spark, sf_dir)).select(
        "log_id", "text", lst("first_list").alias("causes"), lst("second_list").alias("fixes"), "readable"
    )


@query
def enr_candidate(spark, sf_dir):
    rows = EN.overlay_candidates(_ranked(spark, sf_dir), EN.parse_explanations(_answers(spark, sf_dir)))
    return rows.select(
        "log_id", "rank", "fingerprint", "explanation", lst("likely_causes").alias("causes"),
        lst("suggested_fixes").alias("fixes"), "enrich_status",
    )


@query
def enr_narrative(spark, sf_dir):
    rows = EN.overlay_narratives(
        _narrated(spark, sf_dir), EN.parse_narratives(_answers(spark, sf_dir)), "local", "model-1"
    )
    return rows.select(
        "log_id", "narrative_source", "narrative_provider", "narrative_summary",
        lst("group_summaries").alias("group_summaries"), lst("next_steps").alias("next_steps"),
    )


@query
def enr_tasks(spark, sf_dir):
    logs = G.summary(G.group_rows(_segments(spark, sf_dir))).withColumns(
        {
            "want_explanation": F.col("log_id") % 2 == 0,
            "want_narrative": F.col("log_id") % 3 == 0,
            "has_candidate": F.col("group_count") > 0,
            "has_narrative": (F.col("input_type") == "BuildLog")
            & ((F.col("total_diagnostics") > 1) | (F.col("group_count") > 1)),
            "explanation_configured": F.col("repository") != "repoP",
            "narrative_configured": F.col("repository") != "repoF",
            "explanation_status": F.when(F.col("log_id") % 5 > 0, F.lit("completed")),
            "narrative_status_ai": F.when(F.col("log_id") % 5 > 1, F.lit("Completed")),
        }
    )
    done = EN.task_rows(logs)
    return done.select(
        "log_id",
        F.array_join(
            F.transform("ai_tasks", lambda t: F.concat_ws(":", t["feature"], t["status"], t["reason"])), " | "
        ).alias("tasks"),
        "used_ai", F.col("single_task.feature").alias("single_task"),
    )


# ---------------------------------------------------------------- streaming


def _stream_input(df: DataFrame, path: str, key: str, batches: int = 2) -> DataFrame:
    """Rows written as files that arrive in ``batches``; a batch has files enough for all cores to write and to read it."""
    files = max(2, df.sparkSession.sparkContext.defaultParallelism)
    df.repartition(batches * files, F.xxhash64(key)).write.mode("overwrite").parquet(path)
    return ST.read_stream(df.sparkSession, path, files_per_batch=files)


def _finish(stream_query) -> None:
    stream_query.awaitTermination()


@query
def str_extract(spark, sf_dir):
    base = scratch(spark, "str-extract")
    stream = _stream_input(X.logs(spark, sf_dir), f"{base}/in", "log_id")
    _finish(ST.extract_stream(stream, f"{base}/out", f"{base}/cp"))
    return ST.deltas(spark, f"{base}/out").select("log_id", "diagnostic_id", "code", "category", "fingerprint")


@query
def str_candidates(spark, sf_dir):
    base = scratch(spark, "str-candidates")
    stream = _stream_input(X.logs(spark, sf_dir), f"{base}/in", "log_id")
    _finish(ST.candidate_stream(stream, X.rules(spark), f"{base}/out", f"{base}/cp"))
    return _applied_view(ST.deltas(spark, f"{base}/out"))


@query
def str_patterns(spark, sf_dir):
    base = scratch(spark, "str-patterns")
    rows = history(spark, sf_dir)["candidates"].filter(F.col("fingerprint").isNotNull())
    _finish(ST.pattern_stream(_stream_input(rows, f"{base}/in", "log_id"), f"{base}/out", f"{base}/cp"))
    return _pattern_view(P.patterns(ST.pattern_state(spark, f"{base}/out")))


@query
def str_telemetry(spark, sf_dir):
    """Events in files that hold all times mixed, one file to a batch: every batch has rows late for the one before."""
    base = scratch(spark, "str-telemetry")
    events = X.table(spark, sf_dir, "events").select("ts", "event_type", "value")
    events.repartition(6, "value").write.mode("overwrite").parquet(f"{base}/in")
    _finish(ST.telemetry_stream(ST.read_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/cp"))
    return ST.telemetry_table(spark, f"{base}/out").select(
        ts("window_start").alias("window_start"), "event_type", "count", F.round("total", 4).alias("total")
    )


@query
def str_windows(spark, sf_dir):
    """Events arrive by ten days of arrival, each seventh eight days after its time; windows close two days behind."""
    base, parts = scratch(spark, "str-windows"), 4
    events = X.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    arrival = F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("INTERVAL 8 days")).otherwise(F.col("ts"))
    days = F.floor(F.date_diff(arrival, F.lit("2024-01-01").cast("date")) / 10)
    part = F.least(F.lit(parts - 1), F.greatest(F.lit(0), days))
    for k in range(parts):
        events.filter(part == k).write.mode("append").parquet(f"{base}/in")
        _finish(ST.window_stream(ST.read_stream(spark, f"{base}/in", 1_000_000), f"{base}/out", f"{base}/cp", "2 days"))
    total = lambda name: F.round(name, 4).alias(name)
    return ST.window_table(spark, f"{base}/out", "2 days").select(
        ts("window_start").alias("window_start"), "event_type", "closed", "on_time", total("on_time_total"), "late", total("late_total")
    )


@query
def str_rule_hits(spark, sf_dir):
    base = scratch(spark, "str-rules")
    stream = _stream_input(history(spark, sf_dir)["rule_matches"], f"{base}/in", "analysis_id")
    _finish(ST.rule_hit_stream(stream, f"{base}/out", f"{base}/cp"))
    return ST.rule_hits(spark, X.rules(spark), f"{base}/out").select(
        "rule_id", "match_count", ts("last_matched_at").alias("last_matched")
    )
