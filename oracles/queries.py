"""Checking SQL per registered query. Queries without an entry are checked by brute force in the tests."""

from __future__ import annotations

from faultlines import constants as C
from faultlines.sources.fixtures import DRAFTS_SQL, MANY_RULES_SQL, REGEX_RULES_SQL
from oracles.base import (
    CTES, _alias, _ordered_distinct, apps_sql, build, by_text, case, collapse, cte, detection_sql, normalize_dotnet,
    normalize_js, normalize_python, normalize_tsc, nz, parser_sql, patterns_sql, q, rx, slashes, str_list, sub, trim,
    _insight, _scope,
)

ORACLES: dict[str, str] = {}
AS_OF = "TIMESTAMP '2000-01-01 00:00:00'"


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def lst(x: str) -> str:
    return f"array_to_string({x}, ' | ')"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


# ---------------------------------------------------------------- sources
oracle("src_logs", f"SELECT log_id, sha256(content) AS content_sha, CAST(length(content) AS INT) AS n_chars, input_type, tool_hint, project_name, repository, {ts('created_at')} AS created FROM logs")
_blank = f"{trim('content')} = ''"
oracle(
    "src_validate",
    f"""SELECT log_id, 'content' AS field, CASE WHEN {_blank} THEN 'Content is required.' ELSE 'Content must be {C.MAX_CONTENT_CHARS} characters or fewer.' END AS message
      FROM requests WHERE {_blank} OR length(content) > {C.MAX_CONTENT_CHARS}
    UNION ALL SELECT log_id, 'tool', 'Tool must be one of: dotnet, typescript, npm, vite, python, generic.' FROM requests WHERE tool_hint IS NOT NULL AND {trim('tool_hint')} <> '' AND {_alias} IS NULL
    UNION ALL SELECT log_id, 'options.persistRawContent', 'PersistRawContent can only be true when Persist is also true.' FROM requests WHERE store_raw AND NOT persist""",
)
cte("rejections", ORACLES["src_validate"])
oracle(
    "src_rejected",
    "SELECT log_id, field, message, (SELECT count(*) FROM requests) - (SELECT count(DISTINCT log_id) FROM rejections) AS accepted, (SELECT count(DISTINCT log_id) FROM rejections) AS rejected FROM rejections",
)
oracle("src_tool_alias", f"SELECT log_id, tool_hint, {_alias} AS tool FROM requests")
_whole = "input_type = 'BuildLog' AND"
cte(
    "contexts_of",
    f"""SELECT log_id, list_filter([CASE WHEN log_id % 3 = 0 THEN 'branch=main' END, CASE WHEN log_id % 10 IN (1, 2) THEN 'commitSha=' || left(sha256(CAST(log_id AS VARCHAR)), 12) END,
      CASE WHEN {_whole} log_id % 5 > 1 THEN 'environment.ci=' || CASE WHEN log_id % 5 = 2 THEN 'true' ELSE 'false' END END,
      CASE WHEN {_whole} log_id % 7 = 0 THEN 'environment.machineName=agent-' || log_id % 9 END,
      CASE WHEN {_whole} log_id % 6 < 3 THEN 'environment.os=linux' WHEN {_whole} log_id % 6 = 3 THEN 'environment.os=windows' END,
      'projectName=' || project_name, CASE WHEN log_id % 4 <> 0 THEN 'repository=' || repository END], lambda x: x IS NOT NULL) AS p FROM logs""",
)
oracle("src_context", "SELECT log_id, CASE WHEN len(p) > 0 THEN array_to_string(p, ';') END AS context FROM contexts_of")
oracle("src_hash", "SELECT log_id, sha256(content) AS sha, left(sha256(content), 12) AS prefix, CAST(len(string_split(content, chr(10))) AS INT) AS lines FROM logs")

# ---------------------------------------------------------------- raw redaction of logs (no look-behind: the character before is captured)


def _redact_raw(x: str) -> str:
    # Steps 1, 2, 4, 5 as they are; step 3 with a captured prefix, run twice because neighbours share a character.
    for i, (_, regex, replacement) in enumerate(C.RAW_REDACTIONS):
        if i == 2:
            x = f"regexp_replace({x}, '(^|[^A-Za-z0-9_\\-])/(?:[^\\s/]+/)*[^\\s/:]+', '\\1[redacted-path]', 'g')"
        else:
            x = sub(x, regex, replacement)
    x = sub(x, r"\b(?:(token)|(secret|password|api[_-]?key))\b\s*[:=]\s*([^\s,;]+)", r"<<\1#\2>>", "i")
    x = sub(x, r"<<([^#<>]+)#>>", r"\1=" + C.RAW_SECRET_TOKEN)
    return sub(x, r"<<#([^#<>]+)>>", r"\1=" + C.RAW_SECRET_OTHER)


cte("raw_logs", f"SELECT log_id, content, CASE WHEN store_raw THEN {_redact_raw('content')} END AS raw_content FROM logs")

# ---------------------------------------------------------------- sinks
oracle(
    "sink_analyses",
    f"""SELECT s.log_id AS analysis_id, input_type, tool_detected, total_diagnostics, group_count, primary_issue_count, error_count, warning_count, parser_name AS parser, parse_confidence,
      narrative_summary, group_summaries, next_steps, CASE WHEN gate THEN 'deterministic' END AS narrative_source, project_name, repository, sha256(r.content) AS raw_content_hash,
      r.raw_content IS NOT NULL AND r.raw_content <> r.content AS raw_content_redacted, {ts('created_at')} AS created FROM stored_narr s JOIN raw_logs r USING (log_id)""",
)
oracle(
    "sink_diagnostics",
    """SELECT diagnostic_id AS id, log_id AS analysis_id, parser_tool AS tool_kind, source, code, severity, message, normalized_message, file_path, line, segment AS raw_snippet, category, fingerprint,
      CAST(row_number() OVER (PARTITION BY log_id ORDER BY seg) - 1 AS INT) AS order_index FROM stored_diags""",
)
oracle(
    "sink_groups",
    f"""SELECT 'grp_' || g.log_id || '_' || (order_index + 1) AS id, g.log_id AS analysis_id, fingerprint, cnt AS count,
      CASE WHEN cnt = 1 THEN {q(C.GROUP_REASON_SINGLE)} ELSE {q(C.GROUP_REASON_MANY)} END AS group_reason, primary_id AS primary_diagnostic_id, {lst('ids')} AS related, order_index
      FROM grps g JOIN par p USING (log_id) WHERE p.persist""",
)
oracle(
    "sink_gate",
    """SELECT log_id, persist AND repository <> 'repoO' AS persisted, nullif(concat_ws('; ', CASE WHEN input_type = 'SingleDiagnostic' THEN 'single' END,
      CASE WHEN persist AND repository = 'repoO' THEN 'persistence-failure:_Unwritable' END), '') AS notes FROM logs""",
)


def documents_sql(parts: list[str], severity: str = "severity", primary: str = "primary_id", kept: str = "true") -> str:
    """Flat rows (log_id, part, position, item) of stored documents."""
    reason = f"CASE WHEN cnt = 1 THEN {q(C.GROUP_REASON_SINGLE)} ELSE {q(C.GROUP_REASON_MANY)} END"
    sql = {
        "diagnostic": f"""SELECT log_id, 'diagnostic' AS part, pos AS position, concat_ws('|', diagnostic_id, {severity}, code, category, fingerprint, message, file_path, line) AS item
          FROM (SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY seg) - 1 AS INT) AS pos FROM stored_diags)""",
        "group": f"SELECT log_id, 'group', order_index, concat_ws('|', fingerprint, cnt, {reason}, {primary}, array_to_string(ids, ',')) FROM grps JOIN par p USING (log_id) WHERE p.persist",
        "candidate": "SELECT log_id, 'candidate', rank - 1, concat_ws('|', fingerprint, title, explanation, array_to_string(suggested_fixes, ',')) FROM stored_cands",
        "rule": "SELECT log_id, 'rule', CAST(row_number() OVER (PARTITION BY log_id ORDER BY rule_id, target_type, target_id) - 1 AS INT), concat_ws('|', rule_id, target_type, target_id) FROM stored_apps",
        "summary": "SELECT log_id, 'summary', 0, concat_ws('|', total_diagnostics, group_count, primary_issue_count, error_count, warning_count) FROM stored_narr",
        "narrative": "SELECT log_id, 'narrative', 0, concat_ws('|', narrative_summary, group_summaries, next_steps) FROM stored_narr WHERE gate",
        "processing": "SELECT log_id, 'processing', 0, concat_ws('|', 'false', parser_name) FROM stored_narr",
        "context": "SELECT log_id, 'context', CAST(unnest(range(len(p))) AS INT), unnest(p) FROM contexts_of JOIN stored_narr USING (log_id)",
        "content": f"SELECT log_id, 'content', 0, concat_ws('|', sha256(content), raw_content IS NOT NULL AND {kept}, coalesce(raw_content <> content, false) AND {kept}) FROM raw_logs JOIN stored_narr USING (log_id)",
    }
    return " UNION ALL ".join(sql[p] for p in parts)


_parts = ["diagnostic", "group", "candidate", "rule", "summary", "narrative", "processing", "context", "content"]
oracle("sink_snapshot", f"SELECT log_id AS analysis_id, part, position, item FROM ({documents_sql(_parts)})")
_found = documents_sql(
    _parts, "CASE WHEN log_id % 8 = 1 AND pos % 3 = 0 THEN 'Error' ELSE severity END", "CASE WHEN log_id % 16 = 1 THEN ids[1] ELSE primary_id END", "project_name <> 'proj5'"
)
oracle(
    "his_get",
    f"""SELECT log_id AS analysis_id, CASE WHEN log_id % 4 = 1 THEN 'rebuilt' ELSE 'snapshot' END AS origin, part, position, item FROM ({_found})
      WHERE NOT (log_id % 4 = 1 AND part IN ('candidate', 'rule'))""",
)
_view = documents_sql(["group", "candidate", "summary", "narrative", "processing"])
oracle(
    "prj_build_log",
    f"SELECT v.log_id AS analysis_id, {case('tool_detected', C.TOOL_TEXT)} AS tool, v.part, v.position, v.item FROM ({_view}) v(log_id, part, position, item) JOIN stored_narr s ON s.log_id = v.log_id WHERE s.input_type = 'BuildLog'",
)

# ---------------------------------------------------------------- detection
oracle("det_tool", "SELECT log_id, tool_detected, detection_confidence, detection_reason, was_explicit_hint FROM det")
cte(
    "accepted",
    f"SELECT * FROM requests WHERE NOT ({_blank}) AND length(content) <= {C.MAX_CONTENT_CHARS} AND (tool_hint IS NULL OR {trim('tool_hint')} = '' OR {_alias} IS NOT NULL) AND NOT (store_raw AND NOT persist)",
)
cte("accepted_det", detection_sql("accepted"))
cte("accepted_par", parser_sql("accepted_det"))
oracle("det_parser", "SELECT log_id, tool_detected, parser_tool, parser_name, failure_reason FROM accepted_par")

# ---------------------------------------------------------------- segments
oracle(
    "seg_lines",
    r"""SELECT log_id, CAST(n AS INT) AS n, regexp_replace(line, '\s+$', '') AS line FROM (
      SELECT log_id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS n FROM logs)""",
)
for name, tools in (("seg_dotnet", "'DotNet'"), ("seg_tsc", "'TypeScript'"), ("seg_python", "'Python'"), ("seg_whole", "'Npm', 'Vite'")):
    oracle(name, f"SELECT log_id, seg, segment FROM segs WHERE parser_tool IN ({tools})")
oracle("seg_unparsed", "SELECT log_id, parser_tool, seg, segment FROM segs s WHERE NOT EXISTS (SELECT 1 FROM diags d WHERE d.log_id = s.log_id AND d.seg = s.seg)")
oracle("seg_stats", "SELECT log_id, parser_name, total_segments, parsed_segments, unparsed_segments, parse_confidence FROM stats")

# ---------------------------------------------------------------- extraction
_place = "file_path, line, col, end_line, end_col"
oracle("ext_dotnet_loc", f"SELECT log_id, seg, code, severity, message, {_place}, meta FROM dotnet_located")
oracle("ext_dotnet_simple", "SELECT log_id, seg, code, severity, message, file_path, meta FROM dotnet_plain")
oracle("ext_dotnet_source", "SELECT log_id, seg, code, source FROM dotnet_located UNION ALL SELECT log_id, seg, code, source FROM dotnet_plain")
oracle("ext_severity", "SELECT parser_tool, severity, count(*) AS n, count(DISTINCT log_id) AS logs FROM diags GROUP BY ALL")
oracle("ext_tsc", f"SELECT log_id, seg, code, severity, message, source, {_place} FROM tsc_rows")
oracle("ext_py_exception", "SELECT log_id, seg, code, message, source, meta FROM python_rows")
oracle("ext_py_frame", r"""SELECT log_id, seg, file_path, line, CAST(regexp_extract(meta, 'frameCount=(\d+)', 1) AS INT) AS frames, nullif(regexp_extract(meta, 'function=(.*)$', 1), '') AS function FROM python_rows""")
oracle("ext_py_caret", "SELECT log_id, seg, code, col FROM python_rows WHERE col IS NOT NULL")
oracle("ext_npm_script", "SELECT log_id, seg, message, meta FROM npm_rows WHERE code = 'NPM_MISSING_SCRIPT'")
for name, cols in (("ext_npm_code", "code"), ("ext_npm_message", "message"), ("ext_npm_path", "file_path, meta")):
    oracle(name, f"SELECT log_id, {cols} FROM npm_rows WHERE code <> 'NPM_MISSING_SCRIPT'")
for name, code in (("import", "VITE_RESOLVE_IMPORT"), ("export", "VITE_MISSING_EXPORT"), ("parse", "VITE_PARSE_ERROR"), ("fallback", "VITE_BUILD_ERROR")):
    oracle(f"ext_vite_{name}", f"SELECT log_id, message, {normalize_js('code', 'tmpl')} AS normalized_message, {_place}, meta FROM vite_rows WHERE code = {q(code)}")
oracle(
    "ext_all",
    f"""SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY seg) - 1 AS INT) AS order_index, tool_detected, parser_tool AS tool_kind, code, severity, message, normalized_message, source,
      {_place}, meta, category, fingerprint, diagnostic_id FROM diags""",
)

# ---------------------------------------------------------------- normalisation, category, fingerprint
oracle(
    "nrm_ws",
    f"""SELECT 'document' AS kind, doc_id AS id, sha256({collapse('text')}) AS value FROM documents
      UNION ALL SELECT 'url', page_id, {slashes("replace(url, '/', chr(92))")} FROM pages""",
)
_norm = {
    "nrm_dotnet": ("'DotNet'", normalize_dotnet(collapse("message"))),
    "nrm_tsc": ("'TypeScript'", normalize_tsc(collapse("message"))),
    "nrm_python": ("'Python'", normalize_python("code", "message")),
    "nrm_js": ("'Npm', 'Vite'", normalize_js("code", "message")),
}
for name, (tools, expr) in _norm.items():
    oracle(name, f"SELECT log_id, seg, code, message, {expr} AS normalized FROM diags WHERE parser_tool IN ({tools})")
_text = {"cls_dotnet": ("'DotNet'", C.DOTNET_TEXT_CATEGORY), "cls_tsc": ("'TypeScript'", C.TYPESCRIPT_TEXT_CATEGORY), "cls_python": ("'Python'", C.PYTHON_TEXT_CATEGORY), "cls_js": ("'Npm', 'Vite'", C.JAVASCRIPT_TEXT_CATEGORY)}
for name, (tools, table) in _text.items():
    oracle(name, f"SELECT log_id, seg, code, category, {by_text('normalized_message', table)} AS by_text FROM diags WHERE parser_tool IN ({tools})")
oracle("fpr_hash", "SELECT log_id, seg, hashed FROM diags")
oracle("fpr_canonical", "SELECT log_id, seg, named FROM diags WHERE named IS NOT NULL")

# ---------------------------------------------------------------- groups, candidates, narrative, views
oracle(
    "grp_fingerprint",
    f"""SELECT log_id, fingerprint, cnt AS count, primary_id AS primary_diagnostic_id, {lst('ids')} AS related,
      CASE WHEN cnt = 1 THEN {q(C.GROUP_REASON_SINGLE)} ELSE {q(C.GROUP_REASON_MANY)} END AS group_reason, order_index FROM grps""",
)
oracle("rnk_confidence", "SELECT log_id, fingerprint, parse_confidence, confidence FROM cands")
oracle("rnk_signals", f"SELECT log_id, fingerprint, {lst('signals')} AS signals FROM cands")
oracle("rnk_candidates", "SELECT log_id, rank, fingerprint, primary_id AS diagnostic_id, confidence, title FROM cands")
oracle("rnk_insight", f"SELECT log_id, seg, {_insight(0)} AS title, {_insight(1)} AS explanation, {lst(_insight(2, True))} AS causes, {lst(_insight(3, True))} AS fixes FROM diags g")
oracle("sum_analysis", "SELECT log_id, total_diagnostics, group_count, primary_issue_count, error_count, warning_count FROM sums")
oracle("nar_gate", "SELECT log_id, total_diagnostics, group_count FROM narr WHERE gate")
for name, col in (("nar_summary", "narrative_summary"), ("nar_groups", "group_summaries"), ("nar_steps", "next_steps")):
    oracle(name, f"SELECT log_id, {col} FROM narr WHERE gate")
oracle(
    "prj_single",
    f"""SELECT p.log_id, coalesce(c.fingerprint, 'fp_unknown') AS fingerprint, {case('p.tool_detected', C.TOOL_TEXT, "'unknown'")} AS tool, c.primary_id AS diagnostic_id, c.code,
      {case('c.severity', C.SEVERITY_TEXT)} AS severity, {case('c.category', C.CATEGORY_TEXT)} AS category, d.message, coalesce(c.explanation, {q(C.SINGLE_DEFAULT_EXPLANATION)}) AS explanation,
      {lst('coalesce(c.likely_causes, [])')} AS likely_causes, {lst('coalesce(c.suggested_fixes, [])')} AS suggested_fixes, coalesce(c.confidence, 0.0)::DOUBLE AS confidence
      FROM par p LEFT JOIN cands c ON c.log_id = p.log_id AND c.rank = 1 LEFT JOIN diags d ON d.diagnostic_id = c.primary_id WHERE p.input_type = 'SingleDiagnostic'""",
)
oracle(
    "prj_enums",
    f"""SELECT {case('tool_detected', C.TOOL_TEXT, "'unknown'")} AS tool, {case('severity', C.SEVERITY_TEXT)} AS severity_text, {case('category', C.CATEGORY_TEXT)} AS category_text,
      {case('input_type', C.INPUT_TYPE_TEXT)} AS input, count(*) AS n FROM diags GROUP BY ALL""",
)

# ---------------------------------------------------------------- rules
cte("drafts", DRAFTS_SQL.replace("{part}", "part"))
_triggers = ["tool_kind", "code", "severity", "category", "message_regex", "file_path_regex", "fingerprint", "project_name", "repository"]
_no_trigger = " AND ".join(f"coalesce(trim({t}), '') = ''" for t in _triggers)
_tool = case("lower(trim(tool_kind))", C.TOOL_ALIASES)


def _in(names: list[str]) -> str:
    return ", ".join(q(n.lower()) for n in names)


oracle(
    "rul_validate",
    f"""SELECT rule_id, 'name' AS field, 'Name is required.' AS message FROM drafts WHERE trim(name) = ''
    UNION ALL SELECT rule_id, 'conditions', 'At least one condition trigger is required.' FROM drafts WHERE {_no_trigger}
    UNION ALL SELECT rule_id, 'conditions.tool', 'Tool must be a supported value.' FROM drafts WHERE tool_kind IS NOT NULL AND {_tool} IS NULL
    UNION ALL SELECT rule_id, 'conditions.severity', 'Severity must be a supported value.' FROM drafts WHERE severity IS NOT NULL AND lower(severity) NOT IN ({_in(C.SEVERITIES)})
    UNION ALL SELECT rule_id, 'conditions.category', 'Category must be a supported value.' FROM drafts WHERE category IS NOT NULL AND replace(lower(category), '-', '') NOT IN ({_in(C.CATEGORIES)})
    UNION ALL SELECT rule_id, 'conditions.projectName', 'ProjectName must be 200 characters or fewer.' FROM drafts WHERE length(project_name) > 200
    UNION ALL SELECT rule_id, 'conditions.repository', 'Repository must be 200 characters or fewer.' FROM drafts WHERE length(repository) > 200
    UNION ALL SELECT rule_id, 'actions', 'At least one action is required.' FROM drafts WHERE title IS NULL AND suggested_fix IS NULL AND confidence_adjustment = 0 AND NOT mark_primary""",
)
oracle("rul_unique_name", "SELECT trim(name) AS name, count(*) AS rules, min(rule_id) AS first_rule_id FROM drafts WHERE trim(name) <> '' GROUP BY trim(name) HAVING count(*) > 1")
oracle(
    "rul_merge",
    f"""SELECT rule_id, name, CASE WHEN priority % 3 = 0 THEN 'new ' || coalesce(title, 'title') ELSE title END AS title,
      CASE WHEN priority % 3 = 2 THEN is_enabled ELSE mark_primary OR is_enabled END AS is_enabled, match_count, '1999-01-01 00:00:00' AS created,
      CASE WHEN priority % 3 = 0 OR (priority % 3 = 1 AND mark_primary AND NOT is_enabled) THEN '2000-01-01 00:00:00' ELSE '1999-01-01 00:00:00' END AS updated FROM drafts
    UNION ALL SELECT rule_id + 1000000000000, name, 'new ' || coalesce(title, 'title'), mark_primary OR is_enabled, 0, '2000-01-01 00:00:00', '2000-01-01 00:00:00' FROM drafts WHERE priority % 3 = 0""",
)
oracle("rul_list", "SELECT rule_id, name, priority, match_count FROM drafts WHERE is_enabled AND lower(tag) = 'brand#2' ORDER BY priority DESC, match_count DESC, name, rule_id LIMIT 20 OFFSET 10")
oracle("rul_list_count", "SELECT count(*) AS total FROM drafts WHERE NOT is_enabled AND tool_kind = 'dotnet'")
oracle("rul_enabled", "SELECT tool_detected, logs, rule_id, priority FROM (SELECT tool_detected, count(*) AS logs FROM det GROUP BY 1) JOIN rules ON is_enabled AND (tool_kind IS NULL OR tool_kind = tool_detected)")
oracle(
    "rul_match_many",
    f"""SELECT m.rule_id, count(*) AS hits, count(DISTINCT d.log_id) AS logs FROM ({MANY_RULES_SQL.replace("{part}", "part")}) m JOIN diags d
      ON lower(m.project_name) = lower(d.project_name) AND (m.code IS NULL OR lower(m.code) = lower(d.code)) AND (m.severity IS NULL OR m.severity = d.severity)
      AND (m.repository IS NULL OR lower(m.repository) = lower(d.repository)) AND (m.message_regex IS NULL OR contains(lower(coalesce(d.normalized_message, d.message)), m.message_regex))
      WHERE m.is_enabled GROUP BY m.rule_id""",
)
oracle(
    "rul_match_regex",
    f"""SELECT m.rule_id, count(*) AS hits, count(DISTINCT d.log_id) AS logs FROM (
        SELECT *, CAST(rule_id % 11 AS VARCHAR) AS a, CAST(rule_id % 400 AS VARCHAR) AS b FROM ({REGEX_RULES_SQL.replace("{part}", "part")}) WHERE is_enabled) m
      JOIN (SELECT *, lower(coalesce(normalized_message, message)) AS t, lower(coalesce(file_path, '')) AS f FROM stored_diags) d
      ON CASE WHEN rule_id % 50 = 8 THEN contains(t, 'plugin ' || a) OR contains(t, 'package ' || a) WHEN rule_id % 3 = 0 THEN ends_with(t, 'find package ' || b)
        WHEN rule_id % 3 = 1 THEN contains(t, 'in ' || b || ' failed') ELSE ends_with(f, 'src/a' || b || '.ts') END
      GROUP BY m.rule_id""",
)
oracle(
    "rul_regex",
    """SELECT page_id AS rule_id, 'conditions.messageRegex' AS field, 'The regex pattern is invalid.' AS message FROM pages WHERE page_id % 2 = 1
      UNION ALL SELECT page_id, 'conditions.filePathRegex', 'The regex pattern is invalid.' FROM pages WHERE page_id % 3 = 0""",
)
oracle("rul_match_diag", "SELECT log_id, rule_id, target_id, fingerprint FROM apps WHERE target_type = 'diagnostic'")
oracle("rul_match_group", "SELECT log_id, rule_id, target_id, fingerprint FROM apps WHERE target_type = 'group'")
oracle("rul_scope", f"SELECT p.log_id, r.rule_id FROM logs p JOIN rules r ON (r.project_name IS NOT NULL OR r.repository IS NOT NULL) AND {_scope}")


def _flags(items: list[tuple[str, str]]) -> str:
    inner = ", ".join(f"CASE WHEN {cond} THEN {q(name)} END" for name, cond in items)
    return f"array_to_string(list_filter([{inner}], lambda x: x IS NOT NULL), ' | ')"


_set = {n: f"coalesce(trim({c}), '') <> ''" for n, c in (("projectName", "project_name"), ("repository", "repository"), ("tool", "tool_kind"), ("code", "code"), ("severity", "severity"), ("category", "category"), ("fingerprint", "fingerprint"), ("messageRegex", "message_regex"), ("filePathRegex", "file_path_regex"))}
_actions = [("title", "title IS NOT NULL"), ("explanation", "explanation IS NOT NULL"), ("suggestedFixes", "suggested_fix IS NOT NULL"), ("confidenceAdjustment", "confidence_adjustment <> 0"), ("markAsPrimaryCause", "mark_primary")]
oracle("rul_actions", f"SELECT rule_id, {_flags(_actions)} AS actions, {_flags(list(_set.items()))} AS conditions, {_flags([(n, _set[n]) for n in ('projectName', 'repository', 'fingerprint')])} AS group_conditions FROM drafts")
oracle("rul_apply", f"SELECT log_id, fingerprint, rank, applied_rules, round(confidence, 6) AS confidence, title, explanation, {lst('suggested_fixes')} AS fixes, {lst('signals')} AS signals FROM applied")
oracle(
    "rul_matches",
    f"""SELECT a.log_id, a.rule_id, a.target_type, a.target_id, CASE WHEN a.target_type = 'group' THEN {lst('d.group_conditions')} ELSE {lst('d.diagnostic_conditions')} END AS conditions,
      {lst('d.applied_actions')} AS actions, {ts('p.created_at')} AS applied FROM stored_apps a JOIN described d USING (rule_id) JOIN par p ON p.log_id = a.log_id""",
)
_record = f"""SELECT r.rule_id, count(a.log_id) AS match_count, {ts('max(p.created_at)')} AS last_matched FROM rules r LEFT JOIN stored_apps a ON a.rule_id = r.rule_id LEFT JOIN par p ON p.log_id = a.log_id GROUP BY r.rule_id"""
oracle("rul_record", _record)
oracle("str_rule_hits", _record)
cte(
    "contexts",
    """SELECT p.fingerprint, p.tool_kind, p.category, p.canonical_message, d.code, d.severity, d.file_path, d.project_name, d.repository FROM pats p JOIN (
      SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, oi, log_id DESC) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY seg) AS oi FROM stored_diags)) d ON d.fingerprint = p.fingerprint AND rn = 1""",
)
_tests = [
    ("fingerprint", "fingerprint", "lower(r.fingerprint) = lower(c.fingerprint)"), ("tool", "tool_kind", "lower(r.tool_kind) = lower(c.tool_kind)"),
    ("code", "code", "lower(r.code) = lower(c.code)"), ("severity", "severity", "lower(r.severity) = lower(c.severity)"), ("category", "category", "lower(r.category) = lower(c.category)"),
    ("message-regex", "message_regex", "regexp_matches(c.canonical_message, '(?i)' || r.message_regex)"), ("file-path-regex", "file_path_regex", "regexp_matches(c.file_path, '(?i)' || r.file_path_regex)"),
    ("projectName", "project_name", "lower(r.project_name) = lower(c.project_name)"), ("repository", "repository", "lower(r.repository) = lower(c.repository)"),
]
cte(
    "related",
    "SELECT c.fingerprint, r.rule_id, r.name, r.priority, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN r.{col} IS NOT NULL THEN {q(n)} END" for n, col, _ in _tests)
    + "], lambda x: x IS NOT NULL), ' | ') AS matched_by, "
    + " + ".join(f"CASE WHEN r.{col} IS NOT NULL THEN {C.RELATED_RULE_WEIGHTS[n]} ELSE 0 END" for n, col, _ in _tests)
    + " AS score FROM contexts c JOIN rules r ON r.is_enabled AND "
    + " AND ".join(f"(r.{col} IS NULL OR coalesce({t}, false))" for n, col, t in _tests)
    + " AND coalesce(" + ", ".join(f"CAST(r.{col} AS VARCHAR)" for n, col, _ in _tests) + ") IS NOT NULL",
)
oracle("rul_related", "SELECT fingerprint, rule_id, matched_by, score, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, priority DESC, name, rule_id) AS INT) AS position FROM related) WHERE position <= 5")
oracle("rul_preview", "SELECT log_id, fingerprint, previous_rank, round(previous_confidence, 6) AS before, rank, round(confidence, 6) AS after, applied_rules, title FROM preview_applied")

# ---------------------------------------------------------------- patterns
oracle("pat_occurrences", f"SELECT fingerprint, log_id AS analysis_id, diagnostic_id, {ts('created_at')} AS seen FROM diags")
_pats = f"SELECT fingerprint, title, canonical_message, tool_kind, category, diagnostic_code, {ts('first_seen_at')} AS first_seen_at, {ts('last_seen_at')} AS last_seen_at, occurrence_count, last_suggested_fix FROM pats"
for name in ("pat_fold", "pat_merge", "str_patterns"):
    oracle(name, _pats)
oracle("pat_get", f"SELECT fingerprint, title, tool_kind, category, canonical_message, occurrence_count, coalesce(last_suggested_fix, '') AS known_fixes, {ts('first_seen_at')} AS first_seen, {ts('last_seen_at')} AS last_seen FROM pats WHERE fingerprint IN (SELECT fingerprint FROM stored_diags WHERE severity = 'Warning')")
oracle("pat_summaries", f"SELECT fingerprint, title, tool_kind, category, occurrence_count, {ts('last_seen_at')} AS last_seen_at, diagnostic_code, last_suggested_fix FROM pats WHERE fingerprint IN (SELECT fingerprint FROM stored_diags WHERE project_name = 'proj1')")
oracle("pat_top", f"SELECT fingerprint, title, tool_kind, occurrence_count, {ts('last_seen_at')} AS last_seen FROM pats ORDER BY occurrence_count DESC, pats.last_seen_at DESC, fingerprint LIMIT 20")
oracle("pat_top_tool", "SELECT tool_kind, position, fingerprint, occurrence_count FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tool_kind ORDER BY occurrence_count DESC, last_seen_at DESC, fingerprint) AS INT) AS position FROM pats) WHERE position <= 3")

# ---------------------------------------------------------------- history
cte("hist", "SELECT *, coalesce(narrative_summary, total_diagnostics || ' diagnostics across ' || group_count || ' groups; ' || primary_issue_count || ' primary issues identified.') AS summary_text FROM stored_narr")
cte("log_fps", "SELECT log_id, unnest(fingerprints) AS fingerprint, project_name, repository, created_at FROM hist", True)
cte(
    "prior",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, analysis_id) AS INT) AS position FROM (
      SELECT a.log_id AS request_id, b.log_id AS analysis_id, any_value(b.created_at) AS created_at, array_to_string(list(b.fingerprint ORDER BY b.fingerprint), ' | ') AS matching
      FROM log_fps a JOIN log_fps b ON a.fingerprint = b.fingerprint AND (a.project_name IS NULL OR a.project_name = b.project_name) AND (a.repository IS NULL OR a.repository = b.repository) AND a.log_id <> b.log_id
      GROUP BY a.log_id, b.log_id)) WHERE position <= 3""",
    True,
)
oracle("his_related", f"SELECT request_id, analysis_id, position, matching, tool_detected, summary_text, {ts('p.created_at')} AS created FROM prior p JOIN hist h ON h.log_id = p.analysis_id")
_seps = "[" + "".join("\\" + c if c in "\\-[]" else c for c in C.TOKEN_SEPARATORS) + "]+"


def tokens_sql(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array({x}, {q(_seps)}), lambda t: lower({trim('t')})), lambda t: length(t) >= 3))"


oracle("sim_tokens", f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, sha256(array_to_string(list_sort(t), ' ')) AS token_sha FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
cte(
    "kno_base",
    _ordered_distinct(
        f"""SELECT h.log_id AS request_id, h.tool_detected AS tool_kind, h.project_name, h.repository, h.created_at, coalesce(h.fingerprints, [])[1:6] AS fingerprints,
      list_distinct_ordered(coalesce(d.codes, [])[1:4]) AS codes, list_distinct_ordered(coalesce(d.messages, [])[1:4]) AS messages, coalesce(d.categories, []) AS categories, r.rule_ids
      FROM hist h LEFT JOIN (SELECT log_id, list(code ORDER BY seg) AS codes, list(normalized_message ORDER BY seg) AS messages,
        list_distinct_ordered(list(category ORDER BY seg)) AS categories FROM stored_diags GROUP BY log_id) d USING (log_id)
      LEFT JOIN (SELECT log_id, list(rule_id ORDER BY priority DESC, name) AS rule_ids FROM (SELECT DISTINCT log_id, rule_id FROM stored_apps) JOIN rules USING (rule_id) GROUP BY log_id) r USING (log_id)"""
    ),
    True,
)
cte(
    "asked",
    f"""SELECT *, coalesce(list_distinct(flatten(list_transform(messages, lambda m: {tokens_sql('m')}))), []) AS query_tokens FROM (
      SELECT * FROM kno_base)""",
    True,
)
cte(
    "pair_scores",
    f"""SELECT *, least((CASE WHEN fph THEN 0.72::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN ch THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN cah THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)
        + (CASE WHEN ov > 0 THEN 0.25::DOUBLE * ov / mx ELSE 0.0::DOUBLE END), 0.96::DOUBLE) AS score,
      CASE WHEN fph THEN 'fingerprint' WHEN ch THEN 'diagnostic-code' ELSE 'message-similarity' END AS match_type FROM (
      SELECT n.request_id, d.log_id AS analysis_id, d.diagnostic_id, d.seg, d.created_at, d.message, d.fingerprint, d.code, d.category,
        list_contains(n.fingerprints, d.fingerprint) AS fph, list_contains(n.codes, d.code) AS ch, list_contains(n.categories, d.category) AS cah,
        len(list_intersect(d.toks, n.query_tokens)) AS ov, greatest(len(d.toks), len(n.query_tokens)) AS mx
      FROM asked n JOIN (SELECT *, {tokens_sql('normalized_message')} AS toks FROM stored_diags) d ON d.parser_tool = n.tool_kind AND (n.project_name IS NULL OR n.project_name = d.project_name) AND (n.repository IS NULL OR n.repository = d.repository))""",
    True,
)
oracle("sim_score", "SELECT request_id, diagnostic_id, round(score, 6) AS score, match_type FROM pair_scores WHERE score >= 0.45")
_prefix = case("match_type", C.SIM_SUMMARY_PREFIX)
cte(
    "similar_rows",
    f"""SELECT b.request_id, b.analysis_id, position, match_type, round_even(score, 2) AS match_score, created_at,
      {_prefix} || ' ' || CASE WHEN length(message) > 180 THEN left(message, 177) || '...' ELSE message END AS summary_text, mf AS matching_fingerprints, mc AS matching_codes FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, created_at DESC, analysis_id) AS INT) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id, analysis_id ORDER BY score DESC, seg) AS rn FROM pair_scores WHERE score >= 0.45 AND analysis_id <> request_id) WHERE rn = 1) b
      JOIN (SELECT request_id, analysis_id, array_to_string(list_sort(list(DISTINCT fingerprint)), ' | ') AS mf, array_to_string(list_sort(list(DISTINCT code)), ' | ') AS mc
        FROM pair_scores WHERE score >= 0.45 GROUP BY ALL) m ON m.request_id = b.request_id AND m.analysis_id = b.analysis_id WHERE position <= 3""",
    True,
)
oracle("sim_search", "SELECT request_id, analysis_id, position, match_type, match_score, summary_text, matching_fingerprints, matching_codes FROM similar_rows")
oracle("nar_get", "SELECT log_id AS analysis_id, tool_detected, narrative_summary, group_summaries, next_steps, 'deterministic' AS narrative_source FROM stored_narr WHERE gate")
cte(
    "doc_narr",
    """SELECT doc_id AS analysis_id, text AS summary, CASE WHEN doc_id % 2 = 0 THEN 'deterministic' ELSE 'ai' END AS source_kind, ['DotNet', 'Npm', 'Vite'][doc_id % 3 + 1] AS tool,
      source AS project_name, lang AS repository, o_orderdate AS created_at, CASE WHEN doc_id % 2 = 1 THEN 'local' END AS provider FROM documents LEFT JOIN orders ON doc_id = o_orderkey""",
)
oracle("nar_history", f"SELECT analysis_id, project_name, repository, {ts('created_at')} AS created FROM doc_narr WHERE tool = 'Npm' AND source_kind = 'ai' ORDER BY created_at DESC, analysis_id LIMIT 50")


def snippet_sql(x: str, needle: str) -> str:
    n = len(needle)
    return rf"""(SELECT CASE WHEN p = 0 THEN CASE WHEN length(f) <= 140 THEN f ELSE left(f, 140) || '...' END ELSE
      CASE WHEN p - 1 > 60 THEN '...' ELSE '' END || substring(f, greatest(p - 60, 1), least(length(f), p - 1 + {n} + 60) - greatest(p - 61, 0)) || CASE WHEN p - 1 + {n} + 60 < length(f) THEN '...' ELSE '' END END
      FROM (SELECT f, instr(lower(f), {q(needle)}) AS p FROM (SELECT trim(regexp_replace({x}, '[ \r\n\t]+', ' ', 'g')) AS f)))"""


def narrative_search_sql(needle: str) -> str:
    return f"""SELECT analysis_id, score, fields, {snippet_sql('hit', needle)} AS match_snippet, {ts('created_at')} AS created FROM (
      SELECT *, CASE WHEN s THEN 40 ELSE 0 END + CASE WHEN p THEN 10 ELSE 0 END + CASE WHEN r THEN 10 ELSE 0 END + CASE WHEN v THEN 5 ELSE 0 END AS score,
        array_to_string(list_filter([CASE WHEN s THEN 'summary' END, CASE WHEN p THEN 'projectName' END, CASE WHEN r THEN 'repository' END, CASE WHEN v THEN 'provider' END], lambda x: x IS NOT NULL), ' | ') AS fields,
        CASE WHEN s THEN summary WHEN p THEN project_name WHEN r THEN repository ELSE provider END AS hit FROM (
        SELECT * FROM (SELECT *, contains(lower(summary), '{needle}') AS s, contains(lower(project_name), '{needle}') AS p, contains(lower(repository), '{needle}') AS r, coalesce(contains(provider, '{needle}'), false) AS v FROM doc_narr)
        WHERE s OR p OR r OR v)) ORDER BY score DESC, created_at DESC, analysis_id LIMIT 50"""


oracle("nar_search", narrative_search_sql("en"))
oracle("nar_search_index", narrative_search_sql("license"))
oracle("nar_snippet", f"SELECT doc_id, {snippet_sql('text', 'the')} AS snippet FROM documents")

# ---------------------------------------------------------------- knowledge
oracle("kno_request", f"SELECT request_id, tool_kind, {lst('codes')} AS codes, {lst('messages')} AS messages, {lst('fingerprints')} AS fingerprints, {lst('categories')} AS categories, {lst('rule_ids')} AS rule_ids FROM kno_base")


def docs_sql(table: list) -> str:
    rows = ", ".join("(" + ", ".join([q(t), q(k), q(i), q(ti), q(s), q(u), q(" | ".join(tags))]) + ")" for t, k, i, ti, s, u, tags in table)
    return f"SELECT * FROM (VALUES {rows}) AS v(tool_kind, key, id, title, summary, url, tags)"


cte("code_docs", docs_sql(C.DOCS_BY_CODE))
cte("category_docs", docs_sql(C.DOCS_BY_CATEGORY))


def doc_refs_sql(base: str) -> tuple[str, str]:
    code = f"""SELECT request_id, ord, id, 'official-doc' AS kind, 'official' AS source, title, summary, url, NULL AS resource_type, NULL AS resource_id, tags FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS rn FROM (SELECT b.request_id, b.tool_kind, unnest(b.codes) AS c, unnest(range(len(b.codes))) AS ord FROM {base} b) x
      JOIN code_docs k ON k.tool_kind = x.tool_kind AND k.key = upper(x.c)) WHERE rn <= 4"""
    cat = f"""SELECT request_id, ord, id, 'official-doc' AS kind, 'official' AS source, title, summary, url, NULL AS resource_type, NULL AS resource_id, tags FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS rn FROM (SELECT b.request_id, b.tool_kind, unnest(b.categories) AS c, unnest(range(len(b.categories))) AS ord FROM {base} b
        WHERE b.request_id NOT IN (SELECT request_id FROM ({code}))) x JOIN category_docs k ON k.tool_kind = x.tool_kind AND k.key = x.c) WHERE rn <= 4"""
    return code, cat


def rule_refs_sql(base: str) -> str:
    return f"""SELECT request_id, ord, 'internal:rule:' || r.rule_id AS id, 'rule' AS kind, 'internal' AS source, r.name AS title, {q(C.KNOWLEDGE_RULE_DEFAULT)} AS summary, NULL AS url, 'rule' AS resource_type,
      CAST(r.rule_id AS VARCHAR) AS resource_id, '' AS tags FROM (SELECT b.request_id, unnest(b.rule_ids[1:3]) AS rule_id, unnest(range(len(b.rule_ids[1:3]))) AS ord FROM {base} b) x JOIN rules r USING (rule_id)"""


def pattern_refs_sql(base: str) -> str:
    return f"""SELECT request_id, rn - 1 AS ord, 'internal:pattern:' || fingerprint AS id, 'recurring-pattern' AS kind, 'internal' AS source, title,
      CASE WHEN occurrence_count <= 1 THEN {q(C.KNOWLEDGE_PATTERN_ONCE)} ELSE 'Observed ' || occurrence_count || ' times. Most recent persisted occurrence was ' || strftime(last_seen_at, '%Y-%m-%d %H:%M') || ' UTC.' END
        || coalesce(' Last recorded fix hint: ' || last_suggested_fix || '.', '') AS summary, NULL AS url, 'error-pattern' AS resource_type, fingerprint AS resource_id,
      array_to_string(list_filter([lower(tool_kind), diagnostic_code, CASE WHEN category <> 'Unknown' THEN lower(category) END], lambda x: x IS NOT NULL), ' | ') AS tags FROM (
      SELECT x.request_id, p.*, row_number() OVER (PARTITION BY request_id ORDER BY occurrence_count DESC, last_seen_at DESC, p.fingerprint) AS rn
      FROM (SELECT b.request_id, unnest(b.fingerprints) AS fingerprint FROM {base} b) x JOIN pats p USING (fingerprint)) WHERE rn <= 4"""


# The look-up takes the first six fingerprints of a request, related analyses may share any of theirs.
cte(
    "kno_prior_pairs",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, analysis_id) AS position FROM (
      SELECT a.request_id, b.log_id AS analysis_id, any_value(b.created_at) AS created_at, array_to_string(list(b.fingerprint ORDER BY b.fingerprint), ' | ') AS matching
      FROM (SELECT request_id, unnest(fingerprints) AS fingerprint, project_name, repository FROM kno_base) a
      JOIN log_fps b ON a.fingerprint = b.fingerprint AND (a.project_name IS NULL OR a.project_name = b.project_name) AND (a.repository IS NULL OR a.repository = b.repository) AND a.request_id <> b.log_id
      GROUP BY a.request_id, b.log_id)) WHERE position <= 3""",
    True,
)
_prior = """SELECT request_id, position - 1 AS ord, 'internal:analysis:' || analysis_id AS id, 'prior-analysis' AS kind, 'internal' AS source, 'Related persisted analysis' AS title,
      'Persisted analysis from ' || strftime(p.created_at, '%Y-%m-%d %H:%M') || ' UTC for ' || h.project_name || ' / ' || h.repository || '. ' || h.summary_text AS summary, NULL AS url, 'analysis' AS resource_type,
      CAST(analysis_id AS VARCHAR) AS resource_id, matching AS tags FROM kno_prior_pairs p JOIN hist h ON h.log_id = p.analysis_id"""
_ref_cols = "request_id, id, kind, source, title, summary, url, resource_type, resource_id, tags"
_code, _cat = doc_refs_sql("kno_base")
oracle("kno_docs_code", f"SELECT {_ref_cols} FROM ({_code})")
oracle("kno_docs_category", f"SELECT {_ref_cols} FROM ({_cat})")
oracle("kno_rules", f"SELECT {_ref_cols} FROM ({rule_refs_sql('kno_base')})")
oracle("kno_patterns", f"SELECT {_ref_cols} FROM ({pattern_refs_sql('kno_base')})")
oracle("kno_prior", f"SELECT {_ref_cols} FROM ({_prior})")
_ncode, _ncat = doc_refs_sql("asked")
cte("new_rules", rule_refs_sql("asked"))
cte("new_patterns", pattern_refs_sql("asked"))
cte("new_prior", f"SELECT * FROM ({_prior}) WHERE request_id IN (SELECT request_id FROM asked)")
cte(
    "new_similar",
    """SELECT s.request_id, s.position - 1 AS ord, 'internal:analysis:similar:' || s.analysis_id AS id, 'prior-analysis' AS kind, 'internal' AS source, 'Similar persisted analysis' AS title,
      'Similar persisted analysis from ' || strftime(s.created_at, '%Y-%m-%d %H:%M') || ' UTC for ' || h.project_name || ' / ' || h.repository || '. ' || s.summary_text AS summary, NULL AS url, 'analysis' AS resource_type,
      CAST(s.analysis_id AS VARCHAR) AS resource_id, 'history | ' || lower(n.tool_kind) || ' | match:' || s.match_type || coalesce(' | ' || nullif(s.matching_codes, ''), '') AS tags
      FROM similar_rows s JOIN hist h ON h.log_id = s.analysis_id JOIN asked n ON n.request_id = s.request_id
      WHERE (SELECT count(*) FROM (SELECT request_id FROM new_rules UNION ALL SELECT request_id FROM new_patterns UNION ALL SELECT request_id FROM new_prior) c WHERE c.request_id = s.request_id) < 8""",
)
oracle("kno_similar", f"SELECT {_ref_cols} FROM new_similar")
oracle(
    "kno_merge",
    f"""SELECT request_id, position, id, kind, title, summary FROM (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE kind WHEN 'official-doc' THEN 0 WHEN 'rule' THEN 1 WHEN 'recurring-pattern' THEN 2 ELSE 3 END, lower(title), src, ord) AS INT) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id, lower(id) ORDER BY src, ord) AS rn FROM (
        SELECT 0 AS src, * FROM ({_ncode}) UNION ALL SELECT 1, * FROM ({_ncat}) UNION ALL SELECT 2, * FROM new_rules UNION ALL SELECT 3, * FROM new_patterns UNION ALL SELECT 4, * FROM new_prior UNION ALL SELECT 5, * FROM new_similar)) WHERE rn = 1)
      WHERE position <= 12""",
)

# ---------------------------------------------------------------- privacy
cte(
    "texts",
    "SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, url || ' ' || html FROM pages",
)


def _redact_log(x: str) -> str:
    x = trim(x)
    for regex, replacement in [C.LOG_SECRET] + [r[1:] for r in C.LOG_REDACTIONS]:
        if "(?<!" in regex:
            step = rf"regexp_replace({{}}, '(^|[^\pL\pN_])/(?:[^/\s\"'']+/)+[^/\s\"'']+', '\1<redacted:path>', 'g')"
            x = step.format(x)
        else:
            x = sub(x, regex, replacement.replace("$1", r"\1"))
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


oracle("prv_redact_log", f"SELECT kind, id, CASE WHEN length(r) > 240 THEN left(r, 240) || '…' ELSE r END AS redacted FROM (SELECT kind, id, {_redact_log('text')} AS r FROM texts)")
oracle("prv_redact_raw", f"SELECT kind, id, CAST(length(r) AS INT) AS n_chars, sha256(r) AS sha, r <> text AS was_redacted FROM (SELECT *, {_redact_raw('text')} AS r FROM texts)")
oracle("prv_store_policy", "SELECT log_id, sha256(raw_content) AS raw_sha, coalesce(raw_content <> content, false) AS raw_content_redacted FROM raw_logs")
cte("hist_raw", "SELECT s.log_id AS analysis_id, s.project_name, s.created_at, r.raw_content, coalesce(r.raw_content <> r.content, false) AS redacted FROM stored_narr s JOIN raw_logs r USING (log_id)")
oracle("prv_purge_raw", "SELECT analysis_id, raw_content IS NOT NULL AND project_name <> 'proj5' AS has_raw, redacted AND project_name <> 'proj5' AS raw_content_redacted FROM hist_raw")
oracle(
    "prv_delete",
    """SELECT 'patterns' AS "table", CAST(sum(occurrence_count) AS BIGINT) AS n FROM pats UNION ALL SELECT 'analyses', count(*) FROM hist WHERE project_name <> 'proj3'
      UNION ALL SELECT 'diagnostics', count(*) FROM stored_diags WHERE project_name <> 'proj3' UNION ALL SELECT 'occurrences', count(*) FROM stored_diags WHERE project_name <> 'proj3'
      UNION ALL SELECT 'groups', count(*) FROM grps g JOIN par p USING (log_id) WHERE p.persist AND p.project_name <> 'proj3'""",
)
oracle("prv_retention", f"SELECT count(*) FILTER (raw_content IS NOT NULL AND created_at < {AS_OF} - INTERVAL 365 DAY) AS raw_content_purged, count(*) FILTER (created_at < {AS_OF} - INTERVAL 1000 DAY) AS analyses_deleted FROM hist_raw")
oracle("prv_retention_apply", f"SELECT analysis_id, raw_content IS NOT NULL AND created_at >= {AS_OF} - INTERVAL 365 DAY AS has_raw, redacted AND created_at >= {AS_OF} - INTERVAL 365 DAY AS raw_content_redacted FROM hist_raw WHERE created_at >= {AS_OF} - INTERVAL 1000 DAY")
oracle("prv_expiry", f"SELECT log_id, {ts('created_at + INTERVAL 7 DAY')} AS raw_expires, {ts('created_at + INTERVAL 90 DAY')} AS analysis_expires, CAST(NULL AS VARCHAR) AS never FROM logs")

# ---------------------------------------------------------------- telemetry
cte(
    "evts",
    """SELECT s.log_id, input_type, tool_detected, parser_name AS parser, parser_name IS NOT NULL AND total_diagnostics > 0 AS parse_succeeded,
      tool_detected = 'Unknown' OR total_diagnostics = 0 OR primary_issue_count = 0 AS is_unmatched, total_diagnostics AS diagnostics_count, group_count, primary_issue_count AS candidate_count,
      coalesce(f.fps, '') AS fingerprints, s.log_id % 4 = 0 AS ai_requested, s.log_id % 8 = 0 AS ai_completed, s.log_id % 5 <> 0 AS pr, s.log_id % 5 <> 0 AND s.log_id % 7 <> 0 AS ps, greatest(1, s.log_id % 97) AS dur
      FROM sums s LEFT JOIN (SELECT log_id, string_agg(fingerprint, ',' ORDER BY fingerprint) AS fps FROM diags GROUP BY log_id) f USING (log_id)""",
    True,
)
oracle("tel_event", "SELECT log_id, input_type, tool_detected, parser, parse_succeeded, is_unmatched, diagnostics_count, group_count, candidate_count, fingerprints FROM evts")
oracle(
    "tel_analysis",
    """SELECT count(*) AS total_requests, count(*) AS completed, CAST(0 AS BIGINT) AS failed, count(*) FILTER (NOT parse_succeeded) AS parse_failures, count(*) FILTER (ai_requested) AS ai_requested, count(*) FILTER (ai_completed) AS ai_completed,
      count(*) FILTER (pr AND NOT ps) AS persistence_failures, count(*) FILTER (is_unmatched) AS unmatched, round(sum(dur)::DOUBLE / count(*), 6) AS average_duration_ms, round(sum(diagnostics_count)::DOUBLE / count(*), 6) AS average_diagnostics,
      round((count(*) FILTER (ai_requested))::DOUBLE / count(*), 6) AS ai_request_rate, round((count(*) FILTER (is_unmatched))::DOUBLE / count(*), 6) AS unmatched_rate FROM evts""",
)
oracle(
    "tel_top",
    """SELECT 'tool' AS section, tool_detected AS name, count(*) AS count FROM evts GROUP BY 2 UNION ALL SELECT 'parser', parser, count(*) FROM evts WHERE parser IS NOT NULL GROUP BY 2
      UNION ALL SELECT * FROM (SELECT 'fingerprint', fingerprint, count(*) FROM diags GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 15)""",
)
oracle(
    "tel_metric_tags",
    """SELECT tool_detected_tag, input_type_tag, parser_tag, CAST(grouping(tool_detected_tag, input_type_tag, parser_tag) AS INT) AS level, count(*) AS requests, count(*) AS succeeded, count(*) FILTER (parse_succeeded) AS parsed,
      CAST(sum(dur) AS BIGINT) AS duration_ms, CAST(sum(diagnostics_count) AS BIGINT) AS diagnostics
      FROM (SELECT *, tool_detected AS tool_detected_tag, input_type AS input_type_tag, coalesce(parser, 'none') AS parser_tag FROM evts) GROUP BY ROLLUP (tool_detected_tag, input_type_tag, parser_tag)""",
)
cte("acc", "SELECT event_type AS route, CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method, 200 + CAST(json_extract_string(props, '$.k') AS INT) % 10 AS status, greatest(1, value) AS dur FROM events")
oracle(
    "tel_http",
    """SELECT 'method' AS section, coalesce(method, 'unknown') AS name, count(*) AS count, round(avg(dur), 4) AS average_duration_ms FROM acc GROUP BY 2
      UNION ALL SELECT 'route', route, count(*), round(avg(dur), 4) FROM acc GROUP BY 2 UNION ALL SELECT 'status', coalesce(CAST(status AS VARCHAR), 'unknown'), count(*), round(avg(dur), 4) FROM acc GROUP BY 2""",
)
oracle(
    "tel_http_summary",
    """SELECT section, name, count, average_duration_ms, CAST(position AS INT) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY section ORDER BY count DESC, lower(name), name) AS position FROM (
        SELECT 'method' AS section, coalesce(method, 'unknown') AS name, count(*) AS count, round(avg(dur), 4) AS average_duration_ms FROM acc GROUP BY 2
        UNION ALL SELECT 'route', route, count(*), round(avg(dur), 4) FROM acc GROUP BY 2 UNION ALL SELECT 'status', coalesce(CAST(status AS VARCHAR), 'unknown'), count(*), round(avg(dur), 4) FROM acc GROUP BY 2
        UNION ALL SELECT 'all', 'requests', count(*), round(avg(dur), 4) FROM acc)) WHERE section <> 'route' OR position <= 5""",
)
ORACLES["str_candidates"] = ORACLES["rul_apply"]
oracle("str_telemetry", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS count, round(sum(value), 4) AS total FROM events GROUP BY ALL")
oracle(
    "str_windows",
    """WITH placed AS (SELECT *, date_trunc('day', ts) AS w, least(3, greatest(0, floor(date_diff('day', DATE '2024-01-01', CAST(CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 8 DAY ELSE ts END AS DATE)) / 10))) AS part FROM events),
      marks AS (SELECT k, (SELECT max(ts) FROM placed WHERE part < k) - INTERVAL 2 DAY AS mark FROM range(5) AS r(k)),
      flagged AS (SELECT placed.*, coalesce(w + INTERVAL 1 DAY <= mark, false) AS is_late FROM placed JOIN marks ON k = part)
      SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, coalesce(w + INTERVAL 1 DAY <= (SELECT mark FROM marks WHERE k = 4), false) AS closed,
        count(*) FILTER (NOT is_late) AS on_time, round(coalesce(sum(value) FILTER (NOT is_late), 0), 4) AS on_time_total,
        count(*) FILTER (is_late) AS late, round(coalesce(sum(value) FILTER (is_late), 0), 4) AS late_total FROM flagged GROUP BY w, event_type""",
)
oracle("str_extract", "SELECT log_id, diagnostic_id, code, category, fingerprint FROM diags")

# ---------------------------------------------------------------- enrichment: expected values straight from the text
_joined = r"array_to_string(list_filter(list_transform(string_split(replace({}, chr(13), ''), chr(10)), lambda x: " + trim("x") + r"), lambda x: x <> ''), ' ')"
cte(
    "answers",
    f"""SELECT conv_id AS log_id, k, CASE WHEN k = 3 THEN '' ELSE {_joined.format('text')} END AS text, k IN (1, 2) AS lists, {trim("text")} AS head, k <> 3 AS readable FROM (
      SELECT conv_id * 16 + turn AS conv_id, conv_id % 4 AS k, text FROM conversations WHERE role = 'assistant')""",
)
_items = "CASE WHEN lists THEN CASE WHEN head = '' THEN ['Check the log.'] ELSE [head, 'Check the log.'] END ELSE [] END"
oracle("enr_parse", f"SELECT log_id, text, {lst(_items)} AS causes, '' AS fixes, readable FROM answers")
oracle(
    "enr_candidate",
    f"""SELECT c.log_id, c.rank, c.fingerprint, CASE WHEN ok THEN a.text ELSE c.explanation END AS explanation, CASE WHEN ok AND lists THEN {lst(_items)} ELSE {lst('c.likely_causes')} END AS causes, {lst('c.suggested_fixes')} AS fixes,
      CASE WHEN a.log_id IS NULL THEN 'none' WHEN ok THEN 'completed' ELSE 'failed' END AS enrich_status FROM cands c LEFT JOIN (SELECT *, readable AND text <> '' AS ok FROM answers) a ON a.log_id = c.log_id AND c.rank = 1""",
)
oracle(
    "enr_narrative",
    f"""SELECT n.log_id, CASE WHEN ok THEN 'ai' ELSE 'deterministic' END AS narrative_source, CASE WHEN ok THEN 'local' END AS narrative_provider, CASE WHEN ok THEN a.text ELSE n.narrative_summary END AS narrative_summary,
      CASE WHEN ok AND lists THEN {lst(_items)} ELSE n.group_summaries END AS group_summaries, CASE WHEN ok AND lists THEN {lst(_items)} ELSE n.next_steps END AS next_steps
      FROM narr n LEFT JOIN (SELECT *, readable AND text <> '' AS ok FROM answers) a USING (log_id) WHERE gate""",
)
_skip_n, _skip_e = q(C.NARRATIVE_SKIPPED), q(C.ENRICH_SKIPPED)
oracle(
    "enr_tasks",
    f"""SELECT log_id, array_to_string(list_filter([e, n], lambda x: x IS NOT NULL), ' | ') AS tasks, coalesce(e LIKE '%:completed', false) OR coalesce(n LIKE '%:Completed', false) AS used_ai,
      CASE WHEN (e IS NULL) <> (n IS NULL) THEN CASE WHEN e IS NULL THEN 'root-cause-narrative' ELSE 'explanation-enrichment' END END AS single_task FROM (
      SELECT log_id, CASE WHEN log_id % 2 = 0 THEN 'explanation-enrichment:' || CASE WHEN repository = 'repoP' THEN 'unavailable:AI explanation enrichment service is not configured.' WHEN group_count = 0 THEN 'skipped:' || {_skip_e}
          WHEN log_id % 5 > 0 THEN 'completed' ELSE 'failed' END END AS e,
        CASE WHEN log_id % 3 = 0 THEN 'root-cause-narrative:' || CASE WHEN NOT gate THEN 'skipped:' || {_skip_n} WHEN repository = 'repoF' THEN 'unavailable:AI root-cause narrative service is not configured.'
          WHEN log_id % 5 > 1 THEN 'Completed' ELSE 'failed' END END AS n FROM narr)""",
)


def oracle_sql() -> dict[str, str]:
    return {name: build(sql) for name, sql in ORACLES.items()}
