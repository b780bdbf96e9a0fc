"""Shared common table expressions of the checking SQL."""

from __future__ import annotations

import re

from faultlines import constants as C
from faultlines.sources.fixtures import CHUNKS_SQL, RULES_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(value: str, table: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {value} {whens} ELSE {default} END"


def any_of(fmt: str, items: list[str]) -> str:
    return "(" + " OR ".join(fmt.format(q(i.lower())) for i in items) + ")"


def has(column: str, items: list[str]) -> str:
    return any_of("contains(lower(" + column + "), {})", items)


def starts(column: str, items: list[str]) -> str:
    return any_of("starts_with(lower(" + column + "), {})", items)


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"regexp_replace({trim(x)}, '\s+', ' ', 'g')"


def slashes(x: str) -> str:
    return rf"replace({trim(x)}, '\', '/')"


def rx(column: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({column}, {q(f'(?{flags})' + pattern if flags else pattern)})"


def ex(column: str, pattern: str, group: int, flags: str = "") -> str:
    return f"regexp_extract({column}, {q(f'(?{flags})' + pattern if flags else pattern)}, {group})"


def sub(column: str, pattern: str, replacement: str, flags: str = "") -> str:
    return f"regexp_replace({column}, {q(f'(?{flags})' + pattern if flags else pattern)}, {q(replacement)}, 'g')"


def str_list(items: list[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


CTES: dict[str, str] = {}


def cte(name: str, sql: str, materialized: bool = False) -> None:
    CTES[name] = ("MATERIALIZED " if materialized else "") + f"({sql})"


def build(sql: str) -> str:
    """Prefixes the common table expressions the statement needs, in order of definition."""
    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS {body}" for name, body in CTES.items() if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


# ---------------------------------------------------------------- input
cte("chunks", CHUNKS_SQL.replace("{lineitem}", "lineitem"))
cte("plain_logs", "SELECT log_id, string_agg(chunk, chr(10) ORDER BY n) AS content FROM chunks GROUP BY log_id")
cte(
    "all_logs",
    """SELECT l.log_id, l.content, o.o_orderdate AS created_at, 'proj' || CAST(o.o_custkey % 7 AS VARCHAR) AS project_name,
       'repo' || o.o_orderstatus AS repository, CASE WHEN l.log_id % 11 = 0 THEN 'SingleDiagnostic' ELSE 'BuildLog' END AS input_type,
       CASE WHEN l.log_id % 13 = 0 THEN 'tsc' END AS tool_hint, l.log_id % 5 <> 0 AS persist,
       l.log_id % 5 <> 0 AND l.log_id % 3 = 0 AS store_raw
       FROM plain_logs l LEFT JOIN orders o ON o.o_orderkey = l.log_id""",
)
cte("logs", f"SELECT * FROM all_logs WHERE length(content) <= {C.MAX_CONTENT_CHARS}", True)
cte(
    "requests",
    r"""SELECT log_id, CASE WHEN log_id % 19 = 4 THEN ' ' || chr(10) || ' ' ELSE content END AS content, input_type,
       CASE log_id % 17 WHEN 3 THEN 'cobol' WHEN 5 THEN ' .NET ' WHEN 6 THEN 'generic' ELSE tool_hint END AS tool_hint,
       project_name, repository, created_at, persist, log_id % 3 = 0 AS store_raw FROM all_logs""",
    True,
)
_alias = case("lower(" + trim("tool_hint") + ")", C.TOOL_ALIASES)


def detection_sql(source: str) -> str:
    found = f"""CASE WHEN {_alias} IS NOT NULL THEN 'hint'
      WHEN {has('content', C.DETECT_VITE_MARKERS)} THEN 'Vite'
      WHEN {rx('content', C.DETECT_DOTNET_CODE, 'i')} OR {has('content', [C.DETECT_DOTNET_MARKER])} OR {rx('content', C.DETECT_DOTNET_PROJECT_END, 'im')} THEN 'DotNet'
      WHEN {rx('content', C.DETECT_TYPESCRIPT_CODE, 'i')} THEN 'TypeScript'
      WHEN {has('content', C.DETECT_NPM_MARKERS)} THEN 'Npm'
      WHEN {has('content', [C.DETECT_PYTHON_MARKER])} THEN 'Python' ELSE 'Unknown' END"""
    return f"""SELECT *, coalesce(hint, found) AS tool_detected,
      {case('found', {k: v[0] for k, v in C.DETECTION.items()})}::DOUBLE AS detection_confidence,
      {case('found', {k: v[1] for k, v in C.DETECTION.items()})} AS detection_reason, hint IS NOT NULL AS was_explicit_hint
      FROM (SELECT *, {_alias} AS hint, {found} AS found FROM {source})"""


_PY_TYPE = r"[A-Za-z_][A-Za-z0-9_.]*"


def is_exception(line: str) -> str:
    kind = f"regexp_extract({line}, '^({_PY_TYPE})', 1)"
    ends = " OR ".join(f"ends_with({kind}, {q(s)})" for s in C.PYTHON_EXCEPTION_SUFFIXES)
    others = ", ".join(q(x) for x in C.PYTHON_OTHER_EXCEPTIONS)
    return (
        f"({line} <> '' AND NOT starts_with(lower({line}), 'traceback') AND regexp_matches({line}, '^{_PY_TYPE}(:.*)?$')"
        f" AND ({ends} OR {kind} IN ({others})))"
    )


def parser_sql(source: str) -> str:
    last = trim(r"string_split(regexp_replace(content, '\s+$', ''), chr(10))[-1]")
    return f"""SELECT *, {case('parser_tool', C.PARSER_NAMES)} AS parser_name,
      CASE WHEN parser_tool IS NOT NULL THEN NULL WHEN tool_detected = 'Unknown' THEN {q(C.NO_PARSER_UNKNOWN)}
        ELSE replace({q(C.NO_PARSER_TOOL)}, '%s', tool_detected) END AS failure_reason FROM (
      SELECT *, CASE WHEN tool_detected IN ({", ".join(q(x) for x in C.PARSER_NAMES)}) THEN tool_detected
        WHEN {has('content', C.ACCEPT_DOTNET_MARKERS)} OR {rx('content', C.ACCEPT_DOTNET_CODE, 'i')} THEN 'DotNet'
        WHEN {has('content', C.ACCEPT_TYPESCRIPT_MARKERS)} OR {rx('content', C.ACCEPT_TYPESCRIPT_CODE, 'i')} OR {rx('content', C.TYPESCRIPT_HEADER, 'i-s')} THEN 'TypeScript'
        WHEN {has('content', C.DETECT_VITE_MARKERS)} THEN 'Vite'
        WHEN {has('content', C.DETECT_NPM_MARKERS)} THEN 'Npm'
        WHEN {has('content', [C.DETECT_PYTHON_MARKER])} OR {is_exception(last)} THEN 'Python' END AS parser_tool FROM {source})"""


cte("det", detection_sql("logs"), True)
cte("par", parser_sql("det"), True)

# ---------------------------------------------------------------- lines and segments
cte(
    "lines",
    r"""SELECT log_id, parser_tool, n, regexp_replace(line, '\s+$', '') AS line FROM (
      SELECT log_id, parser_tool, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM (
        SELECT log_id, parser_tool, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) AS parts FROM par))""",
    True,
)
_DOTNET_START = (
    r"(?:(?:^|\s)(?:error|warning|info|fatal)\s+(?:CS|MSB|NU|NETSDK)\d+\s*:)"
    r"|(?:\([^\)]*\):\s*(?:error|warning|info|fatal)\s+(?:CS|MSB|NU|NETSDK)\d+\s*:)"
)
_dn_start = f"({rx('line', _DOTNET_START, 'i')} OR {rx('line', C.DOTNET_LOCATED, 'i-s')} OR {rx('line', C.DOTNET_PLAIN, 'i-s')})"
_dn_noise = f"({starts('line', C.DOTNET_NOISE_PREFIXES)} OR " + rx("line", r"^\d+\s+(Warning|Error)\(s\)", "i") + ")"
_dn_cont = "(" + rx("line", r"^\s") + f" OR {starts('line', C.DOTNET_CONTINUATIONS)})"
cte(
    "dotnet_segs",
    f"""SELECT log_id, g, string_agg(CASE WHEN k = 's' THEN line ELSE {trim('line')} END, chr(10) ORDER BY n) AS segment FROM (
      SELECT *, sum(CASE WHEN k <> 'c' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY n) AS g FROM (
        SELECT log_id, n, line, CASE WHEN line = '' THEN 'b' WHEN {_dn_start} THEN 's' WHEN {_dn_noise} THEN 'x' WHEN {_dn_cont} THEN 'c' ELSE 'x' END AS k
        FROM lines WHERE parser_tool = 'DotNet'))
      GROUP BY log_id, g HAVING arg_min(k, n) = 's'""",
)
_ts_start = rx("line", C.TYPESCRIPT_HEADER, "i-s")
_ts_noise = starts("line", C.TYPESCRIPT_NOISE_PREFIXES)
_ts_cont = "(" + rx("line", r"^(\s|\d|~)") + f" OR {starts('line', [C.TYPESCRIPT_CONTINUATION])})"
cte(
    "tsc_segs",
    f"""SELECT log_id, g, string_agg(line, chr(10) ORDER BY n) AS segment FROM (
      SELECT *, sum(CASE WHEN k <> 'c' THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY n) AS g FROM (
        SELECT log_id, n, line, CASE WHEN line = '' THEN 'c' WHEN {_ts_start} THEN 's' WHEN {_ts_noise} THEN 'x' WHEN {_ts_cont} THEN 'c' ELSE 'x' END AS k
        FROM lines WHERE parser_tool = 'TypeScript'))
      GROUP BY log_id, g HAVING arg_min(k, n) = 's'""",
)
cte(
    "python_segs",
    f"""SELECT log_id, g, {trim('string_agg(line, chr(10) ORDER BY n)')} AS segment FROM (
      SELECT log_id, n, line, sum(CASE WHEN starts_with(lower(line), {q(C.DETECT_PYTHON_MARKER.lower())}) THEN 1 ELSE 0 END)
        OVER (PARTITION BY log_id ORDER BY n) AS g FROM lines WHERE parser_tool = 'Python')
      WHERE g > 0 GROUP BY log_id, g""",
)
_py_lines = "list_transform(string_split(content, chr(10)), lambda x: " + trim("x") + ")"
cte(
    "other_segs",
    f"""SELECT log_id, 0 AS g, {trim('content')} AS segment FROM par WHERE parser_tool IN ('Npm', 'Vite')
      OR (parser_tool = 'Python' AND log_id NOT IN (SELECT log_id FROM python_segs)
          AND len(list_filter({_py_lines}, lambda x: {is_exception('x')})) > 0)""",
)
cte(
    "segs",
    """SELECT s.log_id, p.parser_tool, p.tool_detected, p.parser_name, p.input_type, p.project_name, p.repository, p.created_at,
      CAST(row_number() OVER (PARTITION BY s.log_id ORDER BY g) - 1 AS INT) AS seg, segment FROM (
        SELECT * FROM dotnet_segs UNION ALL SELECT * FROM tsc_segs UNION ALL SELECT * FROM python_segs
        UNION ALL SELECT * FROM other_segs) s JOIN par p USING (log_id)""",
    True,
)

# ---------------------------------------------------------------- extraction, one statement per format
_COLS = "log_id, seg, code, message, tmpl, severity, source, file_path, line, col, end_line, end_col, meta"


def nz(x: str) -> str:
    return f"nullif({x}, '')"


def num(x: str) -> str:
    return f"TRY_CAST(nullif({x}, '') AS INT)"


def _sev(x: str) -> str:
    return case(f"lower({x})", {v: k for k, v in C.SEVERITY_TEXT.items() if k != "Unknown"}, "'Unknown'")


def _src(code: str, explicit: str) -> str:
    whens = " ".join(f"WHEN starts_with(upper({code}), {q(p)}) THEN {q(s)}" for p, s in C.DOTNET_SOURCES)
    project = " OR ".join(f"ends_with(lower({explicit}), {q(s)})" for s in C.DOTNET_PROJECT_SUFFIXES)
    return (
        f"CASE WHEN {explicit} IS NOT NULL AND NOT ({project}) THEN {explicit} {whens} ELSE {q(C.DOTNET_SOURCE_DEFAULT)} END"
    )


def _loc(i: int) -> str:
    return ex("segment", C.DOTNET_LOCATED, i, "i-s")


def _plain(i: int) -> str:
    return ex("segment", C.DOTNET_PLAIN, i, "i-s")


cte(
    "dotnet_located",
    f"""SELECT log_id, seg, {trim(_loc(7))} AS code, {collapse(_loc(8))} AS message, {collapse(_loc(8))} AS tmpl, {_sev(_loc(6))} AS severity,
      {_src(_loc(7), 'CAST(NULL AS VARCHAR)')} AS source, {nz(slashes(_loc(1)))} AS file_path, {num(_loc(2))} AS line, {num(_loc(3))} AS col,
      {num(_loc(4))} AS end_line, {num(_loc(5))} AS end_col, coalesce('project=' || {slashes(nz(_loc(9)))}, '') AS meta
      FROM segs WHERE parser_tool = 'DotNet' AND {rx('segment', C.DOTNET_LOCATED, 'i-s')}""",
)
_explicit = nz(trim(_plain(1)))
_is_project = " OR ".join(f"ends_with(lower({_explicit}), {q(s)})" for s in C.DOTNET_PROJECT_SUFFIXES)
cte(
    "dotnet_plain",
    f"""SELECT log_id, seg, {trim(_plain(3))} AS code, {collapse(_plain(4))} AS message, {collapse(_plain(4))} AS tmpl, {_sev(_plain(2))} AS severity,
      {_src(_plain(3), _explicit)} AS source, CASE WHEN {_is_project} THEN {slashes(_explicit)} END AS file_path, NULL::INT AS line, NULL::INT AS col,
      NULL::INT AS end_line, NULL::INT AS end_col, coalesce('project=' || {slashes(nz(_plain(5)))}, '') AS meta
      FROM segs WHERE parser_tool = 'DotNet' AND NOT {rx('segment', C.DOTNET_LOCATED, 'i-s')} AND {rx('segment', C.DOTNET_PLAIN, 'i-s')}""",
)


def _ts(i: int) -> str:
    return ex("header", C.TYPESCRIPT_HEADER, i, "i-s")


cte(
    "tsc_rows",
    f"""SELECT log_id, seg, upper({trim(_ts(5))}) AS code, {collapse(_ts(6))} AS message, {collapse(_ts(6))} AS tmpl, {_sev(_ts(4))} AS severity,
      'tsc' AS source, {nz(slashes(_ts(1)))} AS file_path, {num(_ts(2))} AS line, {num(_ts(3))} AS col, NULL::INT AS end_line, NULL::INT AS end_col, '' AS meta
      FROM (SELECT *, string_split(segment, chr(10))[1] AS header FROM segs WHERE parser_tool = 'TypeScript') WHERE {rx('header', C.TYPESCRIPT_HEADER, 'i-s')}""",
)
_FRAME = r'^\s*File "(.+?)", line (\d+)(?:, in (.+))?\s*$'
cte(
    "python_scan",
    f"""SELECT log_id, seg, ls, list_filter(range(1, len(ls) + 1), lambda i: {is_exception(trim('ls[i]'))})[-1] AS ei,
      list_filter(ls, lambda x: {rx('x', _FRAME, '-s')}) AS frames FROM (
        SELECT log_id, seg, string_split(segment, chr(10)) AS ls FROM segs WHERE parser_tool = 'Python')""",
)
cte(
    "python_rows",
    f"""SELECT log_id, seg, kind AS code, coalesce({nz(collapse('msg'))}, kind) AS message, {nz(collapse('msg'))} AS tmpl, 'Error' AS severity, 'python' AS source,
      {nz(slashes(ex('frame', _FRAME, 1, '-s')))} AS file_path, {num(ex('frame', _FRAME, 2, '-s'))} AS line,
      CASE WHEN kind IN ({", ".join(q(x) for x in C.PYTHON_CARET_EXCEPTIONS)}) THEN
        CAST(list_filter(list_transform([ei - 1, ei - 2, ei - 3, ei - 4], lambda j: CASE WHEN j >= 1 THEN instr(ls[j], '^') ELSE 0 END), lambda p: p > 0)[1] AS INT) END AS col,
      NULL::INT AS end_line, NULL::INT AS end_col,
      'frameCount=' || len(frames) || coalesce(';function=' || {nz(collapse(ex('frame', _FRAME, 3, '-s')))}, '') AS meta
      FROM (SELECT *, regexp_extract(et, '^({_PY_TYPE})', 1) AS kind, regexp_extract(et, '^{_PY_TYPE}:(.*)$', 1) AS msg, frames[-1] AS frame FROM (
        SELECT *, {trim('ls[ei]')} AS et FROM python_scan WHERE ei IS NOT NULL))""",
)
_PREFIX = r"^npm\s+(?:ERR!|error)\s+"
_stripped = "list_transform(list_filter(list_transform(string_split(segment, chr(10)), lambda x: " + trim("x") + "), lambda x: " + rx("x", _PREFIX, "i") + "), lambda x: " + trim(sub("x", _PREFIX, "", "i")) + ")"
_npm_skip = starts("x", C.NPM_SKIPPED_PREFIXES)
cte(
    "npm_scan",
    f"""SELECT *, {nz(ex('segment', C.NPM_MISSING_SCRIPT, 1, 'im'))} AS script,
      coalesce(upper({nz(ex('segment', C.NPM_CODE, 1, 'im'))}),
        list_filter(list_transform(st, lambda x: CASE WHEN starts_with(lower(x), 'eresolve ') THEN 'ERESOLVE' WHEN starts_with(lower(x), 'enoent') THEN 'ENOENT' END), lambda x: x IS NOT NULL)[1]) AS found,
      list_filter(st, lambda x: x <> '' AND NOT {_npm_skip})[1] AS first_text,
      coalesce({nz(ex('segment', C.NPM_PATH, 1, 'im-s'))}, {nz(ex('segment', C.NPM_PACKAGE_JSON, 1, 'i-s'))}) AS path
      FROM (SELECT log_id, seg, segment, {_stripped} AS st FROM segs WHERE parser_tool = 'Npm')""",
)
cte(
    "npm_rows",
    f"""SELECT log_id, seg, 'NPM_MISSING_SCRIPT' AS code, 'Missing script: "' || {trim('script')} || '"' AS message, 'Missing script: "' || {trim('script')} || '"' AS tmpl,
      'Error' AS severity, 'npm' AS source, NULL AS file_path, NULL::INT AS line, NULL::INT AS col, NULL::INT AS end_line, NULL::INT AS end_col, 'script=' || {trim('script')} AS meta
      FROM npm_scan WHERE script IS NOT NULL
      UNION ALL SELECT log_id, seg, coalesce(found, {q(C.NPM_DEFAULT_CODE)}), coalesce(first_text, {q(C.NPM_DEFAULT_MESSAGE)}), coalesce(first_text, {q(C.NPM_DEFAULT_MESSAGE)}),
      'Error', 'npm', {slashes('path')}, NULL, NULL, NULL, NULL, coalesce('path=' || {slashes('path')}, '')
      FROM npm_scan WHERE script IS NULL AND (found IS NOT NULL OR first_text IS NOT NULL)""",
)


def _vx(pattern: str, i: int, flags: str) -> str:
    return ex("segment", pattern, i, flags)


_imp, _exp, _prs = (
    rx("segment", C.VITE_IMPORT, "i"), rx("segment", C.VITE_EXPORT, "im"), rx("segment", C.VITE_PARSE, "im-s"),
)
_v_first = "list_filter(list_transform(string_split(segment, chr(10)), lambda x: " + trim("x") + "), lambda x: x <> '' AND NOT " + starts("x", C.VITE_NOISE_PREFIXES) + f" AND NOT starts_with(x, {q(C.VITE_NOISE_MARK)}))[1]"
_target, _importer = trim(_vx(C.VITE_IMPORT, 1, "i")), slashes(_vx(C.VITE_IMPORT, 2, "i"))
_e = [None] + [_vx(C.VITE_EXPORT, i, "im") for i in range(1, 7)]
_p = [None] + [_vx(C.VITE_PARSE, i, "im-s") for i in range(1, 5)]
_f = [None] + [_vx(C.VITE_FILE, i, "im-s") for i in range(1, 4)]
_none = "NULL::INT"
cte(
    "vite_rows",
    f"""SELECT log_id, seg, 'VITE_RESOLVE_IMPORT' AS code, msg AS message, msg AS tmpl, 'Error' AS severity, 'vite' AS source, imp AS file_path,
        {_none} AS line, {_none} AS col, {_none} AS end_line, {_none} AS end_col, 'import=' || tgt || ';importer=' || imp AS meta FROM (
        SELECT log_id, seg, {_target} AS tgt, {_importer} AS imp, 'Rollup failed to resolve import "' || {_target} || '" from "' || {_importer} || '".' AS msg
        FROM segs WHERE parser_tool = 'Vite' AND {_imp})
      UNION ALL SELECT log_id, seg, 'VITE_MISSING_EXPORT', msg, msg, 'Error', 'vite', fp, l, c, NULL, NULL, coalesce('importer=' || imp || ';', '') || 'module=' || mdl || ';symbol=' || sym FROM (
        SELECT log_id, seg, {slashes(_e[1])} AS fp, {num(_e[2])} AS l, {num(_e[3])} AS c, {trim(_e[4])} AS sym, {slashes(_e[5])} AS mdl, {slashes(nz(_e[6]))} AS imp,
        '"' || {trim(_e[4])} || '" is not exported by "' || {slashes(_e[5])} || '".' AS msg FROM segs WHERE parser_tool = 'Vite' AND NOT {_imp} AND {_exp})
      UNION ALL SELECT log_id, seg, 'VITE_PARSE_ERROR', {collapse(_p[4])}, {collapse(_p[4])} || ' in "' || {slashes(_p[1])} || '"', 'Error', 'vite', {slashes(_p[1])}, {num(_p[2])}, {num(_p[3])}, NULL, NULL, ''
        FROM segs WHERE parser_tool = 'Vite' AND NOT {_imp} AND NOT {_exp} AND {_prs}
      UNION ALL SELECT log_id, seg, 'VITE_BUILD_ERROR', {collapse('first_text')}, {collapse('first_text')}, 'Error', 'vite', {nz(slashes(_f[1]))}, {num(_f[2])}, {num(_f[3])}, NULL, NULL, ''
        FROM (SELECT *, {_v_first} AS first_text FROM segs WHERE parser_tool = 'Vite' AND NOT {_imp} AND NOT {_exp} AND NOT {_prs}) WHERE first_text IS NOT NULL""",
)


# ---------------------------------------------------------------- normalisation, category, fingerprint
def normalize_dotnet(x: str) -> str:
    for regex, template in C.DOTNET_TEMPLATES:
        x = sub(x, regex, template)
    return x


def normalize_tsc(x: str) -> str:
    for regex, template in C.TYPESCRIPT_TEMPLATES:
        x = sub(x, regex, template.replace("$1", r"\1"), "i-s")
    return x


def _templates(code: str, x: str, table: dict) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {sub(x, regex, template, 'i-s')}" for k, (regex, template) in table.items())
    return f"CASE {code} {whens} ELSE {x} END"


def normalize_python(code: str, x: str) -> str:
    y = sub(_templates(code, x, C.PYTHON_TEMPLATES), C.PYTHON_QUOTED_PATH, "'{path}'")
    y = sub(y, C.PYTHON_INTEGER, "{number}")
    # no look-ahead here: placeholders are put aside first
    y = f"regexp_replace({y}, '''(\\{{(?:identifier|module|path|type|attribute)\\}})''', chr(1) || '\\1' || chr(1), 'g')"
    y = sub(y, r"'[^'\r\n]+'", "'{identifier}'")
    return f"CASE WHEN coalesce({x}, '') = '' THEN {code} ELSE replace({y}, chr(1), '''') END"


def normalize_js(code: str, x: str) -> str:
    return sub(_templates(code, x, C.JAVASCRIPT_TEMPLATES), C.JAVASCRIPT_QUOTED_PATH, "'{path}'")


def by_text(x: str, table: list) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), {q(t.lower())}) THEN {q(c)}" for t, c in table) + " ELSE 'Unknown' END"


def classify(tool: str, code: str, x: str) -> str:
    prefix = "CASE " + " ".join(f"WHEN starts_with(upper({code}), {q(p)}) THEN {q(c)}" for p, c in C.DOTNET_CODE_PREFIX_CATEGORY) + " END"
    return f"""CASE {tool} WHEN 'DotNet' THEN coalesce({prefix}, {case(f'upper({code})', C.DOTNET_CODE_CATEGORY)}, {by_text(x, C.DOTNET_TEXT_CATEGORY)})
      WHEN 'TypeScript' THEN coalesce({case(f'upper({code})', C.TYPESCRIPT_CODE_CATEGORY)}, {by_text(x, C.TYPESCRIPT_TEXT_CATEGORY)})
      WHEN 'Python' THEN coalesce({case(code, C.PYTHON_CODE_CATEGORY)}, {by_text(x, C.PYTHON_TEXT_CATEGORY)})
      ELSE coalesce({case(f'upper({code})', C.JAVASCRIPT_CODE_CATEGORY)}, {by_text(x, C.JAVASCRIPT_TEXT_CATEGORY)}) END"""


_named = "CASE " + " ".join(
    f"WHEN parser_tool = {q(t)} AND upper(code) = {q(c)}"
    + (f" AND category = {q(cat)}" if cat else "")
    + (f" AND contains(lower(normalized_message), {q(text.lower())})" if text else "")
    + f" THEN {q(fp)}"
    for t, c, cat, text, fp in C.CANONICAL_FINGERPRINTS
) + " END"
_hash = "'fp_' || left(sha256(parser_tool || '|' || upper(code) || '|' || category || '|' || lower(normalized_message)), 16)"
cte(
    "records",
    " UNION ALL ".join(f"SELECT {_COLS} FROM {t}" for t in ("dotnet_located", "dotnet_plain", "tsc_rows", "python_rows", "npm_rows", "vite_rows")),
    True,
)
cte(
    "diags",
    f"""SELECT *, {_named} AS named, {_hash} AS hashed, coalesce({_named}, {_hash}) AS fingerprint,
      'diag_' || log_id || '_' || lpad(CAST(seg AS VARCHAR), 6, '0') AS diagnostic_id FROM (
      SELECT *, {classify('parser_tool', 'code', 'normalized_message')} AS category FROM (
        SELECT *, CASE parser_tool WHEN 'DotNet' THEN {normalize_dotnet('tmpl')} WHEN 'TypeScript' THEN {normalize_tsc('tmpl')}
          WHEN 'Python' THEN {normalize_python('code', 'tmpl')} ELSE {normalize_js('code', 'tmpl')} END AS normalized_message
        FROM records r JOIN segs s USING (log_id, seg)))""",
    True,
)
cte(
    "stats",
    """SELECT p.log_id, p.parser_name, CAST(count(s.segment) AS BIGINT) AS total_segments, CAST(count(d.code) AS BIGINT) AS parsed_segments,
      count(s.segment) - count(d.code) AS unparsed_segments,
      CASE WHEN count(s.segment) = 0 THEN 0.0::DOUBLE ELSE round(count(d.code)::DOUBLE / count(s.segment), 4) END AS parse_confidence
      FROM par p LEFT JOIN segs s USING (log_id) LEFT JOIN diags d ON d.log_id = s.log_id AND d.seg = s.seg GROUP BY p.log_id, p.parser_name""",
    True,
)

# ---------------------------------------------------------------- groups and candidates
_score = case("severity", C.SEVERITY_SCORE, "0")
cte("scored", f"SELECT *, {_score} AS sc FROM diags")
cte(
    "grps",
    f"""SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY cnt DESC, primary_id) - 1 AS INT) AS order_index FROM (
      SELECT log_id, fingerprint, CAST(count(*) AS INT) AS cnt, list(diagnostic_id ORDER BY sc DESC, seg) AS ids,
        CAST(count(*) FILTER (severity IN ('Error', 'Fatal')) AS INT) AS error_count, CAST(count(*) FILTER (severity = 'Warning') AS INT) AS warning_count,
        first(diagnostic_id ORDER BY sc DESC, seg) AS primary_id, first(severity ORDER BY sc DESC, seg) AS severity,
        first(category ORDER BY sc DESC, seg) AS category, first(code ORDER BY sc DESC, seg) AS code,
        last(normalized_message ORDER BY seg) AS last_message, last(category ORDER BY seg) AS last_category, last(code ORDER BY seg) AS last_code,
        any_value(parser_tool) AS tool_kind
      FROM scored GROUP BY log_id, fingerprint)""",
    True,
)
_weight = case("g.severity", C.SEVERITY_WEIGHT, str(C.SEVERITY_WEIGHT_DEFAULT))
_boost = case("g.category", C.CATEGORY_BOOST, str(C.CATEGORY_BOOST_DEFAULT))
_cboost = case("g.code", C.CODE_BOOST, "0.0")
_total = f"({_weight})::DOUBLE + ({_boost})::DOUBLE + ({_cboost})::DOUBLE + least(0.08::DOUBLE, (g.cnt - 1) * 0.02::DOUBLE) + least(greatest(s.parse_confidence * 0.1::DOUBLE, 0.0::DOUBLE), 0.1::DOUBLE)"


def _insight(part: int, as_list: bool = False) -> str:
    def v(item):
        return str_list(item[part]) if as_list else q(item[part])

    code = " ".join(f"WHEN g.code = {q(k)} THEN {v(i)}" for k, i in C.INSIGHTS_BY_CODE.items())
    cat = " ".join(f"WHEN g.category = {q(k)} THEN {v(i)}" for k, i in C.INSIGHTS_BY_CATEGORY.items())
    return f"CASE {code} {cat} ELSE {v(C.INSIGHT_DEFAULT)} END"


cte(
    "cands",
    f"""SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY confidence DESC, primary_id) AS INT) AS rank FROM (
      SELECT g.*, s.parse_confidence, round(least(greatest({_total}, 0.0), 0.99), 2) AS confidence,
        list_filter(['diagnostic-code:' || g.code, 'category:' || {case('g.category', C.CATEGORY_TEXT)}, 'severity:' || lower(g.severity),
          CASE WHEN g.cnt > 1 THEN 'group-count:' || g.cnt END, 'parse-confidence:' || printf('%.2f', round(s.parse_confidence, 2)), 'ranked-primary:true'], lambda x: x IS NOT NULL) AS signals,
        {_insight(0)} AS title, {_insight(1)} AS explanation, {_insight(2, True)} AS likely_causes, {_insight(3, True)} AS suggested_fixes
      FROM grps g JOIN stats s USING (log_id))""",
    True,
)
cte(
    "sums",
    """SELECT p.log_id, p.tool_detected, p.input_type, p.project_name, p.repository, p.created_at, p.parser_name, p.persist, s.parse_confidence, s.total_segments, s.unparsed_segments,
      CAST(coalesce(sum(g.cnt), 0) AS INT) AS total_diagnostics, CAST(count(g.fingerprint) AS INT) AS group_count, CAST(count(g.fingerprint) AS INT) AS primary_issue_count,
      CAST(coalesce(sum(g.error_count), 0) AS INT) AS error_count, CAST(coalesce(sum(g.warning_count), 0) AS INT) AS warning_count
      FROM par p JOIN stats s USING (log_id) LEFT JOIN grps g USING (log_id)
      GROUP BY p.log_id, p.tool_detected, p.input_type, p.project_name, p.repository, p.created_at, p.parser_name, p.persist, s.parse_confidence, s.total_segments, s.unparsed_segments""",
    True,
)

# ---------------------------------------------------------------- rules
cte("rules", RULES_SQL)
_scope = """(r.project_name IS NULL OR lower(trim(r.project_name)) = lower(trim(p.project_name)))
      AND (r.repository IS NULL OR lower(trim(r.repository)) = lower(trim(p.repository)))"""
_stored = "r.is_enabled AND (r.tool_kind IS NULL OR r.tool_kind = p.tool_detected)"
_diag_match = f"""{_scope} AND (r.tool_kind IS NULL OR r.tool_kind = d.parser_tool) AND (r.code IS NULL OR lower(r.code) = lower(d.code))
      AND (r.severity IS NULL OR r.severity = d.severity) AND (r.category IS NULL OR r.category = d.category)
      AND (r.fingerprint IS NULL OR r.fingerprint = d.fingerprint)
      AND (r.message_regex IS NULL OR regexp_matches(d.normalized_message, '(?i)' || r.message_regex))
      AND (r.file_path_regex IS NULL OR regexp_matches(coalesce(d.file_path, ''), '(?i)' || r.file_path_regex))"""
_group_match = f"{_scope} AND (r.fingerprint IS NULL OR r.fingerprint = g.fingerprint) AND (r.project_name IS NOT NULL OR r.repository IS NOT NULL OR r.fingerprint IS NOT NULL)"
_names = {
    "projectName": "project_name", "repository": "repository", "tool": "tool_kind", "code": "code", "severity": "severity",
    "category": "category", "fingerprint": "fingerprint", "messageRegex": "message_regex", "filePathRegex": "file_path_regex",
}
cte(
    "described",
    "SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {q(n)} END" for n, c in _names.items())
    + "], lambda x: x IS NOT NULL) AS diagnostic_conditions, list_filter(["
    + ", ".join(f"CASE WHEN {_names[n]} IS NOT NULL THEN {q(n)} END" for n in ("projectName", "repository", "fingerprint"))
    + """], lambda x: x IS NOT NULL) AS group_conditions, list_filter([CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN explanation IS NOT NULL THEN 'explanation' END,
      CASE WHEN suggested_fix IS NOT NULL THEN 'suggestedFixes' END, CASE WHEN confidence_adjustment <> 0 THEN 'confidenceAdjustment' END,
      CASE WHEN mark_primary THEN 'markAsPrimaryCause' END], lambda x: x IS NOT NULL) AS applied_actions FROM rules""",
)


def apps_sql(stored: bool) -> str:
    gate = _stored if stored else "true"
    return f"""SELECT d.log_id, r.rule_id, 'diagnostic' AS target_type, d.diagnostic_id AS target_id, d.fingerprint FROM diags d JOIN par p USING (log_id) JOIN rules r ON {gate} AND {_diag_match}
      UNION ALL SELECT g.log_id, r.rule_id, 'group', g.primary_id, g.fingerprint FROM grps g JOIN par p USING (log_id) JOIN rules r ON {gate} AND {_group_match}"""


def applied_sql(apps: str) -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY log_id ORDER BY round(confidence, 9) DESC, previous_rank) AS INT) AS rank FROM (
      SELECT c.log_id, c.fingerprint, c.primary_id, c.cnt, c.order_index, c.rank AS previous_rank, c.confidence AS previous_confidence, coalesce(a.n, 0) AS applied_rules, c.code, c.category, c.severity,
        c.error_count, c.warning_count, c.last_message, c.last_category, c.last_code, c.tool_kind, c.parse_confidence,
        coalesce(a.title, c.title) AS title, coalesce(a.explanation, c.explanation) AS explanation, c.likely_causes,
        list_distinct_ordered(list_concat(c.suggested_fixes, coalesce(a.fixes, []))) AS suggested_fixes,
        list_distinct_ordered(list_concat(c.signals, coalesce(a.names, []))) AS signals,
        CASE WHEN a.n IS NULL THEN c.confidence ELSE least(greatest(c.confidence + a.delta + CASE WHEN a.mark THEN 0.10::DOUBLE ELSE 0.0 END, 0.0), 1.0) END AS confidence
      FROM cands c LEFT JOIN (
        SELECT log_id, h.fingerprint, CAST(sum(n) AS INT) AS n, sum(n * confidence_adjustment::DOUBLE) AS delta, bool_or(mark_primary) AS mark,
          first(title ORDER BY priority DESC) FILTER (title IS NOT NULL) AS title, first(explanation ORDER BY priority DESC) FILTER (explanation IS NOT NULL) AS explanation,
          list(suggested_fix ORDER BY priority DESC) FILTER (suggested_fix IS NOT NULL) AS fixes, list('rule:' || name ORDER BY priority DESC) AS names
        FROM (SELECT log_id, fingerprint, rule_id, count(*) AS n FROM {apps} GROUP BY ALL) h JOIN rules USING (rule_id) GROUP BY log_id, h.fingerprint) a USING (log_id, fingerprint))"""


def _ordered_distinct(sql: str) -> str:
    """list_distinct loses the order, so the call is spelled out."""
    while "list_distinct_ordered(" in sql:
        start = sql.index("list_distinct_ordered(")
        depth, i = 0, start + len("list_distinct_ordered")
        for j in range(i, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if depth == 0:
                break
        arg = sql[i + 1 : j]
        new = f"list_filter({arg}, lambda x, i: list_position(list_transform({arg}, lambda y: lower(y)), lower(x)) = i)"
        sql = sql[:start] + new + sql[j + 1 :]
    return sql


cte("apps", apps_sql(True), True)
cte("preview_apps", apps_sql(False), True)
cte("applied", _ordered_distinct(applied_sql("apps")), True)
cte("preview_applied", _ordered_distinct(applied_sql("preview_apps")), True)


# ---------------------------------------------------------------- narrative
def _plural(x: str) -> str:
    return f"CASE WHEN {x} = 1 THEN '' ELSE 's' END"


def narrative_sql(cands: str) -> str:
    return f"""SELECT s.*, t.fingerprints, t.fixes, gate, CASE WHEN gate THEN
        'The ' || {case('s.tool_detected', C.TOOL_FRIENDLY, "'build'")} || ' log contains ' || total_diagnostics || ' diagnostic' || {_plural('total_diagnostics')}
        || ', grouped into ' || group_count || ' likely issue cluster' || {_plural('group_count')} || '.'
        || CASE WHEN len(titles) > 0 THEN ' The strongest starting point is ' || lower(titles[1]) || '.' ELSE '' END
        || CASE WHEN len(titles) = 2 THEN ' Secondary issue include ' || lower(titles[2]) || '.' WHEN len(titles) > 2 THEN ' Secondary issues include ' || lower(titles[2]) || ' and ' || lower(titles[3]) || '.' ELSE '' END
        || CASE WHEN warning_count > 0 AND error_count > 0 THEN ' ' || {q(C.NARRATIVE_NOISE)} ELSE '' END END AS narrative_summary,
      CASE WHEN gate THEN array_to_string(group_texts, ' | ') END AS group_summaries,
      CASE WHEN gate THEN array_to_string(CASE WHEN len(fixes) > 0 THEN fixes[1:4] ELSE {str_list(C.NARRATIVE_DEFAULT_STEPS)} END, ' | ') END AS next_steps
      FROM (SELECT *, input_type = 'BuildLog' AND (total_diagnostics > 1 OR group_count > 1) AS gate FROM sums) s LEFT JOIN (
        SELECT log_id, list(fingerprint ORDER BY rank) AS fingerprints, (list(title ORDER BY rank))[1:3] AS titles,
          (list(title || ': ' || cnt || ' related diagnostic' || {_plural('cnt')} || ' matched fingerprint ' || fingerprint || '.' ORDER BY order_index))[1:3] AS group_texts,
          list_distinct_ordered(flatten(list(suggested_fixes ORDER BY rank))) AS fixes
        FROM {cands} GROUP BY log_id) t USING (log_id)"""


cte("narr", _ordered_distinct(narrative_sql("cands")), True)
cte("stored_narr", f"SELECT * FROM ({_ordered_distinct(narrative_sql('applied'))}) WHERE persist", True)
cte("stored_diags", "SELECT d.* FROM diags d JOIN par p USING (log_id) WHERE p.persist")
cte("stored_cands", "SELECT c.*, p.created_at FROM applied c JOIN par p USING (log_id) WHERE p.persist")
cte("stored_apps", "SELECT a.* FROM apps a JOIN par p USING (log_id) WHERE p.persist")

# ---------------------------------------------------------------- patterns


def patterns_sql(source: str) -> str:
    return f"""SELECT fingerprint, first(title ORDER BY created_at, log_id) AS title, last(last_message ORDER BY created_at, log_id) AS canonical_message,
      last(tool_kind ORDER BY created_at, log_id) AS tool_kind, last(last_category ORDER BY created_at, log_id) AS category,
      last(last_code ORDER BY created_at, log_id) AS diagnostic_code, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at,
      CAST(sum(cnt) AS BIGINT) AS occurrence_count, last(suggested_fixes[1] ORDER BY created_at, log_id) AS last_suggested_fix FROM {source} GROUP BY fingerprint"""


cte("pats", patterns_sql("stored_cands"), True)
