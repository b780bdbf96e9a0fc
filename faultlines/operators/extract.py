"""Extraction: segments -> diagnostics, all five formats in one narrow pass.

Stages are separate projections on purpose: each regex runs once per segment, its groups are then read
from an array column. ``parsed`` tells whether a segment gave a diagnostic; rows that did not are kept
so that counts per log need no second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlines import constants as C
from faultlines.functions.classify import classify
from faultlines.functions.fingerprint import fingerprint
from faultlines.functions.normalize import normalize_message
from faultlines.functions.text import (
    IGNORE_CASE,
    IGNORE_CASE_LINES,
    LINES,
    blank_to_null,
    capture,
    ci_ends_any,
    collapse_ws,
    forward_slashes,
    group,
    lookup,
    normalize_newlines,
    pattern,
    rtrim_lines,
    text_lit,
    ws_trim,
)
from faultlines.operators import patterns_text as P
from faultlines.session import per_session

LOCATION = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("end_column", T.IntegerType()),
    ]
)


def _null() -> Column:
    return text_lit(None)



def _located(path=None, line=None, column=None, end_line=None, end_column=None) -> Column:
    def number(value):
        return F.lit(None).cast("int") if value is None else value.try_cast("int")

    return F.struct(
        (_null() if path is None else path).alias("file_path"),
        number(line).alias("line"),
        number(column).alias("column"),
        number(end_line).alias("end_line"),
        number(end_column).alias("end_column"),
    )


def _no_location() -> Column:
    return F.lit(None).cast(LOCATION)


def _metadata(**values: Column) -> Column:
    parts = [p for k, v in values.items() for p in (F.lit(k), v)]
    return F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull())


def diagnostic_id(log_id: Column, seg: Column) -> Column:
    return F.concat(F.lit("diag_"), log_id.cast("string"), F.lit("_"), F.lpad(seg.cast("string"), 6, "0"))


def _capture_stages() -> list[dict[str, Column]]:
    """Later stages read columns of earlier ones, so that no regex runs where an earlier one decided."""
    tool, segment = F.col("parser_tool"), F.col("segment")
    header = F.substring_index(segment, "\n", 1)
    first = {
        "_located": F.when(
            tool == "DotNet", capture(segment, C.DOTNET_LOCATED, 9, IGNORE_CASE, anchored=True)
        ),
        "_header": F.when(
            tool == "TypeScript", capture(header, C.TYPESCRIPT_HEADER, 6, IGNORE_CASE, anchored=True)
        ),
        "_text": F.when(tool == "Python", normalize_newlines(segment)).when(
            tool.isin("Npm", "Vite"), rtrim_lines(normalize_newlines(segment))
        ),
        "_script": F.when(tool == "Npm", capture(segment, C.NPM_MISSING_SCRIPT, 1, IGNORE_CASE_LINES)),
        "_import": F.when(tool == "Vite", capture(segment, C.VITE_IMPORT, 2, IGNORE_CASE)),
    }
    npm_rest = (tool == "Npm") & F.col("_script").isNull()
    vite_rest = (tool == "Vite") & F.col("_import").isNull()
    text = F.col("_text")
    second = {
        "_plain": F.when(
            (tool == "DotNet") & F.col("_located").isNull(),
            capture(segment, C.DOTNET_PLAIN, 5, IGNORE_CASE, anchored=True),
        ),
        "_exception": F.when(tool == "Python", capture(text, P.PYTHON_EXCEPTION, 3, anchored=True)),
        "_code": F.when(npm_rest, capture(segment, C.NPM_CODE, 1, IGNORE_CASE_LINES)),
        "_line_code": F.when(npm_rest, capture(text, P.NPM_LINE_CODE, 1, IGNORE_CASE_LINES)),
        "_message": F.when(npm_rest, capture(text, P.NPM_MESSAGE, 1, IGNORE_CASE_LINES)),
        "_path": F.when(npm_rest, capture(segment, C.NPM_PATH, 1, IGNORE_CASE_LINES)),
        "_export": F.when(vite_rest, capture(segment, P.VITE_EXPORT_LINE, 6, IGNORE_CASE_LINES)),
    }
    vite_parse = vite_rest & F.col("_export").isNull()
    third = {
        "_frame": F.when(F.col("_exception").isNotNull(), capture(text, P.PYTHON_LAST_FRAME, 3, anchored=True)),
        "_package": F.when(npm_rest & F.col("_path").isNull(), capture(segment, C.NPM_PACKAGE_JSON, 1, IGNORE_CASE)),
        "_parse": F.when(vite_parse, capture(segment, P.VITE_PARSE_LINE, 4, IGNORE_CASE_LINES)),
    }
    fourth = {
        "_other": F.when(
            vite_parse & F.col("_parse").isNull(), capture(text, P.VITE_MESSAGE_LINE, 1, IGNORE_CASE_LINES)
        ),
        "_file": F.when(
            vite_parse & F.col("_parse").isNull(), capture(segment, C.VITE_FILE, 3, IGNORE_CASE_LINES)
        ),
    }
    return [first, second, third, fourth]


def _dotnet_source(code: Column, explicit: Column) -> Column:
    upper = F.upper(code)
    by_code = F.coalesce(
        *[F.when(F.startswith(upper, F.lit(p)), F.lit(s)) for p, s in C.DOTNET_SOURCES], F.lit(C.DOTNET_SOURCE_DEFAULT)
    )
    usable = blank_to_null(explicit)
    return F.when(
        usable.isNotNull() & ~ci_ends_any(F.lower(usable), C.DOTNET_PROJECT_SUFFIXES), usable
    ).otherwise(by_code)


def _severity(text: Column) -> Column:
    return F.coalesce(
        lookup(F.lower(text), {v: k for k, v in C.SEVERITY_TEXT.items() if k != "Unknown"}), F.lit("Unknown")
    )


def _record(code, message, template_input, severity, source, location, metadata) -> Column:
    return F.struct(
        code.alias("code"),
        message.alias("message"),
        template_input.alias("template_input"),
        severity.alias("severity"),
        source.alias("source"),
        location.alias("location"),
        metadata.alias("metadata"),
    )


def _dotnet_located() -> Column:
    g = F.col("_located")
    message = collapse_ws(g[8])
    return _record(
        ws_trim(g[7]), message, message, _severity(g[6]), _dotnet_source(g[7], _null()),
        _located(blank_to_null(forward_slashes(g[1])), g[2], g[3], group(g, 4), group(g, 5)),
        _metadata(project=forward_slashes(group(g, 9))),
    )


def _dotnet_plain() -> Column:
    g = F.col("_plain")
    message, explicit = collapse_ws(g[4]), ws_trim(group(g, 1))
    is_project = F.coalesce(ci_ends_any(F.lower(explicit), C.DOTNET_PROJECT_SUFFIXES), F.lit(False))
    return _record(
        ws_trim(g[3]), message, message, _severity(g[2]), _dotnet_source(g[3], explicit),
        F.when(is_project, _located(forward_slashes(explicit))).otherwise(_no_location()),
        _metadata(project=forward_slashes(group(g, 5))),
    )


def _typescript() -> Column:
    g = F.col("_header")
    message = collapse_ws(g[6])
    return _record(
        F.upper(ws_trim(g[5])), message, message, _severity(g[4]), F.lit("tsc"),
        _located(blank_to_null(forward_slashes(g[1])), g[2], g[3]), _metadata(none=_null()),
    )


def _caret_column() -> Column:
    """Position of the caret in the nearest of the four lines above the exception line."""
    g = F.col("_exception")
    above = F.split(F.regexp_replace(g[1], r"\n\z", ""), "\n")
    near = F.reverse(F.slice(above, -F.least(F.size(above), F.lit(C.PYTHON_CARET_LINES)), C.PYTHON_CARET_LINES))
    carets = F.filter(F.transform(near, lambda x: F.instr(x, "^")), lambda p: p > 0)
    return F.when(ws_trim(g[2]).isin(C.PYTHON_CARET_EXCEPTIONS), F.get(carets, F.lit(0)))


def _python() -> Column:
    g, frame = F.col("_exception"), F.col("_frame")
    kind = ws_trim(g[2])
    raw = blank_to_null(ws_trim(g[3]))
    frames = F.regexp_count(F.col("_text"), pattern(P.PYTHON_FRAME_LINE, LINES))
    location = F.struct(
        blank_to_null(forward_slashes(frame[1])).alias("file_path"),
        frame[2].try_cast("int").alias("line"),
        _caret_column().cast("int").alias("column"),
        F.lit(None).cast("int").alias("end_line"),
        F.lit(None).cast("int").alias("end_column"),
    )
    return _record(
        kind, F.coalesce(collapse_ws(raw), kind), raw, F.lit("Error"), F.lit("python"), location,
        _metadata(frameCount=frames.cast("string"), function=blank_to_null(collapse_ws(group(frame, 3)))),
    )


def _npm_script() -> Column:
    name = ws_trim(F.col("_script")[1])
    message = F.concat(F.lit('Missing script: "'), name, F.lit('"'))
    return _record(
        F.lit("NPM_MISSING_SCRIPT"), message, message, F.lit("Error"), F.lit("npm"), _no_location(),
        _metadata(script=name),
    )


def _npm_code() -> Column:
    return F.coalesce(F.upper(ws_trim(F.col("_code")[1])), F.upper(F.col("_line_code")[1]))


def _npm_general() -> Column:
    code = F.coalesce(_npm_code(), F.lit(C.NPM_DEFAULT_CODE))
    message = F.coalesce(ws_trim(F.col("_message")[1]), F.lit(C.NPM_DEFAULT_MESSAGE))
    path = forward_slashes(F.coalesce(F.col("_path")[1], F.col("_package")[1]))
    return _record(
        code, message, message, F.lit("Error"), F.lit("npm"),
        F.when(path.isNotNull(), _located(path)).otherwise(_no_location()), _metadata(path=path),
    )


def _vite_import() -> Column:
    g = F.col("_import")
    target, importer = ws_trim(g[1]), forward_slashes(g[2])
    message = F.concat(
        F.lit('Rollup failed to resolve import "'), target, F.lit('" from "'), importer, F.lit('".')
    )
    return _record(
        F.lit("VITE_RESOLVE_IMPORT"), message, message, F.lit("Error"), F.lit("vite"), _located(importer),
        F.create_map(F.lit("import"), target, F.lit("importer"), importer),
    )


def _vite_export() -> Column:
    g = F.col("_export")
    symbol, module = ws_trim(g[4]), forward_slashes(g[5])
    message = F.concat(F.lit('"'), symbol, F.lit('" is not exported by "'), module, F.lit('".'))
    return _record(
        F.lit("VITE_MISSING_EXPORT"), message, message, F.lit("Error"), F.lit("vite"),
        _located(forward_slashes(g[1]), g[2], g[3]),
        _metadata(symbol=symbol, module=module, importer=forward_slashes(group(g, 6))),
    )


def _vite_parse() -> Column:
    g = F.col("_parse")
    path, message = forward_slashes(g[1]), collapse_ws(g[4])
    return _record(
        F.lit("VITE_PARSE_ERROR"), message, F.concat(message, F.lit(' in "'), path, F.lit('"')), F.lit("Error"),
        F.lit("vite"), _located(path, g[2], g[3]), _metadata(none=_null()),
    )


def _vite_other() -> Column:
    message, place = collapse_ws(F.col("_other")[1]), F.col("_file")
    location = F.when(
        place.isNotNull(), _located(forward_slashes(place[1]), group(place, 2), group(place, 3))
    ).otherwise(_no_location())
    return _record(
        F.lit("VITE_BUILD_ERROR"), message, message, F.lit("Error"), F.lit("vite"), location, _metadata(none=_null())
    )


@per_session
def _stages() -> tuple[list[dict[str, Column]], Column, list[dict[str, Column]], Column]:
    """Captures, the record per format, what is derived from the record, and the packed result."""
    npm_found = (F.col("parser_tool") == "Npm") & F.coalesce(
        F.col("_code"), F.col("_line_code"), F.col("_message")
    ).isNotNull()
    record = (
        F.when(F.col("_located").isNotNull(), _dotnet_located())
        .when(F.col("_plain").isNotNull(), _dotnet_plain())
        .when(F.col("_header").isNotNull(), _typescript())
        .when(F.col("_exception").isNotNull(), _python())
        .when(F.col("_script").isNotNull(), _npm_script())
        .when(npm_found, _npm_general())
        .when(F.col("_import").isNotNull(), _vite_import())
        .when(F.col("_export").isNotNull(), _vite_export())
        .when(F.col("_parse").isNotNull(), _vite_parse())
        .when(F.col("_other").isNotNull(), _vite_other())
    )
    tool, code, parsed = F.col("parser_tool"), F.col("code"), F.col("parsed")
    derived = [
        {"normalized_message": F.when(parsed, normalize_message(tool, code, F.col("template_input")))},
        {
            "_upper": F.upper(code),
            "_lowered": F.lower(F.coalesce(blank_to_null(F.col("normalized_message")), F.col("message"))),
        },
        {"category": F.when(parsed, classify(tool, code, F.col("_upper"), F.col("_lowered")))},
    ]
    named = fingerprint(tool, F.col("_upper"), F.col("category"), F.col("_lowered"))
    fields = F.struct(
        "parsed", "code", "message", "severity", "source", "location", "metadata", "normalized_message", "category",
        F.when(parsed, named).alias("fingerprint"),
        F.when(parsed, diagnostic_id(F.col("log_id"), F.col("seg"))).alias("diagnostic_id"),
        _null().alias("subcategory"),
        F.when(parsed, F.lit(False)).alias("is_primary_candidate"),
    )
    return _capture_stages(), record, derived, F.inline_outer(F.array(fields))


def recognise_segments(segments: DataFrame) -> DataFrame:
    """Every segment row with ``parsed`` alone: no templates, categories or hashes are made."""
    keep = segments.columns
    captures, record, _, _ = _stages()
    staged = segments
    for stage in captures:
        staged = staged.withColumns(stage)
    return staged.select(*keep, F.inline_outer(F.array(F.struct(record.isNotNull().alias("parsed")))))


def extract_segments(segments: DataFrame) -> DataFrame:
    """Every segment row with its diagnostic fields; ``parsed`` is false where no format matched."""
    keep = segments.columns
    captures, record, derived, packed = _stages()
    staged = segments
    for stage in captures:
        staged = staged.withColumns(stage)
    staged = staged.select(*keep, record.alias("_r")).select(*keep, F.col("_r").isNotNull().alias("parsed"), "_r.*")
    for stage in derived:
        staged = staged.withColumns(stage)
    # Inlining a one-element array keeps later filters above this point. Pushed below, they would carry
    # copies of the whole chain of expressions with them: regexes run twice and plans explode.
    return staged.select(*keep, packed)


def diagnostics(extracted: DataFrame) -> DataFrame:
    """Parsed rows; ``tool_kind`` is the parser's own kind, which may differ from the detected tool."""
    return extracted.filter("parsed").withColumn("tool_kind", F.col("parser_tool")).withColumnRenamed(
        "segment", "raw_snippet"
    )


def with_order_index(diags: DataFrame) -> DataFrame:
    """Dense position per log, in source order; a log's diagnostics are bounded by the size limit."""
    from pyspark.sql import Window as W

    position = F.row_number().over(W.partitionBy("log_id").orderBy("seg")) - 1
    return diags.withColumn("order_index", position)


def unparsed(extracted: DataFrame) -> DataFrame:
    return extracted.filter(~F.col("parsed") & F.col("segment").isNotNull()).select(
        "log_id", "parser_tool", "seg", "segment"
    )


def segment_stats(extracted: DataFrame) -> DataFrame:
    from faultlines.functions.text import round_half_up

    total, parsed = F.col("total_segments"), F.col("parsed_segments")
    return (
        extracted.groupBy("log_id", "parser_name")
        .agg(F.count("segment").alias("total_segments"), F.count_if("parsed").alias("parsed_segments"))
        .withColumn("unparsed_segments", total - parsed)
        .withColumn("parse_confidence", F.when(total == 0, F.lit(0.0)).otherwise(round_half_up(parsed / total, 4)))
    )
