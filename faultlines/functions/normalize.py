"""Message templates: concrete names, paths and numbers become placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import IGNORE_CASE, collapse_ws, is_blank, replace, ws_trim


def normalize_dotnet(message: Column) -> Column:
    result = collapse_ws(message)
    for regex, template in C.DOTNET_TEMPLATES:
        result = replace(result, regex, template)
    return result


def normalize_typescript(message: Column) -> Column:
    result = collapse_ws(message)
    for regex, template in C.TYPESCRIPT_TEMPLATES:
        result = replace(result, regex, template, IGNORE_CASE)
    return result


def _by_code(code: Column, text: Column, templates: dict) -> Column:
    chain = None
    for key, (regex, template) in templates.items():
        replaced = replace(text, regex, template, IGNORE_CASE)
        chain = F.when(code == key, replaced) if chain is None else chain.when(code == key, replaced)
    return chain.otherwise(text)


def normalize_python(code: Column, message: Column) -> Column:
    result = _by_code(code, collapse_ws(message), C.PYTHON_TEMPLATES)
    result = replace(result, C.PYTHON_QUOTED_PATH, "'{path}'")
    result = replace(result, C.PYTHON_INTEGER, "{number}")
    result = replace(result, C.PYTHON_QUOTED_REST, "'{identifier}'")
    return F.when(is_blank(message), ws_trim(code)).otherwise(result)


def normalize_javascript(code: Column, message: Column) -> Column:
    result = _by_code(code, collapse_ws(message), C.JAVASCRIPT_TEMPLATES)
    result = replace(result, C.JAVASCRIPT_QUOTED_PATH, "'{path}'")
    return F.when(is_blank(message), ws_trim(code)).otherwise(result)


def normalize_message(tool: Column, code: Column, message: Column) -> Column:
    """Per-tool template; ``message`` is the text the parser hands to the normaliser."""
    return (
        F.when(tool == "DotNet", normalize_dotnet(message))
        .when(tool == "TypeScript", normalize_typescript(message))
        .when(tool == "Python", normalize_python(code, message))
        .otherwise(normalize_javascript(code, message))
    )
