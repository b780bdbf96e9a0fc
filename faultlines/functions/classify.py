"""Category of a diagnostic: by code first, then by text in the normalised message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import ci_contains, lookup


def _by_text(lowered: Column, table: list) -> Column:
    chain = F.when(ci_contains(lowered, table[0][0]), F.lit(table[0][1]))
    for text, category in table[1:]:
        chain = chain.when(ci_contains(lowered, text), F.lit(category))
    return chain.otherwise(F.lit("Unknown"))


def classify_dotnet(upper: Column, lowered: Column) -> Column:
    chain = None
    for prefix, category in C.DOTNET_CODE_PREFIX_CATEGORY:
        hit = F.startswith(upper, F.lit(prefix))
        chain = F.when(hit, F.lit(category)) if chain is None else chain.when(hit, F.lit(category))
    return F.coalesce(chain, lookup(upper, C.DOTNET_CODE_CATEGORY), _by_text(lowered, C.DOTNET_TEXT_CATEGORY))


def classify_typescript(upper: Column, lowered: Column) -> Column:
    return F.coalesce(lookup(upper, C.TYPESCRIPT_CODE_CATEGORY), _by_text(lowered, C.TYPESCRIPT_TEXT_CATEGORY))


def classify_python(code: Column, lowered: Column) -> Column:
    return F.coalesce(lookup(code, C.PYTHON_CODE_CATEGORY), _by_text(lowered, C.PYTHON_TEXT_CATEGORY))


def classify_javascript(upper: Column, lowered: Column) -> Column:
    return F.coalesce(lookup(upper, C.JAVASCRIPT_CODE_CATEGORY), _by_text(lowered, C.JAVASCRIPT_TEXT_CATEGORY))


def classify(tool: Column, code: Column, upper: Column, lowered: Column) -> Column:
    """``upper`` is the code in upper case, ``lowered`` the normalised message in lower case."""
    return (
        F.when(tool == "DotNet", classify_dotnet(upper, lowered))
        .when(tool == "TypeScript", classify_typescript(upper, lowered))
        .when(tool == "Python", classify_python(code, lowered))
        .otherwise(classify_javascript(upper, lowered))
    )
