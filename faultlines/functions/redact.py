"""Redaction of secrets, addresses and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import is_blank, replace, replace_where, ws_trim


def redact_log(value: Column, max_length: int = C.REDACT_MAX_LENGTH) -> Column:
    """For log output: masks, collapses whitespace, then cuts at ``max_length``."""
    result = ws_trim(value)
    result = replace(result, *C.LOG_SECRET)
    for marker, regex, replacement in C.LOG_REDACTIONS:
        result = replace_where(result, marker, regex, replacement)
    result = replace(result, r"\s+", " ")
    cut = F.when(
        F.length(result) > max_length, F.concat(F.substring(result, 1, max_length), F.lit("…"))
    ).otherwise(result)
    return F.when(is_blank(value), value).otherwise(cut)


def redact_raw(value: Column) -> Column:
    """For stored raw content: the whole text is kept, only sensitive parts are masked."""
    mark = "￿"
    result = value
    for marker, regex, replacement in C.RAW_REDACTIONS:
        result = replace_where(result, marker, regex, replacement)
    # One pass over the text marks which kind of key was hit, then the marks become the texts.
    result = replace(result, C.RAW_SECRET, f"{mark}$1{mark}$2{mark}")
    result = replace(result, f"{mark}([^{mark}]+){mark}{mark}", f"$1={C.RAW_SECRET_TOKEN}")
    return replace(result, f"{mark}{mark}([^{mark}]+){mark}", f"$1={C.RAW_SECRET_OTHER}")
