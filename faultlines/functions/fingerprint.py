"""Fingerprints: a few named ones, otherwise a prefix of SHA-256 over the identifying fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import ws_trim


def canonical_fingerprint(tool: Column, upper: Column, category: Column, lowered: Column) -> Column:
    named = []
    for kind, known_code, known_category, text, fingerprint in C.CANONICAL_FINGERPRINTS:
        hit = (tool == kind) & (upper == known_code)
        if known_category is not None:
            hit = hit & (category == known_category)
        if text is not None:
            hit = hit & F.contains(lowered, F.lit(text.lower()))
        named.append(F.when(hit, F.lit(fingerprint)))
    return F.coalesce(*named)


def hashed_fingerprint(tool: Column, upper: Column, category: Column, lowered: Column) -> Column:
    material = F.concat_ws("|", tool, F.coalesce(upper, F.lit("")), category, ws_trim(lowered))
    return F.concat(F.lit("fp_"), F.substring(F.sha2(material, 256), 1, 16))


def fingerprint(tool: Column, upper: Column, category: Column, lowered: Column) -> Column:
    """``upper`` is the trimmed code in upper case, ``lowered`` the normalised message (or, where that is
    blank, the message) in lower case."""
    return F.coalesce(
        canonical_fingerprint(tool, upper, category, lowered), hashed_fingerprint(tool, upper, category, lowered)
    )
