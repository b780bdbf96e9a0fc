"""Text helpers with Unicode-wide whitespace, first-match regex capture and ordered distinct."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inline flags: U = Unicode classes, d = only \n ends a line, i = ignore case, m = ^/$ per line.
PLAIN, IGNORE_CASE = "Ud", "Uid"
LINES, IGNORE_CASE_LINES = "Udm", "Uidm"

# The characters that \s stands for with Unicode classes: a trim by set looks at the ends of a text only and makes no Java string.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# A Unicode noncharacter: never part of interchanged text, so it can separate captured groups.
_MARK = "￿"


def text_lit(value: str | None) -> Column:
    return F.lit(value).cast("string")


def pattern(regex: str, flags: str = PLAIN) -> Column:
    return F.lit(f"(?{flags}){regex}")


def matches(value: Column, regex: str, flags: str = PLAIN) -> Column:
    return F.regexp_like(value, pattern(regex, flags))


def replace(value: Column, regex: str, replacement: str, flags: str = PLAIN) -> Column:
    return F.regexp_replace(value, pattern(regex, flags), F.lit(replacement))


def replace_where(value: Column, marker: str, regex: str, replacement: str, flags: str = PLAIN) -> Column:
    """``replace`` run only on texts that hold ``marker`` (lower case), without which it cannot match.

    A substring scan is far cheaper than a regex over a long text. The lambda binds the text once.
    """
    return F.transform(
        F.array(value),
        lambda v: F.when(
            F.contains(F.lower(v), F.lit(marker)), replace(v, regex, replacement, flags)
        ).otherwise(v),
    )[0]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, also where ``use`` reads it inside lambdas or conditions."""
    return F.transform(F.array(value), use)[0]


def capture(value: Column, regex: str, groups: int, flags: str = PLAIN, anchored: bool = False) -> Column:
    """Groups of the first match as an array (element ``i`` is group ``i``), null without a match.

    One regex pass yields all groups; ``regexp_extract`` would run the regex once per group.
    """
    lead = "" if anchored else "(?s:.*?)"
    whole = f"\\A{lead}(?:{regex})(?s:.*)\\z"
    marked = replace(value, whole, _MARK + _MARK.join(f"${i}" for i in range(1, groups + 1)), flags)
    return bound(marked, lambda found: F.when(F.startswith(found, F.lit(_MARK)), F.split(found, _MARK)))


def group(captured: Column, index: int) -> Column:
    """A captured group, null when it took no part in the match."""
    return F.nullif(captured[index], F.lit(""))


def ws_trim(value: Column) -> Column:
    return F.btrim(value, F.lit(_SPACE))


def is_blank(value: Column) -> Column:
    return F.coalesce(ws_trim(value) == "", F.lit(True))


def blank_to_null(value: Column) -> Column:
    return F.when(ws_trim(value) != "", value)


def collapse_ws(value: Column) -> Column:
    return replace(ws_trim(value), r"\s+", " ")


def forward_slashes(value: Column) -> Column:
    return F.translate(ws_trim(value), "\\", "/")


def normalize_newlines(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def rtrim_lines(value: Column) -> Column:
    return replace(value, r"[^\S\n]++$", "", LINES)


def join_lines(value: Column) -> Column:
    """Lines trimmed, blank ones dropped, joined by one blank."""
    lines = F.split(F.replace(value, F.lit("\r"), F.lit("")), "\n")
    kept = F.filter(F.transform(lines, ws_trim), lambda x: x != "")
    return ws_trim(F.array_join(kept, " "))


def ci_contains(lowered: Column, literal: str) -> Column:
    """``lowered`` must already be lower-cased, so that one lowering serves many markers."""
    return F.contains(lowered, F.lit(literal.lower()))


def ci_contains_any(lowered: Column, literals: Iterable[str]) -> Column:
    result = F.lit(False)
    for literal in literals:
        result = result | ci_contains(lowered, literal)
    return result


def ci_starts_any(lowered: Column, literals: Iterable[str]) -> Column:
    result = F.lit(False)
    for literal in literals:
        result = result | F.startswith(lowered, F.lit(literal.lower()))
    return result


def ci_ends_any(lowered: Column, literals: Iterable[str]) -> Column:
    result = F.lit(False)
    for literal in literals:
        result = result | F.endswith(lowered, F.lit(literal.lower()))
    return result


def lookup(value: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Literal map lookup; ``value`` is evaluated once, unlike in a CASE chain."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), value)
    return found if default is None else F.coalesce(found, F.lit(default))


def ci_distinct(values: Column) -> Column:
    """Case-insensitive distinct that keeps the first spelling and the order; nulls are dropped.

    Values and their lower case are each evaluated once: read inside the lambda they would be computed for every element.
    """

    def firsts(own: Column, lowered: Column) -> Column:
        repeated = F.filter(own, lambda x, i: F.array_position(lowered, F.get(lowered, i)) == i + 1)
        return F.when(F.size(F.array_distinct(lowered)) == F.size(lowered), own).otherwise(repeated)

    known = F.filter(values, lambda x: x.isNotNull())
    return bound(known, lambda own: bound(F.transform(own, F.lower), lambda lowered: firsts(own, lowered)))


def clean_list(values: Column) -> Column:
    """Trimmed, non-blank, case-insensitively distinct strings."""
    return ci_distinct(F.transform(F.filter(values, lambda x: ~is_blank(x)), ws_trim))


def plural(count: Column) -> Column:
    return F.when(count == 1, F.lit("")).otherwise(F.lit("s"))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)


def round_half_up(value: Column, digits: int) -> Column:
    """Half away from zero on the scaled binary value (non-negative input)."""
    scaled = value * F.lit(float(10**digits))
    whole = F.floor(scaled)
    up = F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole)
    return up.cast("double") / F.lit(float(10**digits))


def round_half_even(value: Column, digits: int) -> Column:
    return F.rint(value * F.lit(float(10**digits))) / F.lit(float(10**digits))


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units; encoded only where characters beyond the BMP could matter."""
    return F.octet_length(F.encode(value, "UTF-16LE")) / 2


def longer_than(value: Column, limit: int) -> Column:
    return F.when(F.length(value) > limit, F.lit(True)).when(
        F.length(value) * 2 <= limit, F.lit(False)
    ).otherwise(utf16_length(value) > limit)


def string_list(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
