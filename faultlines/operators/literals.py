"""Index of the literals that regexes need, so that a regex meets only texts that hold its literal.

Every match of a pattern holds the plain characters outside its groups, classes, escapes and optional parts. The longest run of
them is the pattern's literal; what is not certain counts as absent, so a text that matches is never passed over. The literal is
looked up by its first 4, 8 or 16 characters among all runs of that many characters of a text. Case is folded as the matcher
folds it: four letters beyond ASCII match an ASCII letter when case is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (4, 8, 16)
NESTED = 8
SPREAD = 32
_FREE = "\u0001"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u017f\u212a\u0131\u0130", "abcdefghijklmnopqrstuvwxyzskii"


def folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def needed(pattern: Column) -> Column:
    """The literal of a pattern, folded; null when none of ``LENGTHS[0]`` characters or more is certain."""
    refused = F.regexp_like(pattern, F.lit(r"\\[QExucNk0-9]|\(\?[a-zA-Z]*x|\[\^?\]|\\$"))
    free = lambda text, what: F.regexp_replace(text, what, _FREE)
    plain = free(free(pattern, r"\\[pP](?:\{[^}]*\}|.)"), r"(?s)\\.")
    for _ in range(NESTED):
        plain = free(plain, r"\[[^\[\]]*\]")
    for _ in range(NESTED):
        plain = free(plain, r"\([^()]*\)")
    refused = refused | F.regexp_like(plain, F.lit(r"[\[\]()|]"))
    plain = free(free(plain, r"(?s).?(?:[?*]|\{[^}]*\})[?+]?"), r"[+.^$]|[^\x20-\x7E]")
    longest = F.aggregate(F.split(plain, _FREE), F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    return F.when(~refused & (F.length(longest) >= LENGTHS[0]), folded(longest))


def literal_key(literal: Column) -> Column:
    """The literal's first characters, as many of ``LENGTHS`` as it has; null for null."""
    wide = F.coalesce(*[F.when(F.length(literal) >= n, F.substring(literal, 1, n)) for n in reversed(LENGTHS)])
    return wide


def text_keys(text: Column) -> Column:
    """All distinct runs of each of ``LENGTHS`` characters of a folded text, in one walk for each length."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in LENGTHS]))


def text_matches(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, rule_id) of distinct texts and patterns that match. texts: text; patterns: rule_id, pattern, literal.

    Each distinct text is looked at once, however many rows have it. The texts that share a key are dealt to ``SPREAD`` tasks,
    since a short literal may stand in most of them.
    """
    distinct = texts.filter(F.col("text").isNotNull()).distinct().withColumn("folded", folded(F.col("text")))
    part = F.pmod(F.xxhash64("text"), F.lit(SPREAD)).alias("part")
    offered = distinct.select("text", "folded", part, F.explode(text_keys(F.col("folded"))).alias("key"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))
    asked = patterns.withColumns({"key": literal_key(F.col("literal")), "part": every})
    match = F.contains("folded", "literal") & F.regexp_like("text", F.concat(F.lit("(?Uid)"), F.col("pattern")))
    # so many tasks however few bytes there are: the time goes into the regexes
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return offered.repartition(tasks, "key", "part").join(asked, ["key", "part"]).filter(match).select("text", "rule_id")
