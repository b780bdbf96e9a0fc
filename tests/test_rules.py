from __future__ import annotations

import re

from helpers import GOLDEN, logs
from pyspark.sql import functions as F

from faultlines.operators import literals as L
from faultlines.operators import rules as R
from faultlines.plans import analysis
from faultlines.sources import fixtures as X


def _rows(df):
    return sorted(
        (r["log_id"], r["fingerprint"], r["rank"], round(r["confidence"], 6), r["title"], tuple(r["suggested_fixes"]), tuple(r["signals"]), r["applied_rules"])
        for r in df.collect()
    )


def test_inlined_rules_equal_joined_rules(spark, sf_dir, monkeypatch):
    segments, rules = analysis.extracted(X.logs(spark, sf_dir)), X.rules(spark)
    inlined = _rows(analysis.applied(segments, rules))
    matched = sorted(tuple(r) for r in R.match_diagnostics(segments.filter("parsed"), rules).collect())
    monkeypatch.setattr(R, "INLINE_RULES", 2)
    assert _rows(analysis.applied(segments, rules)) == inlined
    assert sorted(tuple(r) for r in R.match_diagnostics(segments.filter("parsed"), rules).collect()) == matched
    assert len(inlined) > 100


def test_rule_hits_count_once_per_diagnostic(spark):
    text = "\n".join(f"a.cs({i},1): error CS0103: The name 'x{i}' does not exist in the current context" for i in range(3))
    rules = X.rules(spark).filter("rule_id = 1")
    (row,) = analysis.applied(analysis.extracted(logs(spark, {"x": text})), rules).collect()
    assert row["applied_rules"] == 3 and row["title"] == "Fix the name"
    assert round(row["confidence"], 6) == 1.0 and row["previous_confidence"] == 0.99
    assert row["suggested_fixes"][-1] == "Check spelling." and row["signals"][-1] == "rule:cs0103 guide"


def test_scope_only_rule_hits_every_group(spark):
    rules = X.rules(spark).filter("rule_id = 8").withColumn("repository", F.lit(" REPO "))
    segments = analysis.extracted(logs(spark, {"x": GOLDEN["dotnet.mixed"][1]}))
    rows = analysis.applied(segments, rules).collect()
    assert [r["applied_rules"] for r in rows] == [2, 2, 2]


def test_rule_checks(spark, sf_dir):
    drafts = X.drafts(spark, sf_dir)
    fields = {r["field"] for r in R.rule_errors(drafts).collect()}
    assert {"name", "conditions", "conditions.tool", "conditions.severity", "conditions.category", "actions"} <= fields
    bad = drafts.limit(1).withColumn("message_regex", F.lit("(")).withColumn("file_path_regex", F.lit("ok"))
    (row,) = R.bad_regexes(bad).collect()
    assert row["field"] == "conditions.messageRegex"


def test_taken_names_and_paging(spark, sf_dir):
    drafts = X.drafts(spark, sf_dir)
    assert R.taken_names(drafts.filter("rule_id = 1"), drafts.filter("rule_id <> 1")).count() == 0
    renamed = drafts.filter("rule_id = 1").withColumn("rule_id", F.lit(-1).cast("long"))
    assert R.taken_names(renamed, drafts).count() == 1
    everything = [r["rule_id"] for r in R.page_rules(drafts, 100).collect()]
    assert [r["rule_id"] for r in R.page_rules(drafts, 10, 5).collect()] == everything[5:15]


PATTERNS = {
    "name '.*' does not": "' does not", r"(?i)cannot (find|get) name": "cannot ", r"ab?cdefg+hijk": "cdefg", "a|bcdef": None, r"\QFoo.Bar\E": None,
    "[abc]+defgh": "defgh", r"foo\.barbaz": "barbaz", "x{2,3}yyyy*z": None, r"\p{L}+UNABLE": "unable", "abc": None, r"(?<n>unable) \p{L}+": None,
    r"\x41bcdef": None, r"(a(b(c)))wxyz\)": "wxyz", "(?x) a b c d e": None, "^(?!no)missing script$": "missing script", "skipping": "skipping", "[[a-c]x]{2}end of": "end of",
    "(word)?tail": "tail", "once(?:more)*again+st": "again", "": None, "h\u00e9llo": None, "a.cdefg": "cdefg", r"abcd{0}efgh": "efgh", "abcdefghijklmnopqrstuvwxyz": "abcdefghijklmnopqrstuvwxyz",
}
TEXTS = [
    "Name 'x' does not", "cannot find name", "acdefgggghijk", "a", "Foo.Bar", "cdefgh", "foo.barbaz", "xxyyyz", "\u00e9Unable", "abc", "Abcdef", "abcwxyz)", "abcde", "missing script",
    "\u017f\u212a\u0131pp\u0130ng", "SKIPPING", "axend of", "tail", "once" + "more" * 3000 + "against", "h\u00e9llo", "a\u00e9cdefg", "abcefgh", "x ABCDEFGHIJKLMNOPQRSTUVWXYZ", "", "\U0001f600abc tail",
]


def test_a_match_always_holds_the_literal_of_its_pattern(spark):
    patterns = spark.createDataFrame([(i, p) for i, p in enumerate(PATTERNS)], "rule_id long, pattern string").withColumn("literal", L.needed(F.col("pattern"))).cache()
    assert {r.pattern: r.literal for r in patterns.collect()} == PATTERNS
    texts = spark.createDataFrame([(t,) for t in [*TEXTS, *TEXTS, None]], "text string")
    sure = patterns.filter("literal is not null")
    want = texts.filter("text is not null").distinct().crossJoin(sure).filter(F.regexp_like("text", F.concat(F.lit("(?Uid)"), F.col("pattern")))).select("text", "rule_id")
    found = sorted(map(tuple, L.text_matches(texts, sure).collect()))
    assert found == sorted(map(tuple, want.collect())) and len(found) >= 15


def test_any_number_of_regex_rules_meets_every_diagnostic_that_matches(spark, sf_dir):
    segments = analysis.extracted(X.logs(spark, sf_dir)).filter("parsed").withColumn("target_id", F.col("diagnostic_id")).cache()
    rules = X.regex_rules(spark, sf_dir)
    hits = R.keyed_hits(segments, rules, "diagnostic")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    enabled = [r for r in rules.filter("is_enabled").collect()]
    want = set()
    for d in segments.select("target_id", F.coalesce("normalized_message", "message").alias("m"), F.coalesce("location.file_path", F.lit("")).alias("f")).collect():
        for r in enabled:
            pattern, text = (r.message_regex, d.m) if r.message_regex else (r.file_path_regex, d.f)
            if re.search(pattern, text, re.I):
                want.add((r.rule_id, d.target_id))
    found = [(r.rule_id, r.target_id) for r in hits.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len({r for r, _ in found}) > 5


def test_scope_hits_with_many_rules_and_none(spark, sf_dir):
    rows, rules = X.logs(spark, sf_dir), X.many_rules(spark, sf_dir).withColumn("repository", F.when(F.col("rule_id") % 2 == 0, F.lit(" REPOo ")))
    found = sorted(map(tuple, R.scope_hits(rows, rules).collect()))
    brute = rows.alias("l").join(rules.alias("r"), (F.lower("l.project_name") == F.lower("r.project_name")) & (F.col("r.repository").isNull() | (F.lower("l.repository") == "repoo")))
    assert found == sorted(map(tuple, brute.select("log_id", "rule_id").collect())) and found
    assert R.scope_hits(rows, rules.filter("false")).count() == 0
