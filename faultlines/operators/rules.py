"""User rules: checks, maintenance, matching and application.

A rule matches when all its set triggers match, so the matched-condition list is a property of the rule.
Small rule tables become literal predicates (``inline``): no join, constants folded, every regex compiled
once. Larger ones are joined on their most selective trigger; rules that have regexes but no selective equality are looked up
by the literal that the regex needs. Rules whose regex does not compile are reported by ``bad_regexes`` and match nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from faultlines import constants as C
from faultlines.functions.text import blank_to_null, ci_distinct, is_blank, lookup, text_lit, ws_trim
from faultlines.operators.literals import needed, text_matches
from faultlines.operators.sizing import fits
from faultlines.sources.logs import parse_tool

INLINE_RULES = 200
SPREAD = 32

_TRIGGERS = [
    ("projectName", "project_name"),
    ("repository", "repository"),
    ("tool", "tool_kind"),
    ("code", "code"),
    ("severity", "severity"),
    ("category", "category"),
    ("fingerprint", "fingerprint"),
    ("messageRegex", "message_regex"),
    ("filePathRegex", "file_path_regex"),
]
_GROUP_TRIGGERS = ["projectName", "repository", "fingerprint"]


# ---------------------------------------------------------------- checks


def _error(field: str, message: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))


def _known(value: Column, names: list[str]) -> Column:
    return F.lower(ws_trim(value)).isin([n.lower() for n in names])


def rule_errors(drafts: DataFrame) -> DataFrame:
    """One row per violation of a rule draft: rule_id, field, message. Regexes: ``bad_regexes``."""
    has_trigger = F.lit(False)
    for _, column in _TRIGGERS:
        has_trigger = has_trigger | ~is_blank(F.col(column))
    has_action = (
        ~is_blank(F.col("title"))
        | ~is_blank(F.col("explanation"))
        | (F.coalesce(F.size("suggested_fixes"), F.lit(0)) > 0)
        | (F.coalesce(F.col("confidence_adjustment"), F.lit(0.0)) != 0)
        | F.coalesce(F.col("mark_primary"), F.lit(False))
    )
    category = F.translate("category", "-_", "")
    checks = [
        F.when(is_blank(F.col("name")), _error("name", "Name is required.")),
        F.when(~has_trigger, _error("conditions", "At least one condition trigger is required.")),
        F.when(
            ~is_blank(F.col("tool_kind")) & parse_tool(F.col("tool_kind")).isNull(),
            _error("conditions.tool", "Tool must be a supported value."),
        ),
        F.when(
            ~is_blank(F.col("severity")) & ~_known(F.col("severity"), C.SEVERITIES),
            _error("conditions.severity", "Severity must be a supported value."),
        ),
        F.when(
            ~is_blank(F.col("category")) & ~_known(category, C.CATEGORIES),
            _error("conditions.category", "Category must be a supported value."),
        ),
    ]
    for column, field in (("project_name", "projectName"), ("repository", "repository")):
        label = field[0].upper() + field[1:]
        checks.append(
            F.when(
                F.length(ws_trim(F.col(column))) > C.MAX_SCOPE_CHARS,
                _error(f"conditions.{field}", f"{label} must be {C.MAX_SCOPE_CHARS} characters or fewer."),
            )
        )
    checks.append(F.when(~has_action, _error("actions", "At least one action is required.")))
    return drafts.select("rule_id", F.explode(F.array_compact(F.array(*checks))).alias("e")).select(
        "rule_id", "e.field", "e.message"
    )


def bad_regexes(drafts: DataFrame) -> DataFrame:
    """Rules whose regex the engine that matches them cannot compile."""
    invalid = F.array_compact(
        F.array(
            *[
                F.when(~compiles(F.col(column)), _error(field, "The regex pattern is invalid."))
                for column, field in (("message_regex", "conditions.messageRegex"), ("file_path_regex", "conditions.filePathRegex"))
            ]
        )
    )
    return drafts.select("rule_id", invalid.alias("found")).select("rule_id", F.explode("found").alias("e")).select(
        "rule_id", "e.field", "e.message"
    )


def compiles(regex: Column) -> Column:
    """Whether a regex is blank or compiles with the flags that matching uses."""
    pattern = F.concat(F.lit("(?Uid)"), regex)
    return is_blank(regex) | F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def usable(rules: DataFrame) -> DataFrame:
    """Rules that can be matched: a stored regex that does not compile takes only its own rule out."""
    checked = rules.withColumn("_usable", compiles(F.col("message_regex")) & compiles(F.col("file_path_regex")))
    return checked.filter("_usable").drop("_usable")


def duplicate_names(rules: DataFrame) -> DataFrame:
    """Names carried by more than one rule: a partial aggregation, so a hot name stays cheap."""
    return (
        rules.select("rule_id", ws_trim(F.col("name")).alias("name"))
        .filter(F.col("name") != "")
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("rules"), F.min("rule_id").alias("first_rule_id"))
        .filter("rules > 1")
    )


def taken_names(drafts: DataFrame, stored: DataFrame) -> DataFrame:
    """Drafts whose name another stored rule already has."""
    names = stored.select(F.col("rule_id").alias("_other"), ws_trim(F.col("name")).alias("_name"))
    clash = (ws_trim(F.col("name")) == F.col("_name")) & ~F.col("rule_id").eqNullSafe(F.col("_other"))
    return drafts.join(names, clash, "left_semi")


# ---------------------------------------------------------------- maintenance


def merge_rules(stored: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Create, update or switch rules in bulk; counters and creation time of stored rules stay.

    ``changes`` has the rule columns and ``only_enabled``: true where just ``is_enabled`` is to be set.
    A change that alters nothing leaves ``updated_at`` as it was.
    """
    s, c = F.col("s"), F.col("c")
    editable = [x for x in changes.columns if x not in ("rule_id", "only_enabled", "match_count", "last_matched_at")]
    is_new, touched = s["rule_id"].isNull(), c["rule_id"].isNotNull()
    full = touched & ~c["only_enabled"]
    switched = touched & c["only_enabled"] & ~is_new & (c["is_enabled"] != s["is_enabled"])
    merged = (
        stored.select(F.struct(*stored.columns).alias("s"))
        .join(changes.select(F.struct(*changes.columns).alias("c")), s["rule_id"] == c["rule_id"], "full_outer")
        .filter(~is_new | ~c["only_enabled"])
    )
    columns = {
        x: F.when(full, c[x]).otherwise(s[x]) for x in editable if x != "is_enabled" and x in stored.columns
    }
    return merged.select(
        F.coalesce(s["rule_id"], c["rule_id"]).alias("rule_id"),
        F.when(full | switched, c["is_enabled"]).otherwise(s["is_enabled"]).alias("is_enabled"),
        *[v.alias(k) for k, v in columns.items()],
        F.coalesce(s["match_count"], F.lit(0).cast("long")).alias("match_count"),
        s["last_matched_at"].alias("last_matched_at"),
        F.when(is_new, as_of).otherwise(s["created_at"]).alias("created_at"),
        F.when(is_new | full | switched, as_of).otherwise(s["updated_at"]).alias("updated_at"),
    )


def list_rules(
    rules: DataFrame, is_enabled: bool | None = None, tool: str | None = None, tag: str | None = None,
) -> DataFrame:
    """Rules that pass the filters; page with ``page_rules``, count with ``count()``."""
    result = rules
    if is_enabled is not None:
        result = result.filter(F.col("is_enabled") == is_enabled)
    if tool is not None:
        result = result.filter(F.col("tool_kind") == tool)
    if tag is not None and tag.strip():
        wanted = tag.strip().lower()
        result = result.filter(F.exists("tags", lambda t: F.lower(t) == wanted))
    return result


def page_rules(rules: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("Limit must be between 1 and 100.")
    if offset < 0:
        raise ValueError("Offset must be greater than or equal to zero.")
    ordered = rules.orderBy(F.desc("priority"), F.desc("match_count"), F.col("name"), F.col("rule_id"))
    return ordered.offset(offset).limit(limit)


def enabled_rules(rules: DataFrame, tools: DataFrame) -> DataFrame:
    """For each detected tool the enabled rules without a tool or with this tool, in order of use."""
    fit = F.col("tool_kind").isNull() | (F.col("tool_kind") == F.col("tool_detected"))
    return tools.join(rules.filter("is_enabled"), fit)


def record_matches(rules: DataFrame, applications: DataFrame) -> DataFrame:
    """Counters after a batch of applications(rule_id, applied_at)."""
    return record_hits(rules, applications.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("applied_at").alias("at")))


def record_hits(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Counters after hits(rule_id, n, at), one row for each rule that was hit."""
    named = hits.select("rule_id", F.col("n").alias("_n"), F.col("at").alias("_at"))
    return (
        rules.join(named, "rule_id", "left")
        .withColumns(
            {
                "match_count": F.col("match_count") + F.coalesce(F.col("_n"), F.lit(0)),
                "last_matched_at": F.greatest("last_matched_at", F.col("_at").cast("timestamp")),
            }
        )
        .drop("_n", "_at")
    )


# ---------------------------------------------------------------- description


def _set(column: str) -> Column:
    return ~is_blank(F.col(column))


def applied_actions() -> Column:
    return F.array_compact(
        F.array(
            F.when(_set("title"), F.lit("title")),
            F.when(_set("explanation"), F.lit("explanation")),
            F.when(F.size("suggested_fixes") > 0, F.lit("suggestedFixes")),
            F.when(F.col("confidence_adjustment") != 0, F.lit("confidenceAdjustment")),
            F.when(F.col("mark_primary"), F.lit("markAsPrimaryCause")),
        )
    )


def describe(rules: DataFrame) -> DataFrame:
    """Adds the condition lists for diagnostics and groups and the action list."""
    names = [F.when(_set(column), F.lit(name)) for name, column in _TRIGGERS]
    group = [F.when(_set(column), F.lit(name)) for name, column in _TRIGGERS if name in _GROUP_TRIGGERS]
    return rules.withColumns(
        {
            "diagnostic_conditions": F.array_compact(F.array(*names)),
            "group_conditions": F.array_compact(F.array(*group)),
            "applied_actions": applied_actions(),
        }
    )


def local_rules(rules: DataFrame) -> list[Row] | None:
    """The rules in order of use when there are few enough to inline, else None."""
    if not fits(rules, INLINE_RULES):
        return None
    rows = usable(rules).collect()
    return sorted(rows, key=lambda r: (-r["priority"], -(r["match_count"] or 0), r["name"], r["rule_id"]))


# ---------------------------------------------------------------- matching


def _text(value) -> str | None:
    return value if value is not None and value.strip() else None


def scope_predicate(rule: Row) -> Column | None:
    """Project and repository of the log, trimmed, case ignored."""
    result = None
    for column in ("project_name", "repository"):
        wanted = _text(rule[column])
        if wanted is not None:
            hit = F.lower(ws_trim(F.col(column))) == wanted.strip().lower()
            result = hit if result is None else result & hit
    return result


def _all(parts: list[Column]) -> Column:
    result = None
    for part in parts:
        if part is not None:
            result = part if result is None else result & part
    return F.lit(False) if result is None else F.coalesce(result, F.lit(False))


def diagnostic_predicate(rule: Row, stored: bool = True) -> Column:
    """Literal predicate over diagnostics; ``stored`` adds the enabled and detected-tool filter."""
    if stored and not rule["is_enabled"]:
        return F.lit(False)
    parts = [scope_predicate(rule)]
    tool = _text(rule["tool_kind"])
    if tool is not None:
        parts.append(F.col("parser_tool") == tool)
        if stored:
            parts.append(F.col("tool_detected") == tool)
    if _text(rule["code"]) is not None:
        parts.append(F.lower("code") == rule["code"].lower())
    for column in ("severity", "category", "fingerprint"):
        if _text(rule[column]) is not None:
            parts.append(F.col(column) == rule[column])
    message = F.coalesce("normalized_message", "message")
    if _text(rule["message_regex"]) is not None:
        parts.append(F.regexp_like(message, F.lit("(?Uid)" + rule["message_regex"])))
    if _text(rule["file_path_regex"]) is not None:
        path = F.coalesce(F.col("location.file_path"), F.lit(""))
        parts.append(F.regexp_like(path, F.lit("(?Uid)" + rule["file_path_regex"])))
    return _all(parts)


def group_predicate(rule: Row, stored: bool = True) -> Column:
    """Groups look only at scope and fingerprint."""
    if stored and not rule["is_enabled"]:
        return F.lit(False)
    parts = [scope_predicate(rule)]
    if _text(rule["fingerprint"]) is not None:
        parts.append(F.col("fingerprint") == rule["fingerprint"])
    if all(p is None for p in parts):
        return F.lit(False)
    if stored and _text(rule["tool_kind"]) is not None:
        parts.append(F.col("tool_detected") == rule["tool_kind"])
    return _all(parts)


def inline_hits(rows: list[Row], predicate, stored: bool = True) -> Column:
    """Positions (in order of use) of the rules that match."""
    hits = [F.when(predicate(rule, stored), F.lit(i)) for i, rule in enumerate(rows)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")


def _joined_predicate(target: str, stored: bool) -> Column:
    """The same tests as a join condition between aliases d and r, for rule tables too large to inline."""

    def value(name: str) -> Column:
        return F.col(f"d.{name}")

    def unset(column: str) -> Column:
        return is_blank(F.col(f"r.{column}"))

    def scope(column: str) -> Column:
        return unset(column) | (F.lower(ws_trim(value(column))) == F.lower(ws_trim(F.col(f"r.{column}"))))

    condition = scope("project_name") & scope("repository")
    if stored:
        tool = F.col("r.tool_kind")
        condition = condition & F.col("r.is_enabled") & (unset("tool_kind") | (tool == value("tool_detected")))
    if target == "group":
        has_trigger = F.size("r.group_conditions") > 0
        return condition & has_trigger & (unset("fingerprint") | (value("fingerprint") == F.col("r.fingerprint")))
    condition = condition & (F.size("r.diagnostic_conditions") > 0)
    condition = condition & (unset("tool_kind") | (value("parser_tool") == F.col("r.tool_kind")))
    condition = condition & (unset("code") | (F.lower(value("code")) == F.lower(F.col("r.code"))))
    for column in ("severity", "category", "fingerprint"):
        condition = condition & (unset(column) | (value(column) == F.col(f"r.{column}")))
    message = F.coalesce(value("normalized_message"), value("message"))
    path = F.coalesce(F.col("d.location.file_path"), F.lit(""))
    for text, column in ((message, "message_regex"), (path, "file_path_regex")):
        test = F.regexp_like(text, F.concat(F.lit("(?Uid)"), F.col(f"r.{column}")))
        condition = condition & F.when(unset(column), F.lit(True)).otherwise(test)
    return condition


def _hit_rows(df: DataFrame, rules: DataFrame, target: str, stored: bool) -> DataFrame:
    target_id = F.col("diagnostic_id") if target == "diagnostic" else F.col("primary.id")
    local = local_rules(rules)
    if local is not None:
        predicate = diagnostic_predicate if target == "diagnostic" else group_predicate
        ids = F.array(*[F.lit(r["rule_id"]) for r in local])
        hits = F.transform(inline_hits(local, predicate, stored), lambda i: ids[i])
        return df.select("log_id", F.explode(hits).alias("rule_id"), target_id.alias("target_id"), "fingerprint")
    return keyed_hits(df.withColumn("target_id", target_id), rules, target, stored)


def _match_keys(target: str) -> list[tuple[str, str, str]]:
    """Triggers that are equalities, most selective first: name, column of the rule, column of the target."""
    scope = [("project", "project_name", "project_name"), ("repository", "repository", "repository")]
    if target == "scope":
        return scope
    if target == "group":
        return [("fingerprint", "fingerprint", "fingerprint"), *scope]
    return [
        ("fingerprint", "fingerprint", "fingerprint"), ("code", "code", "code"), *scope, ("category", "category", "category"),
        ("tool", "tool_kind", "parser_tool" if target == "diagnostic" else "tool_kind"), ("severity", "severity", "severity"),
    ]


_WIDE_KEYS = ["category", "tool", "severity"]


def _way_key(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ":"), F.lower(ws_trim(value)))


def _with_way(rules: DataFrame, target: str, texts: Iterable[str]) -> DataFrame:
    """Rules that can meet something, with the way that each is looked up (see ``meetings``), its key and its literals."""
    literals = {column: F.when(~is_blank(F.col(column)), needed(F.col(column))) for column in texts}
    wanted = rules.withColumns({f"literal_{column}": literal for column, literal in literals.items()})
    ways = [(name, F.when(~is_blank(F.col(column)), _way_key(name, F.col(column)))) for name, column, _ in _match_keys(target)]
    by_text = [(column, F.when(F.col(f"literal_{column}").isNotNull(), F.lit(column + ":"))) for column in texts]
    narrow, wide = [w for w in ways if w[0] not in _WIDE_KEYS], [w for w in ways if w[0] in _WIDE_KEYS]
    chosen = F.coalesce(*[w for _, w in [*narrow, *by_text, *wide]], F.lit(":"))
    # a rule without any of these triggers meets nothing
    some = [F.col("rule_key") != ":", *[~is_blank(F.col(column)) for column in texts]]
    return wanted.withColumn("rule_key", chosen).filter(reduce(or_, some)).withColumn("way", F.split_part("rule_key", F.lit(":"), F.lit(1)))


def meetings(
    df: DataFrame, rules: DataFrame, target: str, own_id: str, condition: Column, texts: dict[str, Column], found: list[Column]
) -> DataFrame:
    """Pairs of targets (alias d) and rules (alias r) for which ``condition`` holds, as the columns ``found``.

    Each rule is looked up in one way: by its most selective equality; else by the literal of a regex over ``texts`` (column of the
    rule to text of the target), once for each distinct text; else by category, tool or severity. Only rules of nothing but
    regexes without a literal meet all targets, which ``SPREAD`` groups share. At most a dozen names of ways reach the driver;
    a way that no rule takes is not planned.
    """
    keys, wanted = _match_keys(target), _with_way(rules, target, texts)
    used = {r["way"] for r in wanted.select("way").distinct().collect()}

    parts = []
    given = [_way_key(name, F.col(own)) for name, _, own in keys if name in used]
    if given:
        offered = df.withColumn("target_key", F.explode(F.array_compact(F.array(*given))))
        parts.append(offered.alias("d").join(wanted.alias("r"), (F.col("d.target_key") == F.col("r.rule_key")) & condition))
    if "" in used:
        dealt = df.withColumn("target_group", F.pmod(F.xxhash64(own_id), F.lit(SPREAD)).cast("int"))
        dealt = dealt.repartition(SPREAD, "target_group")
        each = wanted.filter("way = ''").withColumn("rule_group", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        parts.append(dealt.alias("d").join(each.alias("r"), (F.col("d.target_group") == F.col("r.rule_group")) & condition))
    for column, text in texts.items():
        if column in used:
            own = wanted.filter(F.col("way") == column)
            patterns = own.select("rule_id", F.col(column).alias("pattern"), F.col(f"literal_{column}").alias("literal"))
            pairs = text_matches(df.select(text.alias("text")), patterns).withColumnRenamed("rule_id", "pair_rule")
            held = df.withColumn("target_text", text).join(pairs, F.col("target_text") == F.col("text")).drop("text", "target_text")
            parts.append(held.alias("d").join(own.alias("r"), (F.col("d.pair_rule") == F.col("r.rule_id")) & condition))
    if not parts:
        return df.alias("d").join(wanted.alias("r"), F.lit(False)).select(*found)
    result = parts[0].select(*found)
    for part in parts[1:]:
        result = result.unionByName(part.select(*found))
    return result


def keyed_hits(df: DataFrame, rules: DataFrame, target: str, stored: bool = True) -> DataFrame:
    """Matches by ``meetings`` for any number of rules; df has the column target_id."""
    texts = {}
    if target == "diagnostic":
        texts = {"message_regex": F.coalesce("normalized_message", "message"), "file_path_regex": F.coalesce(F.col("location.file_path"), F.lit(""))}
    found = [F.col("d.log_id"), F.col("r.rule_id"), F.col("d.target_id"), F.col("d.fingerprint")]
    return meetings(df, describe(usable(rules)), target, "target_id", _joined_predicate(target, stored), texts, found)


# ---------------------------------------------------------------- totals of many rules

_TESTED = {
    "project_name": ["project_name"], "repository": ["repository"], "tool_kind": ["parser_tool", "tool_detected"], "code": ["code"], "severity": ["severity"],
    "category": ["category"], "fingerprint": ["fingerprint"], "message_regex": ["normalized_message"], "file_path_regex": ["file_path"],
}
_TEXTS = ["message_regex", "file_path_regex"]
_KIND = [own for columns in _TESTED.values() for own in columns]


def tested_kinds(diags: DataFrame, rules: DataFrame) -> DataFrame:
    """Logs by the diagnostics that they have: set_id, rows, logs (with an id) and kinds, an array of struct(kind, the tested fields, n).

    A kind holds the diagnostics that agree in every field that some rule tests, so they match the same rules. Other fields
    are left out; which those are is one row of flags on the driver.
    """
    used = rules.agg(*[F.max(~is_blank(F.col(c))).alias(c) for c in _TESTED]).first()
    texts = {"normalized_message": F.coalesce("normalized_message", "message"), "file_path": F.coalesce(F.col("location.file_path"), F.lit(""))}
    fields = [
        (texts.get(own, F.col(own)) if used[column] else text_lit(None)).alias(own) for column, columns in _TESTED.items() for own in columns
    ]
    counted = diags.select("log_id", *fields).groupBy("log_id", *_KIND).agg(F.count(F.lit(1)).alias("n"))
    kind = F.sha2(F.to_json(F.struct(*_KIND)), 256).alias("kind")
    per_log = counted.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct(kind, *_KIND, "n"))).alias("kinds"))
    sets = per_log.groupBy("kinds").agg(F.count(F.lit(1)).alias("rows"), F.count("log_id").alias("logs"))
    return sets.withColumn("set_id", F.monotonically_increasing_id())


def hit_totals(sets: DataFrame, rules: DataFrame, stored: bool = True) -> DataFrame:
    """rule_id, hits and logs: how many rows and how many log ids ``keyed_hits`` gives for each rule that matches.

    sets: a written table of ``tested_kinds`` for the same rules. One diagnostic of each kind meets one rule of each kind; a pair counts
    for all diagnostics and rules of its kinds, so the work is that of the kinds and not of the pairs.
    """
    tests = [*_TESTED, "is_enabled"]
    named = rules.withColumn("rule_kind", F.sha2(F.to_json(F.struct(*tests)), 256))
    held = sets.select("set_id", "rows", "logs", F.inline("kinds"))
    targets = held.select("kind", *_KIND).distinct().withColumns({"log_id": text_lit(None), "target_id": F.col("kind"), "message": text_lit(None), "location": F.struct("file_path")})
    one_each = named.dropDuplicates(["rule_kind"]).withColumn("rule_id", F.col("rule_kind")).drop("rule_kind")
    met = keyed_hits(targets, one_each, "diagnostic", stored).select(F.col("rule_id").alias("rule_kind"), F.col("target_id").alias("kind"))

    # Rows that repeat a rule id count each for its hits and together for its logs; those found by a literal meet a text by the
    # rule id, so each of them counts once for each.
    own = named.groupBy("rule_id").agg(F.sort_array(F.collect_list("rule_kind")).alias("rule_kinds"))
    alike = own.select("rule_kinds").distinct().select("rule_kinds", F.explode("rule_kinds").alias("rule_kind"))
    by_text = _with_way(one_each, "diagnostic", _TEXTS).select(F.col("rule_id").alias("rule_kind"), F.col("way").isin(*_TEXTS).alias("by_text"))
    alike = alike.groupBy("rule_kinds", "rule_kind").agg(F.count(F.lit(1)).alias("n_rows")).join(by_text, "rule_kind")
    alike = alike.withColumn("times", F.when(F.col("by_text"), F.col("n_rows") * F.col("n_rows")).otherwise(F.col("n_rows")))
    found = alike.join(met, "rule_kind").join(held.select("kind", "set_id", "n", "rows", "logs"), "kind")
    per_set = found.groupBy("rule_kinds", "set_id").agg(F.sum(F.col("times") * F.col("n") * F.col("rows")).alias("hits"), F.first("logs").alias("logs"))
    totals = per_set.groupBy("rule_kinds").agg(F.sum("hits").alias("hits"), F.sum("logs").alias("logs"))
    return own.join(totals, "rule_kinds").select("rule_id", "hits", "logs")


def scope_hits(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """(log_id, rule_id) of logs and rules whose project and repository, where the rule sets them, agree."""
    scoped = usable(rules).filter(~is_blank(F.col("project_name")) | ~is_blank(F.col("repository")))

    def same(column: str) -> Column:
        return is_blank(F.col(f"r.{column}")) | (F.lower(ws_trim(F.col(f"d.{column}"))) == F.lower(ws_trim(F.col(f"r.{column}"))))

    rows = logs.select("log_id", "project_name", "repository")
    return meetings(rows, scoped, "scope", "log_id", same("project_name") & same("repository"), {}, [F.col("d.log_id"), F.col("r.rule_id")])


def match_diagnostics(diags: DataFrame, rules: DataFrame, stored: bool = True) -> DataFrame:
    """Applications on diagnostics: log_id, rule_id, target_type, target_id, fingerprint."""
    return _hit_rows(diags, rules, "diagnostic", stored).withColumn("target_type", F.lit("diagnostic"))


def match_groups(groups: DataFrame, rules: DataFrame, stored: bool = True) -> DataFrame:
    """Applications on groups; the target is the group's primary diagnostic."""
    return _hit_rows(groups, rules, "group", stored).withColumn("target_type", F.lit("group"))


def match_audit(applications: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Audit rows with matched conditions, actions and the batch time."""
    d = describe(rules).select("rule_id", "diagnostic_conditions", "group_conditions", "applied_actions")
    conditions = F.when(F.col("target_type") == "group", F.col("group_conditions")).otherwise(
        F.col("diagnostic_conditions")
    )
    return applications.join(d, "rule_id").select(
        "log_id", "rule_id", "target_type", "target_id", "fingerprint", conditions.alias("matched_conditions"),
        "applied_actions", as_of.alias("applied_at"),
    )


# ---------------------------------------------------------------- application


def apply_hits(candidates: DataFrame, rows: list[Row], hits: Column) -> DataFrame:
    """Rewrites candidates from ``hits``: rule positions, one entry per application.

    A rule that hit several diagnostics of a group counts as often as it hit.
    """

    def literals(field: str) -> Column:
        return F.array(*[text_lit(_text(r[field])) for r in rows])

    def first_text(field: str) -> Column:
        texts = F.transform(F.col("_rules"), lambda i: literals(field)[i])
        return F.get(F.filter(texts, lambda t: t.isNotNull()), F.lit(0))

    adjustments = F.array(*[F.lit(float(r["confidence_adjustment"] or 0.0)) for r in rows])
    marks = F.array(*[F.lit(bool(r["mark_primary"])) for r in rows])
    fixes = F.array(
        *[F.array(*[F.lit(x) for x in (r["suggested_fixes"] or [])]).cast("array<string>") for r in rows]
    )
    names = F.array(*[F.lit("rule:" + r["name"]) for r in rows])
    delta = F.aggregate(F.col("_hits"), F.lit(0.0), lambda acc, i: acc + adjustments[i])
    bonus = F.when(F.exists("_rules", lambda i: marks[i]), F.lit(C.PRIMARY_MARK_BONUS)).otherwise(F.lit(0.0))
    adjusted = F.least(F.greatest(F.col("confidence") + (delta + bonus), F.lit(0.0)), F.lit(1.0))
    own = F.filter(
        F.concat("suggested_fixes", F.flatten(F.transform("_rules", lambda i: fixes[i]))), lambda x: ~is_blank(x)
    )
    hit = F.size("_hits") > 0
    changed = (
        candidates.withColumn("_hits", hits)
        .withColumn("_rules", F.sort_array(F.array_distinct("_hits")))
        .withColumns(
            {
                "applied_rules": F.size("_hits"),
                "previous_rank": F.col("rank"),
                "previous_confidence": F.col("confidence"),
                "title": F.coalesce(first_text("title"), F.col("title")),
                "explanation": F.coalesce(first_text("explanation"), F.col("explanation")),
                "suggested_fixes": F.when(hit, ci_distinct(own)).otherwise(F.col("suggested_fixes")),
                "signals": F.when(
                    hit, ci_distinct(F.concat("signals", F.transform("_rules", lambda i: names[i])))
                ).otherwise(F.col("signals")),
                "confidence": F.when(hit, adjusted).otherwise(F.col("confidence")),
            }
        )
        .drop("_hits", "_rules")
    )
    return rerank(changed)


def rerank(candidates: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    # Sums of decimals differ in the last bits by order; equal sums keep the previous order.
    ordered = W.partitionBy("log_id").orderBy(F.desc(F.round("confidence", 9)), F.col("previous_rank"))
    return candidates.withColumn("rank", F.row_number().over(ordered))


def apply_applications(candidates: DataFrame, applications: DataFrame, rules: DataFrame) -> DataFrame:
    """Join form of ``apply_hits`` for rule tables too large to inline."""
    order = [
        (-F.col("priority")).alias("p"), (-F.coalesce(F.col("match_count"), F.lit(0))).alias("m"), F.col("name"), F.col("rule_id"),
    ]
    entry = F.struct(
        *order, blank_to_null(F.col("title")).alias("title"), blank_to_null(F.col("explanation")).alias("explanation"),
        "suggested_fixes", "confidence_adjustment", "mark_primary", "n",
    )
    per_rule = applications.groupBy("log_id", "fingerprint", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    props = rules.select(
        "rule_id", "priority", "match_count", "name", "title", "explanation", "suggested_fixes",
        "confidence_adjustment", "mark_primary",
    )
    applied = (
        per_rule.join(props, "rule_id")
        .groupBy("log_id", "fingerprint")
        .agg(F.sort_array(F.collect_list(entry)).alias("_apps"))
    )
    apps = F.col("_apps")

    def first_text(field: str) -> Column:
        texts = F.filter(F.transform(apps, lambda a: a[field]), lambda t: t.isNotNull())
        return F.get(texts, F.lit(0))

    delta = F.aggregate(apps, F.lit(0.0), lambda acc, a: acc + a["confidence_adjustment"] * a["n"])
    bonus = F.when(F.exists(apps, lambda a: a["mark_primary"]), F.lit(C.PRIMARY_MARK_BONUS)).otherwise(F.lit(0.0))
    own = F.filter(
        F.concat("suggested_fixes", F.flatten(F.transform(apps, lambda a: a["suggested_fixes"]))),
        lambda x: ~is_blank(x),
    )
    names = F.transform(apps, lambda a: F.concat(F.lit("rule:"), a["name"]))
    hit = apps.isNotNull()
    changed = (
        candidates.join(applied, ["log_id", "fingerprint"], "left")
        .withColumns(
            {
                "applied_rules": F.coalesce(
                    F.aggregate(apps, F.lit(0), lambda acc, a: acc + a["n"].cast("int")), F.lit(0)
                ),
                "previous_rank": F.col("rank"),
                "previous_confidence": F.col("confidence"),
                "title": F.coalesce(first_text("title"), F.col("title")),
                "explanation": F.coalesce(first_text("explanation"), F.col("explanation")),
                "suggested_fixes": F.when(hit, ci_distinct(own)).otherwise(F.col("suggested_fixes")),
                "signals": F.when(hit, ci_distinct(F.concat("signals", names))).otherwise(F.col("signals")),
                "confidence": F.when(
                    hit, F.least(F.greatest(F.col("confidence") + (delta + bonus), F.lit(0.0)), F.lit(1.0))
                ).otherwise(F.col("confidence")),
            }
        )
        .drop("_apps")
    )
    return rerank(changed)


# ---------------------------------------------------------------- related rules


def related_rules(contexts: DataFrame, rules: DataFrame, limit: int = C.RELATED_RULE_LIMIT) -> DataFrame:
    """Enabled rules whose set triggers all fit a fingerprint's context, best first.

    contexts: fingerprint, tool_kind, code, severity, category, canonical_message, file_path,
    project_name, repository - one row per fingerprint, so rows, not occurrences, meet the rules.
    """
    from pyspark.sql import Window as W

    def same(column: str, context: str) -> Column:
        return F.lower(ws_trim(F.col(f"r.{column}"))) == F.lower(ws_trim(F.col(f"d.{context}")))

    def like(column: str, context: str) -> Column:
        usable = ~is_blank(F.col(f"d.{context}"))
        return usable & F.regexp_like(F.col(f"d.{context}"), F.concat(F.lit("(?Uid)"), F.col(f"r.{column}")))

    tests = [
        ("fingerprint", "fingerprint", same("fingerprint", "fingerprint")),
        ("tool", "tool_kind", same("tool_kind", "tool_kind")),
        ("code", "code", same("code", "code")),
        ("severity", "severity", same("severity", "severity")),
        ("category", "category", same("category", "category")),
        ("message-regex", "message_regex", like("message_regex", "canonical_message")),
        ("file-path-regex", "file_path_regex", like("file_path_regex", "file_path")),
        ("projectName", "project_name", same("project_name", "project_name")),
        ("repository", "repository", same("repository", "repository")),
    ]
    condition, any_set, score, matched = F.lit(True), F.lit(False), F.lit(0), []
    for name, column, test in tests:
        unset = is_blank(F.col(f"r.{column}"))
        condition = condition & F.when(unset, F.lit(True)).otherwise(F.coalesce(test, F.lit(False)))
        any_set = any_set | ~unset
        score = score + F.when(unset, F.lit(0)).otherwise(F.lit(C.RELATED_RULE_WEIGHTS[name]))
        matched.append(F.when(~unset, F.lit(name)))
    ranked = W.partitionBy("fingerprint").orderBy(
        F.desc("score"), F.desc("priority"), F.desc("match_count"), F.col("rule_name"), F.col("rule_id")
    )
    found = [
        F.col("d.fingerprint"), F.col("r.rule_id"), F.col("r.name").alias("rule_name"), F.array_compact(F.array(*matched)).alias("matched_by"),
        score.alias("score"), F.col("r.priority"), F.col("r.match_count"), F.col("r.last_matched_at"),
    ]
    texts = {"message_regex": F.col("canonical_message"), "file_path_regex": F.col("file_path")}
    joined = meetings(contexts, usable(rules.filter("is_enabled")), "context", "fingerprint", condition & any_set, texts, found)
    return joined.withColumn("position", F.row_number().over(ranked)).filter(F.col("position") <= limit)
