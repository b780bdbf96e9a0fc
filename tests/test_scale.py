from __future__ import annotations

import os

from helpers import golden_logs
from pyspark.sql import functions as F

from faultlines.functions.text import blank_to_null, capture, ci_distinct, is_blank, normalize_newlines, rtrim_lines, ws_trim
from faultlines.operators import literals as L
from faultlines.operators import rules as R
from faultlines.plans import analysis, store
from faultlines.plans import queries as Q
from faultlines.sources import fixtures as X

SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_values_are_evaluated_once(spark):
    df = spark.createDataFrame([(["a", "A", None, "b"], "k=1")], "v array<string>, t string")
    assert _plan(df.select(ci_distinct(F.transform("v", F.reverse)).alias("r"))).count("reverse(") == 1
    assert _plan(df.select(capture(F.col("t"), r"(\w)=(\d)", 2).alias("r"))).count("regexp_replace(") == 1
    assert df.select(capture(F.col("t"), r"(\w)=(\d)", 2).alias("r")).first()["r"] == ["", "k", "1"]
    rows = [(["b", "B", None, "a", "b", ""],), ([None],), ([],), (None,), (["x", "y"],)]
    found = spark.createDataFrame(rows, "v array<string>").select(ci_distinct(F.col("v")).alias("r")).collect()
    assert [r["r"] for r in found] == [["b", "a", ""], [], [], None, ["x", "y"]]


def test_trim_equals_regex(spark):
    values = [f"{a}{b}{c}" for a in ("", *SPACES, SPACES) for b in ("", "x", "a \u3000 b", "\u200b", "\u180e", "\x1f") for c in ("", *SPACES)]
    values += ["a\r\r\nb\r", "a  \n b \t", "\r\n", "  \n  ", "x \u2028"]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    v = F.col("v")
    wanted = {
        "trim": F.regexp_replace(v, r"(?Ud)\A\s+|\s+\z", ""), "blank": F.coalesce(~F.regexp_like(v, F.lit(r"(?Ud)\S")), F.lit(True)),
        "null": F.when(F.regexp_like(v, F.lit(r"(?Ud)\S")), v), "lines": F.regexp_replace(v, "\r\n?", "\n"), "ends": F.regexp_replace(v, r"(?Udm)[^\S\n]+$", ""),
    }
    got = {"trim": ws_trim(v), "blank": is_blank(v), "null": blank_to_null(v), "lines": normalize_newlines(v), "ends": rtrim_lines(v)}
    assert "regexp" not in _plan(df.select(ws_trim(v).alias("a"), is_blank(v).alias("b")))
    for name in wanted:
        assert df.filter(~wanted[name].eqNullSafe(got[name])).count() == 0, name


def test_tables_are_written_when_they_are_read(spark, tmp_path):
    logs, rules = golden_logs(spark), X.rules(spark)
    tables = store.StoredTables(logs, rules, f"file://{tmp_path}/some")
    assert tables["groups"].count() > 0 and tables.written() == {"segments", "groups"}
    assert sorted(os.listdir(tmp_path / "some")) == ["groups", "requests", "segments"]
    store.build_store(logs, rules, f"file://{tmp_path}/all")
    whole = store.open_store(spark, f"file://{tmp_path}/all")
    assert set(tables) == set(whole)
    for name, table in whole.items():
        columns = [F.to_json(F.struct(*table.columns))]
        assert sorted(map(str, tables[name].select(columns).collect())) == sorted(map(str, table.select(columns).collect())), name


def _rules(spark, rows):
    columns = ["rule_id", "is_enabled", *R._TESTED]
    kinds = "rule_id int, is_enabled boolean, " + ", ".join(f"{c} string" for c in R._TESTED)
    flat = spark.createDataFrame([tuple(row.get(c, True if c == "is_enabled" else None) for c in columns) for row in rows], kinds)
    return X.rule_columns(flat.selectExpr("*", "'n' name", "1 priority", "'t' title", "'' explanation", "'f' suggested_fix", "0.1 confidence_adjustment", "false mark_primary"))


def test_totals_equal_pairs(spark, sf_dir):
    rules = _rules(spark, [
        {"rule_id": 1, "code": "CS0103", "project_name": "PROJ1"}, {"rule_id": 2, "code": "cs0103", "project_name": "PROJ1"}, {"rule_id": 3, "code": "CS0103", "is_enabled": False},
        {"rule_id": 4, "project_name": "proj2", "message_regex": "n"}, {"rule_id": 4, "project_name": "proj2", "severity": "Error"}, {"rule_id": 5, "message_regex": "find package [0-4]"},
        {"rule_id": 5, "message_regex": "find package [0-4]"}, {"rule_id": 6, "file_path_regex": "SRC/a1"}, {"rule_id": 7, "message_regex": "(plugin|package) 1"}, {"rule_id": None, "tool_kind": "Python"},
        {"rule_id": 8, "message_regex": "("}, {"rule_id": 9, "code": "none"},
    ])
    rows = analysis.extracted(X.logs(spark, sf_dir)).filter("parsed").withColumn("log_id", F.when(F.col("log_id") % 9 > 0, F.col("log_id")))
    pairs = R.keyed_hits(rows.withColumn("target_id", F.col("diagnostic_id")), rules, "diagnostic")
    wanted = pairs.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("log_id").alias("logs"))
    kinds = Q.staged(R.tested_kinds(rows, rules), "kinds")
    # fields that no rule tests make no kinds of their own
    assert kinds.select(F.inline("kinds")).filter("category IS NOT NULL OR fingerprint IS NOT NULL").isEmpty()
    got = R.hit_totals(kinds, rules)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())) and got.count() == 7


def test_texts_of_one_key_are_dealt_out(spark):
    texts = spark.range(400).select(F.concat(F.lit("src/a"), "id").alias("text"))
    patterns = spark.createDataFrame([(1, "SRC/[ab]1", "src/"), (2, "SRC/a2", "src/")], "rule_id int, pattern string, literal string")
    found = L.text_matches(texts, patterns)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert found.groupBy("rule_id").count().orderBy("rule_id").collect() == [(1, 111), (2, 111)]


def test_batches_have_files_for_all_cores(spark, tmp_path):
    path, cores = f"{tmp_path}/in", spark.sparkContext.defaultParallelism
    Q._stream_input(spark.range(4000), path, "id")
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 2 * cores >= 16
    assert spark.read.parquet(path).distinct().count() == 4000
