"""No input is left out by a limit: over-long logs, bad stored regexes, many rules, late and replayed stream rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from faultlines.operators import rules as R
from faultlines.operators.group import group_rows, groups
from faultlines.plans import analysis
from faultlines.sources import fixtures as X
from faultlines.sources import logs as S
from faultlines.streaming import streams as ST


@pytest.mark.parametrize("limit", [60, 61, 400])
def test_size_limit_is_exact(spark, sf_dir, limit):
    lengths = {r.log_id: r.n for r in X.logs(spark, sf_dir).select("log_id", F.length("content").alias("n")).collect()}
    kept = {r.log_id for r in X.logs(spark, sf_dir, limit).select("log_id").collect()}
    over = {r.log_id for r in X.oversize(spark, sf_dir, limit).collect()}
    assert kept == {i for i, n in lengths.items() if n <= limit}
    assert over == {i for i, n in lengths.items() if n > limit} and over


def test_chunking_does_not_change_the_verdict(spark):
    whole = "x" * 250_001
    for cuts in ([250_001], [1, 249_999], [125_000, 125_000], [1] * 1000):
        texts, at = [], 0
        for size in cuts[:-1]:
            texts.append(whole[at : at + size])
            at += size
        texts.append("x" * (250_001 - sum(len(t) + 1 for t in texts)))
        chunks = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "log_id long, n int, chunk string")
        assert S.oversize_logs(chunks, F.length("chunk")).count() == 1
        assert S.oversize_logs(chunks, F.length("chunk"), 250_001).count() == 0


def test_over_long_requests_keep_their_other_violations(spark, sf_dir):
    limit = 60
    everything = S.request_errors(X.requests(spark, sf_dir)).collect()
    found = S.request_errors(
        X.requests(spark, sf_dir, limit).withColumn("too_long", F.lit(False)).unionByName(X.oversize_requests(spark, sf_dir, limit))
    ).collect()
    long_ones = [r for r in found if r.message.endswith("characters or fewer.")]
    assert sorted(map(str, set(found) - set(long_ones))) == sorted(map(str, everything))
    over = {r.log_id for r in X.oversize(spark, sf_dir, limit).collect()}
    assert {r.log_id for r in long_ones} == {i for i in over if i % 19 != 4}


@pytest.fixture(scope="module")
def segments(spark, sf_dir):
    return analysis.extracted(X.logs(spark, sf_dir)).cache()


def test_bad_regex_takes_out_its_rule_only(spark, segments):
    rules = X.rules(spark)
    bad = rules.withColumn("message_regex", F.when(F.col("rule_id") == 5, F.lit("(?P<n>x)")).otherwise(F.col("message_regex")))
    assert [r.rule_id for r in R.bad_regexes(bad).collect()] == [5]
    found = R.match_diagnostics(segments.filter("parsed"), bad).select("log_id", "rule_id", "target_id")
    want = R.match_diagnostics(segments.filter("parsed"), rules.filter("rule_id <> 5")).select("log_id", "rule_id", "target_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    named = rules.withColumn("message_regex", F.when(F.col("rule_id") == 5, F.lit("(?<n>unable) \\p{L}+")).otherwise(F.col("message_regex")))
    assert R.bad_regexes(named).count() == 0


def test_keyed_matching_equals_literal_predicates(spark, segments):
    rules = X.rules(spark)
    for target, rows, match in (
        ("diagnostic", segments.filter("parsed").withColumn("target_id", F.col("diagnostic_id")), R.match_diagnostics),
        ("group", groups(group_rows(segments)).withColumn("target_id", F.col("primary.id")), R.match_groups),
    ):
        keyed = R.keyed_hits(rows, rules, target).select("log_id", "rule_id", "target_id")
        literal = match(rows.drop("target_id"), rules).select("log_id", "rule_id", "target_id")
        assert sorted(map(str, keyed.collect())) == sorted(map(str, literal.collect()))


def test_streams_survive_replay_and_restart(spark, sf_dir, tmp_path):
    events = X.table(spark, sf_dir, "events").select("ts", "event_type", "value")
    events.repartition(5, "value").write.parquet(f"{tmp_path}/in")

    def run():
        ST.telemetry_stream(ST.read_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return sorted(map(str, ST.telemetry_table(spark, f"{tmp_path}/out").select("window_start", "event_type", "count").collect()))

    first = run()
    assert run() == first  # no new files
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).alias("window_start")
    assert first == sorted(map(str, events.groupBy(day, "event_type").agg(F.count("*").alias("count")).collect()))
    events.limit(10).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert ST.telemetry_table(spark, f"{tmp_path}/out").agg(F.sum("count")).first()[0] == events.count() + 10
    total = ST.compacted(spark, f"{tmp_path}/out", f"{tmp_path}/whole", lambda d: d.groupBy("window_start", "event_type").agg(F.sum("count").alias("count")))
    assert total.agg(F.sum("count")).first()[0] == events.count() + 10


def test_light_readers_make_no_hashes(spark, sf_dir):
    from faultlines.operators.extract import segment_stats

    plan = segment_stats(analysis.recognised(X.logs(spark, sf_dir)))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan
