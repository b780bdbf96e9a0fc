from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from faultlines.operators import history as H
from faultlines.operators import patterns as P
from faultlines.operators import privacy as V
from faultlines.plans import analysis, queries as Q
from faultlines.sources import fixtures as X


def test_related_equals_brute_force(spark):
    """One fingerprint on every analysis, so its list is cut to the newest few before the join."""
    rows = [(i, ["hot"] + [f"f{i % 7}"] * (i % 2), f"2024-01-{1 + i % 28:02d}", "p" if i % 3 else None, "r") for i in range(120)]
    a = spark.createDataFrame(rows, "analysis_id long, fingerprints array<string>, created_at string, project_name string, repository string")
    requests = a.withColumnRenamed("analysis_id", "request_id")
    got = defaultdict(list)
    for r in H.related_analyses(requests, a, 3).orderBy("position").collect():
        got[r["request_id"]].append((r["analysis_id"], tuple(r["matching_fingerprints"])))
    for rid, fps, _, project, repo in rows:
        hits = [
            (created, aid, tuple(sorted(set(fps) & set(other))))
            for aid, other, created, p, q in rows
            if aid != rid and set(fps) & set(other) and (project is None or p == project) and q == repo
        ]
        hits.sort(key=lambda h: h[1])
        hits.sort(key=lambda h: h[0], reverse=True)
        assert got[rid] == [(aid, m) for _, aid, m in hits[:3]]


def test_similar_equals_brute_force(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echo"]
    rows = []
    for i in range(150):
        code = ["C1", "C2", None][i % 3] if i % 10 else "c1"
        text = " ".join(words[(i * k) % 5] for k in range(1, 2 + i % 4))
        rows.append((i // 2, i % 2, f"2024-01-{1 + i % 27:02d}", "DotNet", f"fp{code}{text}", code, ["A", "B"][i % 2], text, text, "p", "r"))
    d = spark.createDataFrame(rows, "analysis_id long, seg int, created_at string, tool_kind string, fingerprint string, code string, category string, normalized_message string, message string, project_name string, repository string")
    # all analyses of one tool ask at once
    asked = {}
    for r in rows:
        q = asked.setdefault(r[0], {"f": [], "c": [], "k": [], "t": set()})
        q["f"].append(r[4]), q["k"].append(r[6]), q["t"].update(r[7].split())
        if r[5]:
            q["c"].append(r[5])
    requests = spark.createDataFrame(
        [(k, "DotNet", v["f"], v["c"], v["k"], sorted(v["t"]), "p", "r") for k, v in asked.items()],
        "request_id long, tool_kind string, fingerprints array<string>, codes array<string>, categories array<string>, query_tokens array<string>, project_name string, repository string",
    )
    got = defaultdict(list)
    for r in H.similar_analyses(requests, d, 3, H.SCOPE).orderBy("position").collect():
        got[r["request_id"]].append((r["analysis_id"], r["match_type"], tuple(r["matching_fingerprints"])))
    for rid, q in asked.items():
        entries = []
        for aid, seg, created, _, fp, code, cat, msg, _, _, _ in rows:
            if aid == rid:
                continue
            fh, ch = fp in q["f"], code is not None and code.lower() in [c.lower() for c in q["c"]]
            own = set(msg.split())
            ov = len(own & q["t"])
            s = (0.72 if fh else 0.0) + (0.55 if ch else 0.0) + (0.15 if cat in q["k"] else 0.0)
            s += 0.25 * ov / max(len(own), len(q["t"])) if ov else 0.0
            s = min(s, 0.96)
            if s >= 0.45:
                kind = "fingerprint" if fh else "diagnostic-code" if ch else "message-similarity"
                entries.append((-s, seg, created, aid, kind, fp))
        best = {}
        for e in entries:
            if e[3] not in best or e[:2] < best[e[3]][:2]:
                best[e[3]] = e
        order = sorted(best.values(), key=lambda e: e[3])
        order.sort(key=lambda e: e[2], reverse=True)
        order.sort(key=lambda e: e[0])
        want = [(e[3], e[4], tuple(sorted({x[5] for x in entries if x[3] == e[3]}))) for e in order[:3]]
        assert got[rid] == want


def test_similar_without_project_or_repository(spark):
    """Repeated requests are answered once, and a blank scope is no filter."""
    rows = [(i, 0, f"2024-01-{1 + i:02d}", "DotNet", f"f{i % 2}", "C1", "A", "alpha", "alpha", f"p{i % 3}", f"r{i % 2}", i) for i in range(24)]
    d = spark.createDataFrame(rows, "analysis_id long, seg int, created_at string, tool_kind string, fingerprint string, code string, category string, normalized_message string, message string, project_name string, repository string, diagnostic_id long")
    asked = [(r[0], "DotNet", [r[4]], [], ["A"], ["alpha"], [r[9], None, ""][r[0] % 3], [r[10], None][r[0] // 3 % 2]) for r in rows]
    requests = spark.createDataFrame(asked, "request_id long, tool_kind string, fingerprints array<string>, codes array<string>, categories array<string>, query_tokens array<string>, project_name string, repository string")
    similar, scored = defaultdict(list), defaultdict(set)
    for r in H.similar_analyses(requests, d, 3).orderBy("position").collect():
        similar[r["request_id"]].append(r["analysis_id"])
    for r in H.scored_diagnostics(requests, d).collect():
        scored[r["request_id"]].add(r["diagnostic_id"])
    for i, _, (f,), _, _, _, project, repository in asked:
        hits = [r[0] for r in rows if r[4] == f and (not project or r[9] == project) and (not repository or r[10] == repository)]
        assert scored[i] == set(hits)
        assert similar[i] == sorted((x for x in hits if x != i), reverse=True)[:3]


def test_pattern_merge_is_associative(spark, sf_dir):
    rows = P.pattern_rows(analysis.applied(analysis.extracted(X.logs(spark, sf_dir)), X.rules(spark))).cache()
    whole = sorted(map(str, P.patterns(P.fold_patterns(rows)).collect()))
    parts = [P.fold_patterns(rows.filter(F.pmod(F.xxhash64("first"), F.lit(3)) == i)) for i in range(3)]
    merged = P.merge_patterns(P.merge_patterns(parts[2], parts[0]), parts[1])
    assert sorted(map(str, P.patterns(merged).collect())) == whole and len(whole) > 10


def test_retention_counts(spark):
    rows = [(1, "raw", True, "2024-01-01"), (2, "raw", True, "2024-03-01"), (3, None, False, "2023-01-01"), (4, "raw", False, "2024-03-20")]
    a = spark.createDataFrame(rows, "analysis_id int, raw_content string, raw_content_redacted boolean, day string").withColumn(
        "created_at", F.to_timestamp("day")
    )
    now = F.lit("2024-03-22 00:00:00").cast("timestamp")
    assert tuple(V.retention_report(a, now, 7, 90).first()) == (2, 1)
    assert tuple(V.retention_report(a, now, None, 0).first()) == (0, 0)
    left = {r["analysis_id"]: r for r in V.apply_retention(a, now, 7, 90).collect()}
    assert set(left) == {1, 2, 4} and left[4]["raw_content"] == "raw" and left[1]["raw_content"] is None
    purged = {r["analysis_id"]: r["raw_content"] for r in V.purge_raw(a, a.filter("analysis_id = 4")).collect()}
    assert purged[4] is None and purged[1] == "raw"


def test_snapshot_and_rebuilt_documents(spark, sf_dir):
    found = Q.his_get(spark, sf_dir)
    h = Q.history(spark, sf_dir)
    assert found.count() == h["analyses"].count()
    documents = Q.sink_snapshot(spark, sf_dir)
    assert documents.filter(F.col("document").contains("narrative_summary")).count() > 0
    view = Q.prj_build_log(spark, sf_dir).first()
    assert view["diagnostics"] <= 0


def test_streams_equal_batch(spark, sf_dir):
    batch = sorted(tuple(r) for r in Q.str_rule_hits(spark, sf_dir).collect())
    assert batch == sorted(tuple(r) for r in Q.rul_record(spark, sf_dir).collect())
    columns = ["log_id", "diagnostic_id", "code", "category", "fingerprint"]
    streamed = sorted(tuple(r) for r in Q.str_extract(spark, sf_dir).select(columns).collect())
    assert streamed == sorted(tuple(r) for r in Q.ext_all(spark, sf_dir).select(columns).collect())
    assert sorted(map(str, Q.str_patterns(spark, sf_dir).collect())) == sorted(map(str, Q.pat_fold(spark, sf_dir).collect()))
