from __future__ import annotations

import pytest
from helpers import GOLDEN, golden_logs, logs, parse

from faultlines.operators.detect import detect_tool, select_parser
from faultlines.operators.extract import segment_stats
from faultlines.operators.group import group_rows, summary
from faultlines.plans import analysis

EXPECTED = {
    # total, groups, errors, warnings, fingerprint, category, code, parser
    "dotnet.mixed": (3, 3, 2, 1, "fp_cs0103_name_missing", "MissingSymbol", "CS0103", "dotnet-diagnostic-parser-v1"),
    "dotnet.single": (1, 1, 1, 0, "fp_cs0103_name_missing", "MissingSymbol", "CS0103", "dotnet-diagnostic-parser-v1"),
    "tsc.single": (1, 1, 1, 0, "fp_ts2304_name_missing", "MissingSymbol", "TS2304", "typescript-diagnostic-parser-v1"),
    "python.name": (1, 1, 1, 0, "fp_python_nameerror_not_defined", "MissingSymbol", "NameError", "python-traceback-parser-v1"),
    "npm.script": (1, 1, 1, 0, "fp_0c754d45b40bbd18", "Configuration", "NPM_MISSING_SCRIPT", "npm-diagnostic-parser-v1"),
    "vite.import": (1, 1, 1, 0, "fp_bc4808eddd0bfe23", "Dependency", "VITE_RESOLVE_IMPORT", "vite-diagnostic-parser-v1"),
}


def test_golden_logs(spark):
    segments = analysis.extracted(golden_logs(spark)).cache()
    sums = {r["log_id"]: r for r in summary(group_rows(segments)).collect()}
    assert set(sums) == set(GOLDEN)
    for name, (total, groups, errors, warnings, fp, category, code, parser) in EXPECTED.items():
        s = sums[name]
        assert (s["total_diagnostics"], s["group_count"], s["error_count"], s["warning_count"]) == (
            total, groups, errors, warnings,
        ), name
        assert s["parser_name"] == parser and s["parse_confidence"] == 1.0
        rows = segments.filter(segments.log_id == name).collect()
        assert any(r["fingerprint"] == fp and r["category"] == category and r["code"] == code for r in rows), name
    stats = {r["log_id"]: r["unparsed_segments"] for r in segment_stats(segments).collect()}
    assert set(stats.values()) == {0}


def test_dotnet_range_and_project(spark):
    text = (
        "C:\\src\\User.cs(8,19,8,23): warning CS8618: Non-nullable property 'Name' must contain a non-null value. "
        "[C:\\src\\App.csproj]"
    )
    (row,) = parse(spark, text, "dotnet")
    assert row["severity"] == "Warning" and row["category"] == "NullableSafety"
    assert tuple(row["location"]) == ("C:/src/User.cs", 8, 19, 8, 23)
    assert row["metadata"] == {"project": "C:/src/App.csproj"} and row["source"] == "Roslyn"


def test_dotnet_continuation_is_one_unparsed_segment(spark):
    (row,) = parse(spark, "app.csproj : error NU1101: Unable to find package X\n  See docs\r\nBuild FAILED.\n", "dotnet")
    assert not row["parsed"] and row["segment"].endswith("X\nSee docs")


def test_dotnet_sources_and_blank_lines(spark):
    rows = parse(
        spark,
        "CSC : error CS5001: Program does not contain a Main\n\n  stray\nfoo(1,2):error CS0103: The name 'x'\r\n"
        "error NETSDK1045: SDK too old\nx.csproj : warning NU1701: restored\n",
        "roslyn",
    )
    assert [r["source"] for r in rows] == ["CSC", "Roslyn", ".NET SDK", "NuGet"]
    assert [r["location"]["file_path"] if r["location"] else None for r in rows] == [None, "foo", None, "x.csproj"]


def test_typescript_code_frame_stays_in_snippet(spark):
    (row,) = parse(spark, "src/app.ts:5:13 - error TS2304: Cannot find name 'usre'.\n\n5 const value = usre;\n       ~~~~\nFound 1 error.")
    assert row["message"] == "Cannot find name 'usre'." and row["segment"].endswith("       ~~~~")
    (row,) = parse(spark, "src/m.ts:1:21 - error ts2307: Cannot find module '@/lib' or its corresponding type declarations.", "ts")
    assert row["code"] == "TS2307" and row["category"] == "Dependency"
    assert row["normalized_message"] == "Cannot find module '{module}' or its corresponding type declarations."


def test_python_last_frame_and_caret(spark):
    (row,) = parse(spark, GOLDEN["python.name"][1])
    assert row["location"]["line"] == 5 and row["metadata"] == {"frameCount": "2", "function": "run"}
    text = 'Traceback (most recent call last):\n  File "script.py", line 1\n    if True print("hello")\n            ^^^^^\nSyntaxError: invalid syntax'
    (row,) = parse(spark, text)
    assert row["category"] == "Syntax" and row["location"]["column"] == 13 and row["location"]["line"] == 1


def test_python_two_tracebacks_and_no_header(spark):
    two = GOLDEN["python.name"][1] + "noise\n" + GOLDEN["python.name"][1].replace("NameError: name", "no exception")
    rows = parse(spark, two)
    assert [r["parsed"] for r in rows] == [True, False]
    (row,) = parse(spark, "some output\nValueError\n", "py")
    assert row["code"] == "ValueError" and row["message"] == "ValueError" and row["normalized_message"] == "ValueError"
    assert [r["segment"] for r in parse(spark, "nothing here", "python")] == [None]


def test_npm_dependency_tree(spark):
    text = "npm ERR! code ERESOLVE\nnpm ERR! ERESOLVE unable to resolve dependency tree\nnpm ERR! path C:\\app\\package.json"
    (row,) = parse(spark, text)
    assert (row["code"], row["category"]) == ("ERESOLVE", "Dependency")
    assert row["normalized_message"] == "unable to resolve dependency tree"
    assert row["metadata"] == {"path": "C:/app/package.json"}


def test_vite_missing_export_and_fallback(spark):
    text = (
        "vite v5.4.8 building for production...\nerror during build:\n"
        'src/routes/index.ts (7:10): "missingThing" is not exported by "src/lib/api.ts", imported by "src/routes/index.ts".\n'
    )
    (row,) = parse(spark, text)
    assert row["code"] == "VITE_MISSING_EXPORT" and tuple(row["location"])[:3] == ("src/routes/index.ts", 7, 10)
    (row,) = parse(spark, "vite v5\nplugin failed\nfile: /src/x.ts:3:4", "vite")
    assert (row["code"], row["message"]) == ("VITE_BUILD_ERROR", "plugin failed")
    assert tuple(row["location"])[:3] == ("/src/x.ts", 3, 4)


@pytest.mark.parametrize(
    ("content", "hint", "tool"),
    [
        ("anything at all", "dotnet", "DotNet"),
        ("Program.cs(1,1): error CS0103: x", None, "DotNet"),
        ('vite v5\nerror during build:\nnpm ERR! code ELIFECYCLE', None, "Vite"),
        ('npm ERR! Missing script: "build"', None, "Npm"),
        ("this is just some random text", None, "Unknown"),
    ],
)
def test_detection(spark, content, hint, tool):
    row = detect_tool(logs(spark, {"x": content}, hint=hint)).first()
    assert row["tool_detected"] == tool and row["was_explicit_hint"] == (hint is not None)


def test_parser_fallback(spark):
    texts = {"py": "boom\nKeyError: 'k'\n", "none": "plain", "cs": "see CS123 for details"}
    rows = {r["log_id"]: r for r in select_parser(detect_tool(logs(spark, texts))).collect()}
    assert rows["py"]["parser_tool"] == "Python" and rows["py"]["tool_detected"] == "Unknown"
    assert rows["cs"]["parser_tool"] == "DotNet"
    assert rows["none"]["parser_tool"] is None and "unknown" in rows["none"]["failure_reason"]


def test_long_segments_do_not_overflow(spark):
    """Segments near the size limit: repetition in the segment regexes has to be iterative."""
    lines = 8_000
    dotnet = "a.cs(1,2): error CS0103: x\n" + "  more text here\n" * lines
    tsc = "a.ts(1,2): error TS2304: x\n" + "\n  code here\n" * lines
    vite = "x" * 200_000 + "\nvite v5\n"
    segments = analysis.extracted(logs(spark, {"d": dotnet, "t": tsc, "v": vite})).collect()
    by_log = {r["log_id"]: r for r in segments}
    assert len(by_log["d"]["segment"].split("\n")) == lines + 1 and not by_log["d"]["parsed"]
    assert by_log["t"]["parsed"] and by_log["v"]["code"] == "VITE_BUILD_ERROR"
