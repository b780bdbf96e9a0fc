from __future__ import annotations

import re

import pytest

from faultlines.operators import history as H
from faultlines.operators import text_index as T

COLUMNS = (
    "analysis_id long, narrative_summary string, group_summaries array<string>, next_steps array<string>, narrative_reason string, "
    "project_name string, repository string, narrative_provider string, narrative_model string, tool_detected string, "
    "narrative_source string, created_at string"
)


def _row(i, summary, groups=None, steps=None, reason=None, project=None):
    return (i, summary, groups, steps, reason, project, "repo", None, None, ["DotNet", "Npm"][i % 2], "ai", f"2024-01-{1 + i % 28:02d}")


@pytest.fixture(scope="module")
def narratives(spark):
    rows = [
        _row(1, "Name ERROR in the build"), _row(2, None, ["first group", "Second error"]), _row(3, "", None, ["run the build"]),
        _row(4, "errors\nover\nlines", project="Error Project"), _row(5, None, None, None, "terror"), _row(6, None),
        _row(7, "smile \U0001f600\U0001f601 ends", None), _row(7, "the same id, error again"), _row(8, "İstanbul error ẞtraße"),
        _row(9, "er"), _row(10, "err or"), _row(11, "aaaaaaaaaaaaaaaa"), _row(12, "word " * 20000 + "needle"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def index(spark, narratives, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    T.write_index(narratives, path)
    return T.open_index(spark, path)


TEXTS = ["error", " ERROR ", "er", "e", "r\no", "\U0001f600\U0001f601 e", "\U0001f601", "aaaa", "no such text", "errors over", "needle", "straße", "group second"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_rows_as_without_the_index(narratives, index, text):
    plain = H.search_narratives(narratives, text, 50).collect()
    assert T.search(narratives, index, text, 50).collect() == plain


def test_filters_and_blank_text(narratives, index):
    plain = H.search_narratives(narratives, "error", 3, tool="Npm").collect()
    assert plain and T.search(narratives, index, "error", 3, tool="Npm").collect() == plain
    with pytest.raises(ValueError):
        T.search(narratives, index, "  ", 3)


def test_reads_only_its_folders(narratives, index):
    found = T.candidates(index, "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan)
    assert [r["analysis_id"] for r in found.collect()] == [12]


def test_empty_history(spark, narratives, tmp_path):
    none = narratives.limit(0)
    T.write_index(none, str(tmp_path))
    index = T.open_index(spark, str(tmp_path))
    assert T.search(none, index, "error", 5).collect() == []
