"""Every registered query that has checking SQL gives the same rows at the smallest scale."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

QUICK = [
    "src_validate", "src_context", "det_parser", "seg_dotnet", "seg_tsc", "seg_stats", "ext_all", "nrm_python", "grp_fingerprint",
    "rnk_candidates", "nar_summary", "prj_single", "rul_apply", "rul_related", "rul_scope", "rul_match_many", "rul_match_regex", "pat_merge", "his_related", "sim_score", "sim_search", "kno_similar", "kno_merge", "src_rejected",
    "sink_snapshot", "sink_gate", "his_get", "prj_build_log", "prv_retention", "prv_retention_apply",
    "prv_redact_raw", "prv_delete", "tel_metric_tags", "enr_narrative", "str_telemetry", "str_windows", "nar_search", "nar_search_index",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, con, sf_dir, name):
    ok, text = check.compare(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_entry_and_coverage(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
