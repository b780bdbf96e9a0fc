"""The persisted history: analysed logs written as tables, then queried as tables.

Stages are cut by written tables in the shared folder: each later stage reads the one before, so no log is
parsed twice and a lost executor costs only the running stage.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlines.operators import patterns as P
from faultlines.operators import rules as R
from faultlines.operators import text_index
from faultlines.operators.extract import diagnostics, with_order_index
from faultlines.operators.group import groups, group_rows
from faultlines.operators.history import stored_narratives
from faultlines.operators.privacy import stored_raw_content
from faultlines.plans import analysis
from faultlines.sources import intake, sinks

TABLES = ["segments", "candidates", "analyses", "diagnostics", "groups", "rule_matches", "pattern_state", "snapshots"]


class StoredTables(Mapping):
    """The tables below ``path`` by name: each is written when it is first asked for, after those that it derives from, and
    read from there on. Whoever asks for all of them, as ``build_store`` does, gets the whole history.

    Admission writes the requests once, rejected ones apart; what follows reads the accepted ones from there, so logs
    are assembled once.
    """

    def __init__(self, logs: DataFrame, rules: DataFrame, path: str, by_date: bool = False, unit: str = "month"):
        self._logs, self._rules, self._path, self._unit = logs, rules, path, unit
        self._created = "created_at" if by_date else None
        self._kept: DataFrame | None = None
        self._tables: dict[str, DataFrame] = {}

    def __iter__(self):
        return iter([*TABLES, "patterns"])

    def __len__(self) -> int:
        return len(TABLES) + 1

    def __getitem__(self, name: str) -> DataFrame:
        if name == "patterns":
            return P.patterns(self["pattern_state"])
        if name not in TABLES:
            raise KeyError(name)
        if name not in self._tables:
            getattr(self, f"_write_{name}")(f"{self._path}/{name}")
            self._tables[name] = self._logs.sparkSession.read.parquet(f"{self._path}/{name}")
        return self._tables[name]

    def written(self) -> set[str]:
        return set(self._tables)

    def _accepted(self) -> DataFrame:
        if self._kept is None:
            self._kept = sinks.persisted_only(intake.admit(self._logs, f"{self._path}/requests").accepted)
        return self._kept

    def _found(self) -> DataFrame:
        """Groups by log_id: those written, or from the segments where nobody has asked for the table."""
        if "groups" in self._tables:
            return self["groups"].withColumnRenamed("analysis_id", "log_id")
        return groups(group_rows(self["segments"])).drop("members", "latest")

    def _write_segments(self, path: str) -> None:
        sinks.write_table(analysis.extracted(self._accepted()), path)

    def _write_candidates(self, path: str) -> None:
        segments = self["segments"]
        sinks.write_table(analysis.with_empty_logs(analysis.applied(segments, self._rules), segments), path)

    def _write_analyses(self, path: str) -> None:
        candidates, facts = self["candidates"], sinks.log_facts(stored_raw_content(self._accepted()))
        sinks.write_table(sinks.analysis_rows(analysis.narrated(candidates), facts), path, "created_at", unit=self._unit)

    def _write_diagnostics(self, path: str) -> None:
        ordered = with_order_index(diagnostics(self["segments"]))
        sinks.write_table(ordered.withColumnRenamed("log_id", "analysis_id"), path, self._created, unit=self._unit)

    def _write_groups(self, path: str) -> None:
        sinks.write_table(self._found().withColumnRenamed("log_id", "analysis_id"), path, self._created, unit=self._unit)

    def _write_rule_matches(self, path: str) -> None:
        """Both kinds of match read the narrow stored rows; rules may be inlined or joined, see ``rules``."""
        segments, found = self["segments"], self._found()
        applications = R.match_diagnostics(segments.filter("parsed"), self._rules).unionByName(R.match_groups(found, self._rules))
        times = segments.groupBy("log_id").agg(F.first("created_at").alias("applied_at"))
        sinks.write_table(applications.join(times, "log_id").withColumnRenamed("log_id", "analysis_id"), path)

    def _write_pattern_state(self, path: str) -> None:
        sinks.write_table(P.fold_patterns(P.pattern_rows(self["candidates"])), path)

    def _write_snapshots(self, path: str) -> None:
        for name in ("analyses", "diagnostics", "groups", "candidates", "rule_matches"):
            self[name]
        sinks.write_table(_documents(self._logs.sparkSession, self._path, self._rules), path, self._created, unit=self._unit)


def build_store(logs: DataFrame, rules: DataFrame, path: str, by_date: bool = False, unit: str = "month", search_index: bool = False) -> None:
    """Analyses the accepted logs that are to be persisted and writes all tables below ``path``.

    ``search_index`` adds the trigram index of the narratives, for ``text_index.search``.
    """
    tables = StoredTables(logs, rules, path, by_date, unit)
    for name in TABLES:
        tables[name]
    if search_index:
        text_index.write_index(stored_narratives(tables["analyses"]), f"{path}/narrative_index")


def _documents(spark: SparkSession, path: str, rules: DataFrame) -> DataFrame:
    """Snapshots of all analyses from the written tables."""

    def stored(name: str, key: str = "analysis_id") -> DataFrame:
        return spark.read.parquet(f"{path}/{name}").withColumnRenamed(key, "log_id")

    matches = R.match_audit(stored("rule_matches"), rules, F.col("applied_at")).withColumnRenamed("log_id", "analysis_id")
    candidates = stored("candidates").filter(F.col("fingerprint").isNotNull()).withColumnRenamed("log_id", "analysis_id")
    return sinks.snapshots(
        spark.read.parquet(f"{path}/analyses"), sinks.diagnostic_rows(stored("diagnostics")), sinks.group_rows(stored("groups")), candidates, matches
    )


def open_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    tables["patterns"] = P.patterns(tables["pattern_state"])
    return tables
