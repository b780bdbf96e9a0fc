"""Raw-content policy, purge, deletion and retention. Rows are never updated in place: tables, or the partitions that a
retention run touches, are written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlines.functions.redact import redact_raw
from faultlines.functions.text import text_lit
from faultlines.sources.sinks import DATE


def effective_days(days: int | None) -> int | None:
    """Non-positive retention means no retention."""
    return days if days is not None and days > 0 else None


def stored_raw_content(
    logs: DataFrame, storage_enabled: bool = True, redact_on_write: bool = True
) -> DataFrame:
    """Adds raw_content and raw_content_redacted from content, store_raw and the policy."""
    wanted = F.coalesce(F.col("store_raw"), F.lit(False)) & F.lit(storage_enabled)
    filtered = redact_raw(F.col("content")) if redact_on_write else F.col("content")
    return logs.withColumn("raw_content", F.when(wanted, filtered)).withColumn(
        "raw_content_redacted",
        F.coalesce(F.col("raw_content").isNotNull() & (F.col("raw_content") != F.col("content")), F.lit(False)),
    )


def purge_raw(analyses: DataFrame, ids: DataFrame) -> DataFrame:
    """Raw content removed for the given ids; all other columns and rows stay."""
    marked = ids.select("analysis_id").distinct().withColumn("_purge", F.lit(True))
    hit = F.col("_purge").isNotNull() & F.col("raw_content").isNotNull()
    return (
        analyses.join(marked, "analysis_id", "left")
        .withColumns(
            {
                "raw_content_redacted": F.when(hit, F.lit(False)).otherwise(F.col("raw_content_redacted")),
                "raw_content": F.when(hit, text_lit(None)).otherwise(F.col("raw_content")),
            }
        )
        .drop("_purge")
    )


def delete_analyses(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Analyses and their child rows without the given ids. Pattern counts are kept as they are."""
    gone = ids.select("analysis_id").distinct()
    return {name: table.join(gone, "analysis_id", "left_anti") for name, table in tables.items()}


def cutoff(as_of: Column, days: int) -> Column:
    return as_of - F.make_interval(days=F.lit(days))


def due(analyses: DataFrame, as_of: Column, raw_days: int | None, analysis_days: int | None) -> DataFrame:
    """Rows that a retention run may touch. On a dated table the filter is one on its partitions too."""
    days = [d for d in (effective_days(raw_days), effective_days(analysis_days)) if d]
    if not days:
        return analyses.filter(F.lit(False))
    newest = cutoff(as_of, min(days))
    if DATE in analyses.columns:
        analyses = analyses.filter(F.col(DATE) <= F.to_date(newest))
    return analyses.filter(F.col("created_at") < newest)


def retention_report(
    analyses: DataFrame, as_of: Column, raw_days: int | None, analysis_days: int | None
) -> DataFrame:
    """How many rows a retention run purges and deletes; a purge is counted before the deletion."""
    purge, delete = _marks(as_of, effective_days(raw_days), effective_days(analysis_days))
    return due(analyses, as_of, raw_days, analysis_days).agg(
        F.count_if(purge).alias("raw_content_purged"), F.count_if(delete).alias("analyses_deleted")
    )


def _marks(as_of: Column, raw_days: int | None, analysis_days: int | None) -> tuple[Column, Column]:
    """Whether a row's raw content is to be purged, and whether the row is to be deleted."""
    created = F.col("created_at")
    purge = F.col("raw_content").isNotNull() & (created < cutoff(as_of, raw_days)) if raw_days else F.lit(False)
    return purge, created < cutoff(as_of, analysis_days) if analysis_days else F.lit(False)


def retain(spark: SparkSession, path: str, as_of: Column, raw_days: int | None, analysis_days: int | None, scratch: str) -> list[str]:
    """A retention run over the dated table at ``path``, in place; returns the partitions that it rewrote or removed.

    Only partitions that hold a row to purge or to delete are read whole and written again, so a daily run costs the days that
    have come due since the last one. What is left of them is first written to ``scratch`` and then replaces them
    partition by partition; a run that is repeated finds nothing more to do.
    """
    table = spark.read.parquet(path)
    purge, delete = _marks(as_of, effective_days(raw_days), effective_days(analysis_days))
    touched = [r[0] for r in due(table, as_of, raw_days, analysis_days).filter(purge | delete).select(DATE).distinct().collect()]
    if not touched:
        return []
    own = table.filter(F.col(DATE).isin(touched))
    apply_retention(own, as_of, raw_days, analysis_days).write.mode("overwrite").partitionBy(DATE).parquet(scratch)
    left = spark.read.schema(table.schema).parquet(scratch)
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(path)
    kept = {r[0] for r in left.select(DATE).distinct().collect()}
    for gone in (d for d in touched if d not in kept):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{DATE}={gone}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return sorted(str(d) for d in touched)


def apply_retention(
    analyses: DataFrame, as_of: Column, raw_days: int | None, analysis_days: int | None
) -> DataFrame:
    """Analyses after a retention run: narrow, a filter on created_at that reaches the scan."""
    raw_days, analysis_days = effective_days(raw_days), effective_days(analysis_days)
    result = analyses
    if analysis_days:
        result = result.filter(~(F.col("created_at") < cutoff(as_of, analysis_days)))
    if raw_days:
        hit = F.col("raw_content").isNotNull() & (F.col("created_at") < cutoff(as_of, raw_days))
        result = result.withColumns(
            {
                "raw_content_redacted": F.when(hit, F.lit(False)).otherwise(F.col("raw_content_redacted")),
                "raw_content": F.when(hit, text_lit(None)).otherwise(F.col("raw_content")),
            }
        )
    return result


def expiry(created_at: Column, days: int | None) -> Column:
    """When a row expires; null without retention."""
    days = effective_days(days)
    return F.lit(None).cast("timestamp") if days is None else created_at + F.make_interval(days=F.lit(days))
