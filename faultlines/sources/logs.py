"""Log tables: readers, assembly from chunks, request checks, context and content hash.

A log row has: log_id, content, input_type, tool_hint, project_name, repository, created_at and,
where a job stores results, persist and store_raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlines import constants as C
from faultlines.functions.text import is_blank, longer_than, lookup, normalize_newlines, rtrim_lines, utf16_length, ws_trim
from faultlines.operators.sizing import broadcast_if_small

LOG_SCHEMA = T.StructType(
    [
        T.StructField("log_id", T.StringType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("input_type", T.StringType()),
        T.StructField("tool_hint", T.StringType()),
        T.StructField("project_name", T.StringType()),
        T.StructField("repository", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("persist", T.BooleanType()),
        T.StructField("store_raw", T.BooleanType()),
    ]
)


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file; the path is the log id and the file time the creation time."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("log_id"),
        F.col("value").alias("content"),
        F.lit("BuildLog").alias("input_type"),
        F.lit(None).cast("string").alias("tool_hint"),
        F.lit(None).cast("string").alias("project_name"),
        F.lit(None).cast("string").alias("repository"),
        F.col("_metadata.file_modification_time").alias("created_at"),
    )


def read_log_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader if fmt in ("parquet", "orc") else reader.schema(LOG_SCHEMA)).load(path)


def oversize_logs(chunks: DataFrame, chunk_length: Column, max_chars: int = C.MAX_CONTENT_CHARS) -> DataFrame:
    """Ids of logs over the size limit, from a partial aggregation of their chunks' lengths.

    The limit is exact: it counts the UTF-16 units that the joined content would have, however it is chunked. Such logs are rejected
    by the request check, so they are taken out before any step that brings all chunks of one log together.
    """
    total = F.sum(chunk_length) + F.count(F.lit(1)) - 1
    return chunks.groupBy("log_id").agg(total.alias("min_chars")).filter(F.col("min_chars") > max_chars).select("log_id")


def assemble_logs(chunks: DataFrame, max_chars: int = C.MAX_CONTENT_CHARS) -> DataFrame:
    """chunks(log_id, n, chunk) -> logs(log_id, content); over-long logs are left to ``oversize_logs``."""
    too_long = broadcast_if_small(oversize_logs(chunks, utf16_length(F.col("chunk")), max_chars))
    return join_chunks(chunks.join(too_long, "log_id", "left_anti"))


def join_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of one log in order, joined by newlines; every log must be within the size limit."""
    ordered = F.sort_array(F.collect_list(F.struct("n", "chunk")))
    return chunks.groupBy("log_id").agg(
        F.array_join(F.transform(ordered, lambda c: c["chunk"]), "\n").alias("content")
    )


def parse_tool(value: Column) -> Column:
    """Tool kind for an accepted spelling, null otherwise."""
    return lookup(F.lower(ws_trim(value)), C.TOOL_ALIASES)


def violations(requests: DataFrame) -> Column:
    """All violations of a request, as an array of (field, message); empty for an accepted one."""
    content, tool = F.col("content"), F.col("tool_hint")
    return F.array_compact(
        F.array(
            F.when(is_blank(content) & ~_too_long(requests), _error("content", "Content is required.")).when(
                _too_long(requests),
                _error("content", f"Content must be {C.MAX_CONTENT_CHARS} characters or fewer."),
            ),
            F.when(
                ~is_blank(tool) & parse_tool(tool).isNull(),
                _error("tool", "Tool must be one of: dotnet, typescript, npm, vite, python, generic."),
            ),
            F.when(
                F.col("store_raw") & ~F.col("persist"),
                _error("options.persistRawContent", "PersistRawContent can only be true when Persist is also true."),
            ),
        )
    )


def request_errors(requests: DataFrame) -> DataFrame:
    """One row per violation: log_id, field, message."""
    return requests.select("log_id", F.explode(violations(requests)).alias("e")).select("log_id", "e.field", "e.message")


def _too_long(requests: DataFrame) -> Column:
    """Over the limit by content, or by the flag of a log whose content was never assembled."""
    flagged = F.coalesce("too_long", F.lit(False)) if "too_long" in requests.columns else F.lit(False)
    return flagged | F.coalesce(longer_than(F.col("content"), C.MAX_CONTENT_CHARS), F.lit(False))


def _error(field: str, message: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))


def accepted(requests: DataFrame) -> DataFrame:
    """Rows without a violation; the same checks as ``request_errors``, kept narrow (no join)."""
    content, tool = F.col("content"), F.col("tool_hint")
    return requests.filter(
        ~is_blank(content)
        & ~_too_long(requests)
        & (is_blank(tool) | parse_tool(tool).isNotNull())
        & ~(F.coalesce(F.col("store_raw"), F.lit(False)) & ~F.coalesce(F.col("persist"), F.lit(False)))
    )


def build_context(fields: dict[str, Column]) -> Column:
    """Context map of trimmed, non-blank values; null when nothing is left."""
    entries = [part for name, value in fields.items() for part in (F.lit(name), ws_trim(value))]
    kept = F.map_filter(F.create_map(*entries), lambda k, v: ~is_blank(v))
    return F.when(F.size(kept) > 0, kept)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def line_count(content: Column) -> Column:
    newlines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(F.length(content) == 0, F.lit(0)).otherwise(newlines + 1)


def log_lines(logs: DataFrame) -> DataFrame:
    """Numbered, right-trimmed lines: log_id, n, line."""
    lines = F.split(rtrim_lines(normalize_newlines(F.col("content"))), "\n")
    return logs.select("log_id", F.posexplode(lines).alias("n", "line"))
