"""Streaming forms.

Per-log steps run in ``foreachBatch``, so a micro-batch reuses the batch code. Running tables are kept as one delta for
each epoch, the associative fold of its rows: an epoch that is replayed writes its delta again, so nothing is counted
twice, and a batch costs what it holds, not what went before. Readers fold the deltas; ``compacted`` writes the fold
of all closed epochs to another folder, for readers of a long history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultlines.operators.extract import diagnostics
from faultlines.operators.patterns import fold_patterns, pattern_rows
from faultlines.operators.rules import record_hits
from faultlines.plans import analysis

WINDOW_SECONDS = 86_400


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def delta_stream(stream: DataFrame, out: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Writes ``fold`` of every micro-batch to a folder of its epoch."""

    def each(batch: DataFrame, epoch: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deltas(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all epochs written so far, whoever wrote them and however often the stream was started."""
    return spark.read.parquet(out).drop("epoch")


def compacted(spark: SparkSession, out: str, target: str, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes the fold of all deltas to ``target`` and reads it back; ``fold`` merges deltas."""
    fold(deltas(spark, out)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def extract_stream(logs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Arriving logs -> diagnostics."""
    return delta_stream(logs, out, checkpoint, lambda batch: diagnostics(analysis.extracted(batch)))


def candidate_stream(logs: DataFrame, rules: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Arriving logs -> ranked candidates after rules."""
    return delta_stream(logs, out, checkpoint, lambda batch: analysis.applied(analysis.extracted(batch), rules))


def pattern_stream(candidates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Arriving candidates -> pattern deltas; ``pattern_state`` folds them."""
    return delta_stream(candidates, out, checkpoint, lambda batch: fold_patterns(pattern_rows(batch)))


def pattern_state(spark: SparkSession, out: str) -> DataFrame:
    return fold_patterns(deltas(spark, out))


def _hits(times: Column, counts: Column) -> list[Column]:
    return [F.sum(counts).alias("n"), F.max(times).alias("at")]


def rule_hit_stream(applications: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Arriving rule applications -> hits of each rule; ``rule_hits`` adds them to the rules as they are when read."""
    return delta_stream(applications, out, checkpoint, lambda batch: batch.groupBy("rule_id").agg(*_hits(F.col("applied_at"), F.lit(1))))


def rule_hits(spark: SparkSession, rules: DataFrame, out: str) -> DataFrame:
    return record_hits(rules, deltas(spark, out).groupBy("rule_id").agg(*_hits(F.col("at"), F.col("n"))))


def window_start(time: Column) -> Column:
    """Start of the tumbling window of a time. The window function of Spark would drop rows without a time."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(time.cast("timestamp")) / WINDOW_SECONDS) * WINDOW_SECONDS)


def _window_end(start: Column) -> Column:
    return start + F.make_interval(secs=F.lit(WINDOW_SECONDS))


def telemetry_stream(events: DataFrame, out: str, checkpoint: str, by: str = "event_type") -> StreamingQuery:
    """Counts per tumbling window. No watermark: a late row is one more in its window's delta, so none is lost and no
    state is held between batches."""

    def fold(batch: DataFrame) -> DataFrame:
        return batch.groupBy(window_start(F.col("ts")).alias("window_start"), by).agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("total"))

    return delta_stream(events, out, checkpoint, fold)


def telemetry_table(spark: SparkSession, out: str, by: str = "event_type") -> DataFrame:
    return deltas(spark, out).groupBy("window_start", by).agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


# ---------------------------------------------------------------- windows that close


def window_stream(events: DataFrame, out: str, checkpoint: str, delay: str, by: str = "event_type") -> StreamingQuery:
    """Tumbling windows behind an event-time watermark, late rows kept apart.

    The watermark of a batch is the greatest time of all batches before it, less ``delay``; a window whose end it has
    reached is closed and changes no more. Spark's own watermark drops rows of closed windows without a trace, so each
    epoch writes its greatest time to ``marks``, the fold of its rows in open windows to ``windows`` and its other rows,
    whole, to ``late``. An epoch that is replayed meets the marks of the same epochs and writes the same files again.
    Rows without a time are on time, in a window without a start that never closes.
    """
    spark = events.sparkSession
    spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS at").write.mode("overwrite").parquet(f"{out}/marks/epoch=-1")

    def each(batch: DataFrame, epoch: int) -> None:
        here = batch.sparkSession
        mark = here.read.parquet(f"{out}/marks").filter(F.col("epoch") < epoch).agg(F.max("at").alias("at"))
        before = mark.select((F.col("at") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
        placed = batch.withColumn("window_start", window_start(F.col("ts"))).crossJoin(F.broadcast(before))
        late = F.coalesce(_window_end(F.col("window_start")) <= F.col("_mark"), F.lit(False))
        rows = placed.withColumn("_late", late).drop("_mark").persist()
        try:
            _counted(rows.filter(~F.col("_late")), by).write.mode("overwrite").parquet(f"{out}/windows/epoch={epoch}")
            rows.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{out}/late/epoch={epoch}")
            # the mark last: later epochs see it only when the rows are written
            rows.agg(F.max(F.col("ts").cast("timestamp")).alias("at")).write.mode("overwrite").parquet(f"{out}/marks/epoch={epoch}")
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _counted(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy("window_start", by).agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("total"))


def window_table(spark: SparkSession, out: str, delay: str, by: str = "event_type") -> DataFrame:
    """Per window: whether it is closed, its rows that came in time and, apart, those that came after it closed."""
    none = F.lit(None)
    in_time = deltas(spark, f"{out}/windows").withColumns({"late": none.cast("long"), "late_total": none.cast("double")})
    after = _counted(deltas(spark, f"{out}/late"), by).select(
        "window_start", by, none.cast("long").alias("count"), none.cast("double").alias("total"), F.col("count").alias("late"), F.col("total").alias("late_total")
    )
    sums = {"on_time": "count", "on_time_total": "total", "late": "late", "late_total": "late_total"}
    zero = {name: F.coalesce(F.sum(column), F.lit(0)).alias(name) for name, column in sums.items()}
    folded = in_time.unionByName(after).groupBy("window_start", by).agg(*zero.values())
    mark = spark.read.parquet(f"{out}/marks").agg((F.max("at") - F.expr(f"INTERVAL {delay}")).alias("_mark"))
    closed = F.coalesce(_window_end(F.col("window_start")) <= F.col("_mark"), F.lit(False))
    return folded.crossJoin(F.broadcast(mark)).withColumn("closed", closed).drop("_mark")
