"""Admission of requests: one pass writes what is accepted and what is rejected side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from faultlines.sources.logs import violations


@dataclass
class Admission:
    """accepted has the columns of the requests; rejected also ``errors``. Counts are those of the writing pass."""

    accepted: DataFrame
    rejected: DataFrame
    accepted_count: int
    rejected_count: int


def admit(requests: DataFrame, path: str) -> Admission:
    """Writes all requests to ``path``, partitioned by whether they are rejected, and reads both parts back.

    The checks run once, in the pass that writes; counts are observed on the same rows. Content of a rejected request is not
    kept. Later steps read the accepted part only, so requests are assembled once however many steps follow.
    """
    spark = requests.sparkSession
    seen = Observation("admission")
    checked = requests.withColumn("errors", violations(requests)).withColumn("rejected", F.size("errors") > 0)
    kept = checked.withColumn("content", F.when(~F.col("rejected"), F.col("content")))
    counted = kept.observe(seen, F.count_if(~F.col("rejected")).alias("accepted"), F.count_if("rejected").alias("rejected"))
    counted.write.mode("overwrite").partitionBy("rejected").parquet(path)
    table = spark.read.schema(counted.schema).parquet(path)
    counts = seen.get
    accepted = table.filter(~F.col("rejected")).select(requests.columns)
    return Admission(accepted, table.filter("rejected").drop("rejected"), counts["accepted"], counts["rejected"])


def rejections(rejected: DataFrame) -> DataFrame:
    """One row per violation: log_id, field, message."""
    return rejected.select("log_id", F.explode("errors").alias("e")).select("log_id", "e.field", "e.message")
