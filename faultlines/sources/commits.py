"""Batches that are written apart and become visible by a manifest.

A batch is written to a folder of its own for every attempt. Only when that write has ended is an entry appended to the
manifest, and readers take the folders that the manifest names: a write that failed half-way is never read, and does
not stop the other batches. A batch that is written again replaces the one before, as the newest entry counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTRY = "batch string, attempt string, number long, n_rows long"
MOST_BATCHES = 10_000


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def commit(df: DataFrame, path: str, batch: str, write: Callable[[DataFrame, str], None] = write_parquet) -> DataFrame:
    """Writes each batch (a value of that column) of a stored table; returns (batch, error) of the batches that failed.

    Batches are few (a time slice, a source); their number is checked.
    """
    spark = df.sparkSession
    names = [r[0] for r in df.select(F.col(batch).cast("string")).distinct().limit(MOST_BATCHES + 1).collect()]
    if len(names) > MOST_BATCHES:
        raise ValueError(f"more than {MOST_BATCHES} batches")
    number, failed = _last_number(spark, path), []
    for name in sorted(names, key=lambda x: (x is None, x)):
        own = df.filter(F.col(batch).cast("string").eqNullSafe(F.lit(name)))
        attempt = f"batches/{uuid.uuid4().hex}"
        try:
            write(own, f"{path}/{attempt}")
            rows = spark.read.parquet(f"{path}/{attempt}").count()
            number += 1
            spark.createDataFrame([(name, attempt, number, rows)], ENTRY).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        except Exception as error:  # noqa: BLE001 - a failed batch is a note, whatever its sink raised
            failed.append((name, type(error).__name__))
    return spark.createDataFrame(failed, "batch string, error string")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _last_number(spark: SparkSession, path: str) -> int:
    if not _exists(spark, f"{path}/manifest"):
        return 0
    return spark.read.schema(ENTRY).parquet(f"{path}/manifest").agg(F.max("number")).first()[0] or 0


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of every batch."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], ENTRY)
    newest = W.partitionBy("batch").orderBy(F.desc("number"))
    entries = spark.read.schema(ENTRY).parquet(f"{path}/manifest")
    return entries.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All committed rows; no manifest, no rows."""
    folders = [f"{path}/{r.attempt}" for r in committed(spark, path).collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
