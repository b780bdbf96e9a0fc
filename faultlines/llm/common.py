"""Shared pieces: tables in the shared folder, null-safe text, dealing out packed arrays by key."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder and any
    other master an error, since executors of a cluster do not see the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="faultlines-llm-")
    return _LOCAL[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that later stages survive the loss of
    executors and read one fixed copy. Nothing reads the shuffle files of that job again, so Spark may remove them as
    soon as it ends. The folder goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    folder, target = _folder(spark, path)
    folder.deleteOnExit(target)
    getattr(_OPEN, "paths", []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


_OPEN = threading.local()


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def dropped(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table._stored_at)


def delete(spark: SparkSession, path: str) -> None:
    folder, target = _folder(spark, path)
    folder.delete(target, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of all tables that this thread stores inside the block."""
    before = getattr(_OPEN, "paths", None)
    _OPEN.paths = paths = []
    try:
        yield paths
    finally:
        if before is None:
            del _OPEN.paths
        else:
            _OPEN.paths = before
            before += paths


BATCH_ROWS = 2500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """df, after Arrow batches of the session were bounded to ``rows``: whole texts are long rows, and a worker holds a
    batch of them at once."""
    spark = df.sparkSession
    now = int(spark.conf.get(_ROWS, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(_ROWS, str(rows))
    return df


_HELD: dict[str, Callable[[], None]] = {}


def holds(name: str, release: Callable[[], None]) -> None:
    """Notes what this worker keeps from one task to the next, and how it is released."""
    _HELD[name] = release


def release(keep: str = "") -> bool:
    """Releases what this worker keeps for other work than ``keep``; whether there was any."""
    others = [name for name in _HELD if name != keep]
    for name in others:
        _HELD.pop(name)()
    return bool(others)


def trim(keep: str = "") -> None:
    """Gives freed memory of this process back to the system, also what it keeps for other work than ``keep``."""
    release(keep)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run, keep: str = ""):
    """run, after which the worker gives freed memory back to the system. Workers are reused: a later stage would hold what
    an earlier one has freed, or keeps for tasks of its own, on top of its own. Only what is named ``keep`` stays."""

    @functools.wraps(run)
    def then_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if release(keep):
            trim(keep)
        try:
            yield from run(batches)
        finally:
            trim(keep)

    return then_trim


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(col: str = "text"):
    """The text, empty for null."""
    return F.coalesce(F.col(col), F.lit(""))


def parts_for(n_bytes: int, part_bytes: int, least: int = 64) -> int:
    """Number of parts of about part_bytes each."""
    return max(least, -(-int(n_bytes) // part_bytes))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit integers (splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0..n-1 of well-mixed 64-bit keys by their top bits."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def text_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one array and the offset of each row (rows + 1 values)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``most`` bytes together (one row at least), so that the memory of a
    task does not depend on the batch size."""
    _, offsets = text_values(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
