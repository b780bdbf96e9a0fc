"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.llm.common import bounded_batches, slices, stored
from faultlines.llm.shingles import sets

SAMPLE_ROWS = 20_000


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents, chosen by hash of id. Texts whose least hash of all
    5-word shingles agrees (equal texts, most near copies) count once, with the mean of their labels rounded, so that a
    text that was copied often does not teach its own words. Labels of 0 or 1 count, others and nulls do not; a repeated id has its largest label.
    The chosen ids are at most ``rows`` and therefore broadcast; the corpus is not shuffled."""
    wanted = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    )
    found = bounded_batches(docs).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "id")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 0):
                cuts, h = sets(piece.column(0), 5)
                least = np.zeros(piece.num_rows, np.uint64)
                some = np.diff(cuts) > 0
                least[some] = h[cuts[:-1][some]]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(least.view(np.int64))], ["text", "y", "mark"])

    once = found.select("text", "y").mapInArrow(marked, "text string, y int, mark bigint").groupBy("mark")
    return stored(once.agg(F.min("text").alias("text"), F.round(F.avg("y")).cast("int").alias("y")).select("text", "y"), "labelled")
