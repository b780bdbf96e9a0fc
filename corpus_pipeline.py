"""Training-corpus pipeline over ``documents``: each stage works on all rows that the one before kept.

Nulls: a null text is empty for every stage; a row without an id is never a duplicate. Rows that repeat an id are
separate documents, except to the near-duplicate stage, which keeps or drops them together. Columns other than id, text and
n_chars pass through unchanged up to the last stage. Texts of any length are read whole. An empty table stays empty, and
the last stage then has no rows. Where near-duplicates tie, the smallest id stays; repeated text stays where its id is smallest.

A stage's result is written before the next stage is called, as STAGES asks for: what a stage stored on its way is removed
when the next one begins.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlines.llm import jaccard_join, packing, secrets, suffix_dedup, toxicity
from faultlines.llm.common import delete, dropped, recorded, stored

TOXIC = 0.7
SHINGLE_WORDS, SIMILAR, OF = 5, 80, 100
REPEATED_BYTES = 50
WINDOW, END_ID = 4096, 2


_LEFT = threading.local()


def _stage(work):
    """Removes what the stage before has stored, and notes what this one stores."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release(spark)
        with recorded() as paths:
            out = work(spark, docs, sf_dir)
        _LEFT.paths = paths
        return out

    return run_stage


def _release(spark: SparkSession) -> None:
    for path in getattr(_LEFT, "paths", []):
        delete(spark, path)
    _LEFT.paths = []


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go. The model learns from the labels of all documents that are left."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filtered(docs, model, TOXIC)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    found = jaccard_join.join(docs, size=SHINGLE_WORDS, num=SIMILAR, den=OF)
    return docs.join(found.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


@_stage
def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that an earlier document holds goes; a document of which nothing is left goes with it."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = suffix_dedup.dedup(docs, REPEATED_BYTES, with_text=True, carry=rest)
    return _measured(found.where("n_removed = 0 or n_removed < n_bytes").withColumn("text", F.col("kept")).select(docs.columns))


@_stage
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found by the scan are replaced by a mark."""
    return _measured(secrets.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    _release(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID, window=WINDOW)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_text_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]
#: Encoders, trees and suffix arrays have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
