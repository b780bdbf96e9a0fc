"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlines.llm import (
    bpe, conversation_repair, decontamination, embedding_dedup, fingerprints, jaccard_join, labelled, packing, quality, secrets, suffix_dedup, token_counts,
    toxicity, whitening,
)
from faultlines.llm.common import documents

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every document and of its edited text."""
    return fingerprints.fingerprint(documents(spark, sf_dir))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), end_id=2, window=4096)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by pair occurrence index, and the text decoded from them."""
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 50-byte string of an earlier document covers."""
    return suffix_dedup.dedup(documents(spark, sf_dir), length=50)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by table lookup and worker caches."""
    return token_counts.count(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE), limit=4096)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_join.join(documents(spark, sf_dir), size=4, num=85, den=100)


def _classified(spark: SparkSession, sf_dir: str, method, folds: int, held: int, threshold: float) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = method.fit(docs, labels.where(labelled.fold("doc_id", folds) != held))
    return method.score(docs, model).select(
        "doc_id",
        F.coalesce(labelled.fold("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of one fold in three are never learned."""
    return _classified(spark, sf_dir, toxicity, folds=3, held=1, threshold=0.7)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of one fold in five are never learned."""
    return _classified(spark, sf_dir, quality, folds=5, held=0, threshold=0.3)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and structurally confirmed secrets of every document."""
    return secrets.digests(secrets.scan(documents(spark, sf_dir)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.98 or more."""
    return embedding_dedup.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that ten-word windows of benchmark items cover."""
    found = decontamination.hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "items", "spans",
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every vector on the 32 components of largest variance."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fit(vectors, most=32)
    return whitening.whiten(vectors, model, model and whitening.identity_error(vectors, model))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after damage."""
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_pack, op3_bpe_codec, op4_suffix_dedup, op5_token_counts, op6_jaccard_join, op7_toxicity, op8_quality, op9_secret_scan,
        op10_embedding_dedup, op11_decontamination, op12_whitening, op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {}
