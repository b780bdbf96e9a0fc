"""Trigram index for substring search over stored narratives.

``postings`` has one row for each narrative and distinct trigram (of code points, lower case) of its search fields. It is
dealt to ``FOLDERS`` folders by hash of the trigram and sorted within, by ranges, so a trigram that every narrative has is
spread over files and a search reads only the folders and row groups of its own trigrams. ``frequency`` counts the
narratives of each trigram; its size is that of the alphabet, not of the history.

A search takes the rarest trigrams of its text, intersects their postings and tests what is left as a search without the
index does, so both give the same rows. A text shorter than a trigram is searched without the index. Null fields have no
trigrams; rows that repeat an id are candidates together.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlines.operators import history as H

GRAM = 3
FOLDERS = 64
RAREST = 4


class TextIndex(NamedTuple):
    postings: DataFrame
    frequency: DataFrame


def grams(value: Column) -> Column:
    """All trigrams of a text, in order; empty for null and for shorter texts."""
    found = F.regexp_extract_all(F.lower(value), F.lit("(?s)(?=(.{%d}))" % GRAM), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def text_grams(text: str) -> list[str]:
    needle = text.strip().lower()
    return sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})


def write_index(narratives: DataFrame, path: str) -> None:
    """Writes postings and frequencies of the search fields of ``narratives`` below ``path``."""
    spark = narratives.sparkSession
    fields = F.flatten(F.array(*[grams(value) for value in H.search_values().values()]))
    postings = narratives.select("analysis_id", F.explode(F.array_distinct(fields)).alias("gram"))
    postings = postings.withColumn("folder", F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int"))
    order = ["folder", "gram", "analysis_id"]
    dealt = postings.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    counted = _postings(spark, path, postings.schema["analysis_id"].dataType.simpleString()).groupBy("folder", "gram").agg(
        F.count(F.lit(1)).alias("narratives"), F.min("analysis_id").alias("first_id")
    )
    counted.sort("gram").write.mode("overwrite").parquet(f"{path}/frequency")


def _postings(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """With a given schema, since the table of an empty history has no files."""
    return spark.read.schema(f"analysis_id {id_type}, gram string, folder int").parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str) -> TextIndex:
    frequency = spark.read.parquet(f"{path}/frequency")
    return TextIndex(_postings(spark, path, frequency.schema["first_id"].dataType.simpleString()), frequency)


def candidates(index: TextIndex, text: str, rarest: int = RAREST) -> DataFrame | None:
    """Ids whose narratives hold the rarest trigrams of a text: all that can match, and some more. None where the text is
    too short for a trigram. The rows that reach the driver are counts, one for each trigram of the text."""
    wanted = text_grams(text)
    if not wanted:
        return None
    known = index.frequency.filter(F.col("gram").isin(wanted)).select("folder", "gram", "narratives").collect()
    if len(known) < len(wanted):
        return index.postings.filter(F.lit(False)).select("analysis_id")
    chosen = sorted(known, key=lambda r: (r["narratives"], r["gram"]))[:rarest]
    read = index.postings.filter(F.col("folder").isin(sorted({r["folder"] for r in chosen})) & F.col("gram").isin([r["gram"] for r in chosen]))
    held = read.groupBy("analysis_id").agg(F.count_distinct("gram").alias("n"))
    return held.filter(F.col("n") == len(chosen)).select("analysis_id")


def search(narratives: DataFrame, index: TextIndex, text: str, limit: int, **filters) -> DataFrame:
    """``search_narratives`` over the candidates alone; ``filters`` are those of that function."""
    found = candidates(index, text)
    rows = narratives if found is None else narratives.join(found, "analysis_id", "left_semi")
    return H.search_narratives(rows, text, limit, **filters)
