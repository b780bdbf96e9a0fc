"""Token counts without a shuffle of pre-tokens: a broadcast table of frequent lengths, then worker caches.

A piece of the vocabulary never holds the word mark behind another character (checked on loading), so no merge
crosses the start of a run of word marks. A text is cut there, each pre-token is counted alone, and the sums are exact.

Tier 1: every task summarises the pre-tokens of all its texts, bounded by ``summary`` entries; the summaries are
added up and the ``table`` most frequent ones, at most ``KEY_LENGTH`` characters each, are broadcast with their
lengths. The size of that table is fixed, however large the corpus. Tier 2: a miss is encoded and kept in the cache
of the worker, which is emptied to the table when it is full. Counts never depend on what either tier holds.

Null and empty texts have no tokens; texts of any length are counted whole; repeated rows are counted each.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from faultlines.llm.common import bounded_batches

MARK = "▁"
KEY_LENGTH = 32
TABLE = 65_536
SUMMARY = 8_192
CACHE = 600_000
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


def pre_tokens(text: str) -> list[str]:
    """Keys of a text's pre-tokens: the pre-token without its first word mark, other marks as blanks."""
    text = text.replace(MARK, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return [m[1:].replace(MARK, " ") for m in _RUNS.findall(MARK + text.replace(" ", MARK))]


class Lengths(dict):
    """Token counts by key; a miss is encoded."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.model = SentencePieceProcessor(model_file=path)
        if any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.get_piece_size())):
            raise ValueError("a piece of this vocabulary crosses a word start")
        self.table = table
        self[""] = len(self.model.encode("x ")) - len(self.model.encode("x"))

    def __missing__(self, key: str) -> int:
        n = len(self.model.encode(key))
        if len(key) <= 2 * KEY_LENGTH:
            if len(self) >= CACHE:
                blank = self[""]
                self.clear()
                self.update(self.table)
                self[""] = blank
            self[key] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, pre_tokens(text))) if text else 0


def frequent(docs: DataFrame, text_col: str = "text", table: int = TABLE, summary: int = SUMMARY) -> list[str]:
    """The most frequent short pre-tokens of all texts, from bounded summaries of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for text in batch.column(0).slice(at, 500).to_pylist():
                    if text:
                        seen.update(pre_tokens(text))
                if len(seen) > 8 * summary:
                    seen = Counter(dict(seen.most_common(2 * summary)))
        top = [(k, n) for k, n in seen.most_common(summary) if len(k) <= KEY_LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["key", "n"])

    found = docs.select(text_col).mapInArrow(run, "key string, n bigint")
    top = found.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(table)
    return [r.key for r in top.collect()]


_WORKER: dict[tuple, Lengths] = {}


def count(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", table: int = TABLE) -> DataFrame:
    """One row per input row: id, bytes, tokens, and whether the tokens exceed limit."""
    model = SentencePieceProcessor(model_file=path)
    keys = frequent(bounded_batches(docs), text_col, table)
    run_id = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast({k: len(model.encode(k)) for k in keys if k})
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = (path, run_id)
        if who not in _WORKER:
            _WORKER.clear()
            _WORKER[who] = Lengths(path, shared.value)
        lengths = _WORKER[who]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                n = [lengths.count(t) for t in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    [id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return docs.select(id_col, size.alias("n_bytes"), text_col).mapInArrow(run, schema)
