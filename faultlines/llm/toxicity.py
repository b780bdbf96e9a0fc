"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Fitting takes a bounded sample of labelled rows (``labelled.SAMPLE_ROWS``). The lexicon starts from a few insults and
gains the words and word beginnings that stand in many toxic and few other texts of the sample (at most ``TERMS``).
Features: lexicon densities over the text and in its densest stretch, nearness of second-person words to lexicon words,
capitals, punctuation, and rates of obfuscated words (letters replaced by digits or signs, read back before the
lexicon is asked). Two thirds of the sample grow the trees, one third fits the isotonic steps.

Every text is scored whole. Null and empty texts have all features 0; repeated rows get equal scores. With no labels,
or labels of one class, every score is the share of label 1 (0 without any). Only id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.llm import labelled
from faultlines.llm.common import bounded_batches, trimmed

INSULTS = frozenset("idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb ugly garbage".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti usted vosotros".split())
TERMS = 3000
STEMS = (5, 4)
NEAR = 5
STRETCH = 40
TREES, DEPTH, RATE, LEAF, BINS = 60, 3, 0.2, 15, 32
_WORD = re.compile(r"[^\W_]+(?:[@$*!|][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W\d_][0-9@$*!|]+[^\W_]")
_PLAIN = str.maketrans("013457@$!|", "oieastasii")
_SIGNS = re.compile(r"[!?]")
_RUNS = re.compile(r"[!?]{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def terms_of(text: str) -> set[str]:
    """Words and word beginnings (with a trailing bar) of a text."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {w[:n] + "|" for n in STEMS for w in words if len(w) > n}


def learned_terms(sample: DataFrame, most: int = TERMS) -> dict[str, float]:
    """Terms that mark toxic texts, with the share of their texts that are toxic, from counts by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update(terms_of(text))
        keys = list(seen[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["term", "bad", "good"]
        )
        yield pa.RecordBatch.from_arrays([pa.array(list(seen[0].keys() - seen[1].keys()), pa.string()), pa.array([0] * len(seen[0].keys() - seen[1].keys()), pa.int64()), pa.array([seen[0][k] for k in seen[0].keys() - seen[1].keys()], pa.int64())], ["term", "bad", "good"])

    counts = sample.select("text", "y").mapInArrow(trimmed(run), "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = F.col("bad") / (F.col("bad") + F.col("good") + 1)
    rows = counts.where("bad >= 5").select("term", "bad", share.alias("share")).where("share >= 0.8").orderBy(F.desc("bad"), "term").limit(most).collect()
    return {r.term: r.share for r in rows}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    get = lexicon.get
    hits, odd_hits, weight = [], 0, 0.0
    for i, w in enumerate(words):
        v = get(w) or next((s for n in STEMS if (s := get(w[:n] + "|"))), None)
        if v is None and not w.isalpha():
            v = get(w.translate(_PLAIN).replace("*", ""))
            odd_hits += v is not None
        if v is not None:
            hits.append(i)
            weight += v
    you = [i for i, w in enumerate(words) if w in SECOND]
    near, k = 0, 0
    for i in hits:
        while k < len(you) and you[k] < i - NEAR:
            k += 1
        near += k < len(you) and you[k] <= i + NEAR
    dense, k = 0, 0
    for j, i in enumerate(hits):
        while hits[k] <= i - STRETCH:
            k += 1
        dense = max(dense, j - k + 1)
    upper = len(_UPPER.findall(text))
    chars = len(text)
    return [
        len(hits) / n, weight / n, float(len(hits)), float(len({words[i] for i in hits})), dense / min(n, STRETCH), float(dense), near / n, len(you) / n,
        upper / chars, sum(w.isupper() for w in _LETTERS.findall(text)) / n if upper * 5 > chars else 0.0, len(_SIGNS.findall(text)) / chars, len(_RUNS.findall(text)) / n,
        len(_ODD.findall(text)) / n, odd_hits / n, float(np.log1p(n)),
    ]


NAMES = (
    "density", "weighted", "hits", "kinds", "stretch_density", "stretch_hits", "near_second", "second", "capitals", "capital_words", "marks", "mark_runs",
    "odd_words", "odd_hits", "log_words",
)


@dataclass
class Model:
    """Boosted trees as arrays by level, and isotonic steps from margin to score."""

    lexicon: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    at: np.ndarray = field(default_factory=lambda: np.zeros(1))
    level: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for column, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > cut[node])
            out += value[node - (1 << DEPTH) + 1]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.margin(x), self.at, self.level), 0.0, 1.0)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> tuple[float, list]:
    """Logistic gradient boosting on quantile-binned features."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for c in x.T]
    # quantiles of a rare feature are all 0: take quantiles of its other values too
    cuts = [np.unique(np.concatenate([k, np.quantile(c[c > 0], np.linspace(0, 1, 9)[:-1], method="nearest") if (c > 0).any() else k[:0], [0.0]])) for k, c in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T)], axis=1)
    margin, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        column, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range((1 << DEPTH) - 1):
            own = np.flatnonzero(node == at)
            best = 1e-6
            if len(own) >= 2 * LEAF:
                total_g, total_h = g[own].sum(), h[own].sum()
                for c, k in enumerate(cuts):
                    b = binned[own, c]
                    left_n = np.cumsum(np.bincount(b, minlength=len(k) + 1))[: len(k)]
                    left_g = np.cumsum(np.bincount(b, g[own], len(k) + 1))[: len(k)]
                    left_h = np.cumsum(np.bincount(b, h[own], len(k) + 1))[: len(k)]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    gain[(left_n < LEAF) | (len(own) - left_n < LEAF)] = 0
                    j = int(np.argmax(gain))
                    if gain[j] > best:
                        best, column[at], cut[at] = gain[j], c, k[j]
            node[own] = 2 * at + 1 + (x[own, column[at]] > cut[at])
        leaf = node - (1 << DEPTH) + 1
        value = RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
        margin = margin + value[leaf]
        out.append((column, cut, value))
    return base, out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit as (margins, levels) for linear interpolation."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v1, n1, _, b1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v1, blocks[-1][1] + n1, blocks[-1][2], b1]
    at = np.array([p for b in blocks for p in (b[2], b[3])])
    level = np.array([(b[0] + 0.1 * share) / (b[1] + 0.1) for share in [y.mean()] for b in blocks for _ in (0, 1)])
    return at, np.maximum.accumulate(level)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = labelled.SAMPLE_ROWS) -> Model:
    """Model from labelled rows of docs; labels has doc_id and the label column."""
    sample = labelled.sample(docs, labels, label, rows)
    lexicon = learned_terms(sample)
    lexicon |= {w: lexicon.get(w, 0.5) for w in INSULTS}
    table = np.array([[*r.x, r.y, r.fold] for r in _featured(sample, lexicon).collect()], float).reshape(-1, len(NAMES) + 2)
    table = table[np.lexsort(table.T)]
    x, y, fold = table[:, : len(NAMES)], table[:, -2], table[:, -1]
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.0
        return Model(lexicon, 0.0, [], np.zeros(1), np.array([share]))
    held = fold == 0
    if min((held & (y == 1)).sum(), (held & (y == 0)).sum(), (~held & (y == 1)).sum()) < 20:
        held[:] = True
        base, trees = grow(x, y)
    else:
        base, trees = grow(x[~held], y[~held])
    model = Model(lexicon, base, trees)
    model.at, model.level = isotonic(model.margin(x[held]), y[held])
    return model


def _featured(sample: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = pa.array([features(t, lexicon) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, batch.column(1), pa.array([zlib.crc32(t.encode()) % 3 for t in texts], pa.int32())], ["x", "y", "fold"])

    return sample.select("text", "y").mapInArrow(trimmed(run), "x array<double>, y int, fold int")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                x = np.array([features(t or "", own.lexicon) for t in piece.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(own.score(x))], [id_col, "score"])

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(trimmed(run), schema)


def filtered(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose score is below threshold."""
    names = docs.columns
    where = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                x = np.array([features(t or "", own.lexicon) for t in piece.column(where).to_pylist()])
                yield piece.filter(pa.array(own.score(x) < threshold))

    return bounded_batches(docs).mapInArrow(trimmed(run), docs.schema)
