"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

margin = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2], linear in the number of features. Words are
hashed into ``WORDS`` columns, their counts scaled to length 1; the dense columns are standardised statistics. Fitting
takes a bounded sample of labelled rows (``labelled.SAMPLE_ROWS``), with Adagrad steps on mini-batches and a fixed seed;
a held part of the sample gives the logistic calibration.

Every text is scored whole. Null and empty texts have no words and all statistics 0; repeated rows get equal scores.
With no labels, or labels of one class, every score is the share of label 1 (0 without any). Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultlines.llm import labelled
from faultlines.llm.common import bounded_batches, mix, slices, text_values
from faultlines.llm.shingles import shingles

WORDS = 4096
RANK = 8
EPOCHS = 6
BATCH = 256
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 other sign, 8 lead of a longer character
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 4, 5
_KIND[[33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 45, 47, *range(58, 65), *range(91, 97), *range(123, 127)]] = 7
_KIND[[44, 46]] = 6
_KIND[192:256] = 8
STATS = 19


def inputs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the hashed words and the dense statistics of every text."""
    rows = len(texts)
    flat, offsets = text_values(texts)
    row, h = shingles(texts, 1)
    key, count = np.unique(row * WORDS + (h & np.uint64(WORDS - 1)).astype(np.int64), return_counts=True)
    r, c = key // WORDS, key % WORDS
    norm = np.sqrt(np.bincount(r, count.astype(float) ** 2, rows))
    value = count / norm[r]
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(owner * 9 + _KIND[flat], minlength=rows * 9).reshape(rows, 9) if len(flat) else np.zeros((rows, 9))
    size = np.maximum(np.diff(offsets), 1)[:, None]
    words = np.bincount(row, minlength=rows).astype(float)
    some = np.maximum(words, 1)
    twice = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=rows) / some
    distinct_key = np.unique(mix(h) ^ mix(row.astype(np.uint64), 3), return_index=True)[1]
    distinct = np.bincount(row[distinct_key], minlength=rows)
    two_row, two = shingles(texts, 3)
    two_key = np.unique(mix(two) ^ mix(two_row.astype(np.uint64), 3), return_index=True)[1]
    three = np.bincount(two_row[two_key], minlength=rows) / np.maximum(np.bincount(two_row, minlength=rows), 1)
    pairs = np.zeros(rows)
    if len(flat) > 1:
        signs = (_KIND[flat[1:]] == 7) & (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])
        pairs = np.bincount(owner[1:][signs], minlength=rows) / some
    dense = np.column_stack([
        kinds / size, np.log1p(words), np.log1p(np.diff(offsets)), distinct / some, twice, three, pairs,
        np.diff(offsets) / some / 10, kinds[:, 2] / np.maximum(kinds[:, 1] + kinds[:, 2], 1), kinds[:, 7] / some, kinds[:, 6] / some,
    ])
    return r, c, value, dense


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    shift: float

    def margin(self, rows: int, r: np.ndarray, c: np.ndarray, v: np.ndarray, dense: np.ndarray) -> np.ndarray:
        x = np.clip((dense - self.mean) / self.scale, -5, 5)
        w, f = self.weight[WORDS:], self.factor[WORDS:]
        out = self.bias + x @ w + np.bincount(r, v * self.weight[c], rows)
        sums, squares = x @ f, (x**2) @ (f**2)
        for k in range(self.factor.shape[1]):
            own = v * self.factor[c, k]
            out += 0.5 * ((sums[:, k] + np.bincount(r, own, rows)) ** 2 - squares[:, k] - np.bincount(r, own**2, rows))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        r, c, v, dense = inputs(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(len(texts), r, c, v, dense) + self.shift, -30, 30)))


def _constant(share: float) -> Model:
    share = min(max(share, 1e-12), 1 - 1e-12)
    zero = np.zeros(WORDS + STATS)
    return Model(0.0, zero, np.zeros((WORDS + STATS, RANK)), np.zeros(STATS), np.ones(STATS), 0.0, float(np.log(share / (1 - share))))


def train(r: np.ndarray, c: np.ndarray, v: np.ndarray, dense: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Adagrad on the logistic loss; one row in five is kept for the calibration."""
    rng = np.random.default_rng(seed)
    n, size = len(y), WORDS + STATS
    mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    x = np.clip((dense - mean) / scale, -5, 5)
    weight, factor, bias = np.zeros(size), rng.normal(0, 0.02, (size, RANK)), float(np.log(y.mean() / (1 - y.mean())))
    seen_w, seen_f, seen_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    bounds = np.searchsorted(r, np.arange(n + 1))
    held = np.arange(n) % 5 == 0
    pool = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rng.shuffle(pool)
        for at in range(0, len(pool), BATCH):
            own = pool[at : at + BATCH]
            full = np.zeros((len(own), size))
            full[:, WORDS:] = x[own]
            for i, j in enumerate(own):
                full[i, c[bounds[j] : bounds[j + 1]]] = v[bounds[j] : bounds[j + 1]]
            square, sums = full**2, full @ factor
            m = bias + full @ weight + 0.5 * (sums**2 - square @ factor**2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[own]) / len(own)
            gw = full.T @ g + 1e-5 * weight
            gf = full.T @ (g[:, None] * sums) - factor * (square.T @ g)[:, None] + 1e-4 * factor
            seen_w += gw**2
            seen_f += gf**2
            seen_b += g.sum() ** 2
            weight -= 0.1 * gw / np.sqrt(seen_w)
            factor -= 0.05 * gf / np.sqrt(seen_f)
            bias -= 0.1 * g.sum() / np.sqrt(seen_b)
    model = Model(bias, weight, factor, mean, scale, 1.0, 0.0)
    renumber = np.cumsum(held) - 1
    inside = held[r]
    margin = model.margin(int(held.sum()), renumber[r[inside]], c[inside], v[inside], dense[held])
    target = y[held]
    if 0 < target.sum() < len(target):
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps for slope and shift
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - target) * margin).sum() + 1e-2 * (a - 1), (p - target).sum()])
            hess = np.array([[(w * margin**2).sum() + 1e-2, (w * margin).sum()], [(w * margin).sum(), w.sum()]])
            step = np.clip(np.linalg.solve(hess, grad), -1, 1)
            a, b = max(a - step[0], 1e-3), b - step[1]
            if abs(step).max() < 1e-6:
                break
        model.slope, model.shift = float(a), float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = labelled.SAMPLE_ROWS) -> Model:
    """Model from labelled rows of docs; labels has doc_id and the label column."""
    packed = "words binary, dense array<double>, y int, h bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 0):
                r, c, v, dense = inputs(piece.column(0))
                cuts = np.searchsorted(r, np.arange(piece.num_rows + 1))
                words = [c[a:b].astype("<u2").tobytes() + v[a:b].astype("<f4").tobytes() for a, b in zip(cuts, cuts[1:])]
                row, h = shingles(piece.column(0), 1)
                order = mix(np.bincount(row, (h >> np.uint64(40)).astype(float), piece.num_rows).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(dense), pa.list_(pa.float64())), piece.column(1), pa.array(order)], ["words", "dense", "y", "h"])

    found = labelled.sample(docs, labels, label, rows).select("text", "y").mapInArrow(run, packed).collect()
    found.sort(key=lambda r: (r.h, bytes(r.words), r.dense))
    y = np.array([r.y for r in found], float)
    if not 0 < y.sum() < len(y):
        return _constant(float(y.mean()) if len(y) else 0.0)
    lengths = np.array([len(r.words) // 6 for r in found])
    c = np.concatenate([np.frombuffer(r.words, "<u2", n) for r, n in zip(found, lengths)]).astype(np.int64)
    v = np.concatenate([np.frombuffer(r.words, "<f4", n, 2 * n) for r, n in zip(found, lengths)]).astype(float)
    return train(np.repeat(np.arange(len(found)), lengths), c, v, np.array([r.dense for r in found]), y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for piece in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(own.score(piece.column(1)))], [id_col, "score"])

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, schema)
