"""Hashed word shingles of whole texts, a batch at a time.

Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, with A-Z
lowered. A word's hash is a polynomial in its bytes modulo 2^64, a shingle's hash mixes those of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from faultlines.llm.common import holds, mix, text_values

BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                holds("shingles", _POWERS.clear)
                _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle, in order; a row with fewer than size words has one shingle of them all, a row
    without words none. Null texts count as empty."""
    flat, offsets = text_values(texts)
    rows = len(offsets) - 1
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _LOWER[flat]
    word = ~_SPACE[flat]
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    starts_doc = np.zeros(len(flat) + 1, bool)
    starts_doc[offsets[:-1]] = True
    begin = np.flatnonzero(word & (~before | starts_doc[:-1]))
    end = np.flatnonzero(word & (~after | starts_doc[1:])) + 1
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(len(flat) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], dtype=np.uint64)])
        words = mix((sums[end] - sums[begin]) * down[begin])
        row = np.searchsorted(offsets, begin, side="right") - 1
        first = np.searchsorted(row, np.arange(rows))
        count = np.searchsorted(row, np.arange(rows), side="right") - first
        out_rows, out = [], []
        n = len(words) - size + 1
        if n > 0:
            at = np.flatnonzero(row[:n] == row[size - 1 :])
            h = np.zeros(len(at), np.uint64)
            for k in range(size):
                h = mix(h ^ words[at + k], k + 1)
            out_rows.append(row[at])
            out.append(h)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            h = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                held = count[short] > k
                h[held] = mix(h[held] ^ words[first[short[held]] + k], k + 1)
            out_rows.append(short)
            out.append(mix(h, 1000))
    rows_of, hashes = np.concatenate(out_rows) if out_rows else np.zeros(0, np.int64), np.concatenate(out) if out else np.zeros(0, np.uint64)
    order = np.argsort(rows_of, kind="stable") if len(short) else slice(None)
    return rows_of[order], hashes[order]


def sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (rows + 1) and sorted distinct shingle hashes of every row."""
    row, h = shingles(texts, size)
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        h[a:b].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
    return np.searchsorted(row, np.arange(len(texts) + 1)), h
