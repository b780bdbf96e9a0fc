"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts in a document of smaller id.

A suffix array of a whole large corpus would shuffle many times its size, so it is built where strings can repeat:

0. Copies of a whole text are known by their SHA-256: all but the first are removed entirely (if they have a window at
   all) and take no part in what follows, as the first has a smaller id. A copy is known by id and digest, so that other
   rows of its id, or other rows without an id, are no copies.
1. Each window of ``length`` bytes is assigned to the smallest hash of its 20-byte grams, its anchor. Equal windows have
   equal anchors, wherever they stand. Neighbouring windows of one anchor form a segment. Per part of the corpus, every
   distinct anchor is dealt out once, and the anchors that stand in different texts are sent back to the parts.
2. Parts deal out their segments with such anchors by anchor, each distinct segment once. A task gathers the segments of
   its anchors into one string and sorts its suffixes by the difference cover of 3: triples at positions 1 and 2 modulo
   3 are named and sorted, recursively while names repeat, the rest follows from them and is merged in. Neighbours in
   that order whose first ``length`` bytes agree are one string; its smallest document id goes back to the parts.
3. Parts mark the windows whose smallest id is below the document's own and remove the bytes covered.

Texts are judged on the input. Work is dealt by hash of id or anchor, one row to a part and bucket: a passage
in a third of all documents is one entry to a part. The corpus is shuffled once; later steps reuse that exchange.

Null and empty texts and texts shorter than ``length`` lose nothing; rows that repeat an id do not remove each other's
bytes; a row without an id counts as after all others; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.llm.common import bounded_batches, buckets_of, mix, parts_for, text_values, trim, trimmed

PART_BYTES = 8 << 20
CHUNK = 1 << 20
SORT_BYTES = 1 << 18
LAST = (1 << 63) - 1


def suffix_array(s: np.ndarray, small: int = 32) -> np.ndarray:
    """Suffix array of positive integers by the difference cover of 3."""
    n = len(s)
    if n < small:
        text = s.tolist()
        return np.array(sorted(range(n), key=lambda i: text[i:]), np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a dummy triple at n keeps names of 1 and 2 apart
    sample = np.concatenate([one, two])
    pair = s[sample] * (int(s.max()) + 1) + s[sample + 1]
    if int(s.max()) >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair * (int(s.max()) + 1) + s[sample + 2]
    names_of, names = np.unique(triple, return_inverse=True)
    if len(names_of) == len(sample):
        order = np.argsort(names)
    else:
        order = suffix_array(names + 1, small)
    ranked = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[ranked] = np.arange(1, len(ranked) + 1)
    zero = np.arange(0, n, 3)
    key0 = s[zero] << 32 | rank[zero + 1]
    by = np.argsort(key0)
    zero, key0 = zero[by], key0[by]
    ranked = ranked[ranked < n]
    first, second = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]
    less = np.searchsorted(s[first] << 32 | rank[first + 1], key0)
    both = np.concatenate([second, zero])
    pair = s[both] * (int(s.max()) + 1) + s[both + 1]
    if int(s.max()) >= 1 << 15:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair << 32 | rank[both + 2]
    less += np.searchsorted(key[: len(second)], key[len(second) :])
    out = np.empty(n, np.int64)
    at = less + np.arange(len(zero))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = zero
    out[free] = ranked
    return out


def _grams(flat: np.ndarray) -> np.ndarray:
    return np.ndarray((len(flat) - 7,), "<u8", buffer=np.ascontiguousarray(flat), strides=(1,))


def _hashed(flat: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of the size (8 to 24) bytes from every position."""
    grams = _grams(flat)
    n = len(flat) - size + 1
    h = grams[:n] * np.uint64(0x9E3779B97F4A7C15)
    for shift in sorted({min(k, size - 8) for k in (8, 16)} - {0}):
        h ^= h >> np.uint64(32)
        h += grams[shift : shift + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return mix(h, salt) if salt else h


def segments(flat: np.ndarray, offsets: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in flat, windows, anchor) of every segment of the rows; length is at least 16."""
    empty = np.zeros(0, np.int64)
    if len(flat) < length:
        return empty, empty, empty.astype(np.uint64)
    gram = 20 if length >= 40 else 8
    low, span, left = _hashed(flat, gram, salt), 1, length - gram + 1
    while span < left:
        step = min(span, left - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    edge = np.zeros(len(flat) + 1, np.int32)
    ends = offsets[1:]
    np.add.at(edge, np.maximum(ends - length + 1, offsets[:-1]), 1)
    np.add.at(edge, ends, -1)
    good = np.cumsum(edge[: len(low)]) == 0
    joined = np.zeros(len(low), bool)
    joined[1:] = good[:-1] & (low[1:] == low[:-1])
    start = np.flatnonzero(good & ~joined)
    stop = np.flatnonzero(good & ~np.append(joined[1:] & good[1:], False)) + 1
    return start, stop - start, mix(low[start])  # least hashes are small: spread them again


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, min(to, rows)
        at = to


ONE = np.uint64(1)


def _merged(anchor: np.ndarray) -> np.ndarray:
    """Distinct anchors, sorted; the last bit is set where an anchor came more than once or had it set."""
    anchor = np.sort(anchor)
    if not len(anchor):
        return anchor
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] | ONE) != (anchor[:-1] | ONE)]))
    several = (np.diff(np.append(first, len(anchor))) > 1) | (np.bitwise_or.reduceat(anchor, first) & ONE > 0)
    return (anchor[first] & ~ONE) | several.astype(np.uint64)


def _dealt_anchors(parts: DataFrame, copies: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, part, blob): the distinct anchors of each part; the last bit tells that several texts hold one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        names, types = ["bucket", "part", "blob"], [pa.int32(), pa.int32(), pa.binary()]
        rows: list[tuple[int, bytes]] = []
        if left.num_rows:
            left = left.combine_chunks()
            flat, offsets = text_values(left.column("text"))
            whole = ~_copied(left.column("id").to_numpy(), flat, offsets, _copies_of(right))
            found = []
            for a, b in _chunks(offsets):
                own = offsets[a : b + 1] - offsets[a]
                start, _, anchor = segments(flat[offsets[a] : offsets[b]], own, length)
                row = a + np.searchsorted(own, start, side="right") - 1
                keep = whole[row]
                row, anchor = row[keep], anchor[keep] & ~ONE
                order = np.lexsort((anchor, row))  # a text counts once
                row, anchor = row[order], anchor[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                found.append(_merged(anchor[new]))
            anchor = _merged(np.concatenate(found))
            cuts = np.searchsorted(buckets_of(anchor, buckets), np.arange(buckets + 1))
            rows = [(k, anchor[x:y].tobytes()) for k, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
        part = left.column("part")[0].as_py() if left.num_rows else 0
        return pa.table([pa.array([k for k, _ in rows], types[0]), pa.array([part] * len(rows), types[1]), pa.array([v for _, v in rows], types[2])], names)

    return parts.groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(run, "bucket int, part int, blob binary")


def _repeated(dealt: DataFrame, buckets: int) -> DataFrame:
    """(part, kind, blob): for each part those of its anchors that stand in different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, parts = [], []
        for batch in batches:
            for part, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                anchors.append(np.frombuffer(blob.as_buffer(), np.uint64))
                parts.append(np.full(len(anchors[-1]), part, np.int32))
        if not anchors:
            return
        anchor, part = np.concatenate(anchors), np.concatenate(parts)
        order = np.argsort(anchor)
        anchor, part = anchor[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] | ONE) != (anchor[:-1] | ONE)]))
        count = np.diff(np.append(first, len(anchor)))
        keep = np.repeat((count > 1) | (np.bitwise_or.reduceat(anchor, first) & ONE > 0), count)
        anchor, part = anchor[keep] & ~ONE, part[keep]
        order = np.argsort(part, kind="stable")
        anchor, part = anchor[order], part[order]
        names, at = np.unique(part, return_index=True)
        blobs = [x.tobytes() for x in np.split(anchor, at[1:])] if len(names) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), pa.array(np.zeros(len(names)), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"]
        )

    return dealt.repartition(buckets, "bucket").mapInArrow(trimmed(run), "part int, kind int, blob binary")


class _Part:
    """The segments of a part that can repeat elsewhere; equal segments share a number."""

    def __init__(self, table: pa.Table, repeated: np.ndarray, copies: set[tuple[int, bytes]], length: int):
        # rows come in any order: texts of one id must get the same numbers each time
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")])).combine_chunks()
        self.table = table
        self.ids = table.column("id").to_numpy()
        self.flat, self.offsets = text_values(table.column("text"))
        self.length = length
        repeated = np.sort(repeated)
        self.copied = _copied(self.ids, self.flat, self.offsets, copies)
        starts, windows, anchors = [], [], []
        if len(repeated):
            for a, b in _chunks(self.offsets):
                piece = self.flat[self.offsets[a] : self.offsets[b]]
                start, n, anchor = segments(piece, self.offsets[a : b + 1] - self.offsets[a], length)
                at = np.minimum(np.searchsorted(repeated, anchor & ~ONE), len(repeated) - 1)
                anchor &= ~ONE
                held = (repeated[at] == anchor) & ~self.copied[a + np.searchsorted(self.offsets[a : b + 1] - self.offsets[a], start, side="right") - 1]
                starts.append(start[held] + self.offsets[a])
                windows.append(n[held])
                anchors.append(anchor[held])
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.windows = np.concatenate(windows) if windows else np.zeros(0, np.int64)
        self.anchor = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        numbers: dict[bytes, int] = {}
        raw = memoryview(np.ascontiguousarray(self.flat))
        number = [numbers.setdefault(bytes(raw[a : a + n + length - 1]), len(numbers)) for a, n in zip(self.start.tolist(), self.windows.tolist())]
        self.number = np.array(number, np.int64)
        self.content = list(numbers)


def _blob_of(table: pa.Table, kind: int, dtype) -> np.ndarray:
    rows = [np.frombuffer(b, dtype) for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()) if k == kind]
    return np.concatenate(rows) if rows else np.zeros(0, dtype)


def _copies_of(table: pa.Table) -> set[tuple[int, bytes]]:
    """(id, digest) of the copies."""
    rows = zip(table.column("kind").to_pylist(), table.column("copies").to_pylist())
    return {(c["id"], c["digest"]) for k, x in rows if k == 2 for c in x}


def _copied(ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray, copies: set[tuple[int, bytes]]) -> np.ndarray:
    """Which rows are copies; only rows whose id has one are hashed."""
    out = np.zeros(len(ids), bool)
    held = np.isin(ids, np.array([i for i, _ in copies], np.int64))
    for row in np.flatnonzero(held).tolist():
        digest = hashlib.sha256(np.ascontiguousarray(flat[offsets[row] : offsets[row + 1]])).digest()
        out[row] = (int(ids[row]), digest) in copies
    return out


def _dealt_segments(parts: DataFrame, repeated: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, part, blob): the distinct segments of each part, with the smallest and largest id that holds each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        names = ["bucket", "part", "blob"]
        types = [pa.int32(), pa.int32(), pa.binary()]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        held = _Part(left, _blob_of(right, 0, np.uint64), _copies_of(right), length)
        n = len(held.content)
        low, high, anchor = np.full(n, LAST), np.full(n, -LAST - 1), np.zeros(n, np.uint64)
        np.minimum.at(low, held.number, held.ids[held.row])
        np.maximum.at(high, held.number, held.ids[held.row])
        anchor[held.number] = held.anchor
        sizes = np.array([len(c) for c in held.content], np.int64)
        bucket = buckets_of(mix(anchor, 5), buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for k, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if y > x:
                own = order[x:y]
                head = np.stack([anchor[own].view(np.int64), own, low[own], high[own], sizes[own]])
                rows.append((k, np.int64(len(own)).tobytes() + head.tobytes() + b"".join([held.content[i] for i in own.tolist()])))
        part = left.column("part")[0].as_py()
        return pa.table([pa.array([k for k, _ in rows], types[0]), pa.array([part] * len(rows), types[1]), pa.array([v for _, v in rows], types[2])], names)

    return parts.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(run, "bucket int, part int, blob binary")


ANSWER = np.dtype([("number", "<u4"), ("first", "<u4"), ("last", "<u4"), ("least", "<i8")])


def least_ids(contents: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """For every window of the contents, in order, the smallest id over all equal windows (by suffix array)."""
    sizes = np.array([len(c) for c in contents], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.frombuffer(b"\0".join(contents) + b"\0" * 8, np.uint8)
    symbols = flat[: bounds[-1]].astype(np.int64) + 2
    symbols[bounds[1:] - 1] = 1
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    inside = np.arange(bounds[-1]) - bounds[:-1][owner] <= (sizes - length)[owner]
    order = suffix_array(symbols)
    order = order[inside[order]]
    grams = _grams(flat)
    same = np.ones(len(order) - 1, bool)
    for shift in [*range(0, length - 8, 8), length - 8]:
        same &= grams[order[1:] + shift] == grams[order[:-1] + shift]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    low = np.minimum.reduceat(least[owner[order]], first)
    out = np.zeros(bounds[-1], np.int64)
    out[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return out[inside]


def _distinct(contents: list[bytes], least: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Number of each content among the distinct ones, these, their smallest ids and their anchors."""
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(c, len(known)) for c in contents], np.int64)
    low, of = np.full(len(known), LAST), np.zeros(len(known), anchor.dtype)
    np.minimum.at(low, which, least)
    of[which] = anchor
    return which, list(known), low, of


def windows_least(contents: list[bytes], least: np.ndarray, anchor: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """``least_ids`` of distinct contents, by anchor: equal windows have equal anchors, so anchors are sorted apart, as
    many at once as make ``SORT_BYTES``. One anchor with more is cut into segments by anchors of another hash first. A
    segment that is alone with its anchor shares no window with another."""
    windows = np.array([len(c) for c in contents], np.int64) - length + 1
    bounds = np.concatenate([[0], np.cumsum(windows)])
    best = np.repeat(least, windows)
    order = np.argsort(anchor, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)

    def put(chosen: list[int], found: np.ndarray) -> None:
        at = 0
        for i in chosen:
            best[bounds[i] : bounds[i + 1]] = found[at : at + windows[i]]
            at += windows[i]

    def flush(chosen: list[int]) -> None:
        if chosen:
            put(chosen, least_ids([contents[i] for i in chosen], least[chosen], length))

    held: list[int] = []
    size = 0
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if b - a < 2:
            continue
        own = order[a:b].tolist()
        more = sum(len(contents[i]) for i in own)
        if more > SORT_BYTES and salt < 3:
            put(own, _cut_again([contents[i] for i in own], least[own], length, salt + 1))
            continue
        if size + more > SORT_BYTES:
            flush(held)
            held, size = [], 0
        held += own
        size += more
    flush(held)
    return best


def _cut_again(contents: list[bytes], least: np.ndarray, length: int, salt: int) -> np.ndarray:
    raw = b"".join(contents)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
    start, windows, anchor = segments(np.frombuffer(raw, np.uint8), offsets, length, salt)
    owner = np.searchsorted(offsets, start, side="right") - 1
    which, distinct, low, of = _distinct([raw[a : a + n + length - 1] for a, n in zip(start.tolist(), windows.tolist())], least[owner], anchor)
    found = windows_least(distinct, low, of, length, salt)
    bounds = np.concatenate([[0], np.cumsum([len(c) - length + 1 for c in distinct])])
    return np.concatenate([found[bounds[w] : bounds[w + 1]] for w in which.tolist()])


def _answers(dealt: DataFrame, length: int, buckets: int) -> DataFrame:
    """(part, kind, blob): for segments of each part, runs of windows and the smallest id that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, contents, parts = [], [], []
        for batch in batches:
            for part, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                raw = blob.as_buffer()
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                head = np.frombuffer(raw, np.int64, 5 * n, 8).reshape(5, n)
                heads.append(head)
                parts.append(np.full(n, part, np.int32))
                at, view = 8 + 40 * n, memoryview(raw)
                for size in head[4].tolist():
                    contents.append(bytes(view[at : at + size]))
                    at += size
        if not heads:
            return
        anchor, number, low, high, _ = np.concatenate(heads, axis=1)
        part = np.concatenate(parts)
        which, distinct, least, of = _distinct(contents, low, anchor)
        contents.clear()
        bounds = np.concatenate([[0], np.cumsum([len(c) - length + 1 for c in distinct])])
        best = windows_least(distinct, least, of, length)
        new = np.ones(len(best), bool)
        new[1:] = best[1:] != best[:-1]
        new[bounds[:-1]] = True
        run_at = np.flatnonzero(new)
        run_end = np.append(run_at[1:], len(best))
        first_run = np.searchsorted(run_at, bounds)
        # each occurrence gets the runs of its segment that begin before its own largest id
        counts = (first_run[1:] - first_run[:-1])[which]
        rows = np.repeat(np.arange(len(which)), counts)
        runs = np.repeat(first_run[:-1][which] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        keep = best[run_at[runs]] < high[rows]
        rows, runs = rows[keep], runs[keep]
        order = np.argsort(part[rows], kind="stable")
        rows, runs = rows[order], runs[order]
        answer = np.empty(len(rows), ANSWER)
        answer["number"] = number[rows]
        answer["first"] = run_at[runs] - bounds[which[rows]]
        answer["last"] = run_end[runs] - bounds[which[rows]]
        answer["least"] = best[run_at[runs]]
        names, at = np.unique(part[rows], return_index=True)
        blobs = [x.tobytes() for x in np.split(answer, at[1:])] if len(names) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), pa.array(np.ones(len(names)), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"]
        )

    return dealt.repartition(buckets, "bucket").mapInArrow(trimmed(run), "part int, kind int, blob binary")


def _covered(held: _Part, answers: np.ndarray) -> np.ndarray:
    """Which bytes of the part are removed."""
    edge = np.zeros(len(held.flat) + 1, np.int32)
    if len(answers) and len(held.number):
        answers = answers[np.argsort(answers["number"], kind="stable")]
        first = np.searchsorted(answers["number"], held.number)
        counts = np.searchsorted(answers["number"], held.number, side="right") - first
        rows = np.repeat(np.arange(len(held.number)), counts)
        a = answers[np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        cut = a["least"] < held.ids[held.row[rows]]
        rows, a = rows[cut], a[cut]
        np.add.at(edge, held.start[rows] + a["first"], 1)
        np.add.at(edge, held.start[rows] + a["last"].astype(np.int64) - 1 + held.length, -1)
    sizes = np.diff(held.offsets)
    for row in np.flatnonzero(held.copied & (sizes >= held.length)).tolist():
        edge[held.offsets[row]] += 1
        edge[held.offsets[row + 1]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _whole_characters(flat: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Removed bytes without those of characters that are not removed whole."""
    if not len(flat):
        return gone
    lead = np.flatnonzero((flat & 0xC0) != 0x80)
    whole = np.logical_and.reduceat(gone, lead)
    return np.repeat(whole, np.diff(np.append(lead, len(flat))))


def dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept, the remaining text
    as whole characters (a character of which only some bytes are covered stays). Columns named in carry are handed on."""
    docs = bounded_batches(docs)
    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    types = [docs.schema[c].dataType.simpleString() for c in carry]
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), *carried)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts_for(size, PART_BYTES)
    part = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    parts = docs.select(part.alias("part"), "*").repartition(n, "part")
    # every reader takes the same columns, so that the corpus is shuffled by one exchange
    digests = docs.select("id", F.unhex(F.sha2("text", 256)).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    later = digests.join(firsts, "digest").where("id > first").select(part.alias("part"), "id", "digest").distinct()
    none = F.lit(None)
    copies = later.groupBy("part").agg(F.collect_list(F.struct("id", "digest")).alias("copies"))
    copies = copies.select("part", F.lit(2).alias("kind"), none.cast("binary").alias("blob"), "copies")
    no_copies = none.cast("array<struct<id:bigint,digest:binary>>")
    repeated = _repeated(_dealt_anchors(parts, copies, length, n), n).withColumn("copies", no_copies)
    answers = _answers(_dealt_segments(parts, repeated.union(copies), length, n), length, n).withColumn("copies", no_copies)

    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.string())] if with_text else []

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        if not left.num_rows:
            columns = [pa.array([], t) for _, t in fields] + [left.column(c) for c in passed]
            return pa.table(columns, [f for f, _ in fields] + passed)
        held = _Part(left, _blob_of(right, 0, np.uint64), _copies_of(right), length)
        gone = _covered(held, _blob_of(right, 1, ANSWER))
        soft = _whole_characters(held.flat, gone) if with_text else gone
        out: dict[str, list] = {f: [] for f, _ in fields}
        cuts = held.offsets.tolist()
        for id_, a, b in zip(held.ids.tolist(), cuts, cuts[1:]):
            cover = gone[a:b]
            out["id"].append(id_)
            out["n_bytes"].append(b - a)
            out["n_removed"].append(int(cover.sum()))
            out["n_spans"].append(int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(held.flat[a:b][~cover].tobytes()).hexdigest())
            if with_text:
                out["kept"].append(held.flat[a:b][~soft[a:b]].tobytes().decode())
        columns = [pa.array(out[f], t) for f, t in fields] + [held.table.column(c) for c in passed]
        return pa.table(columns, [f for f, _ in fields] + passed)

    passed = [f"carried_{i}" for i in range(len(carry))]
    schema = ", ".join([f"{f} {'string' if t == pa.string() else 'bigint'}" for f, t in fields] + [f"{c} {t}" for c, t in zip(passed, types)])
    found = parts.groupBy("part").cogroup(repeated.union(answers).union(copies).groupBy("part")).applyInArrow(finish, schema)
    own = [F.nullif(F.col("id"), F.lit(LAST)).alias(id_col), *(f for f, _ in fields[1:])]
    return found.select(*own, *[F.col(p).alias(c) for p, c in zip(passed, carry)])
