"""Benchmark decontamination by an FM-index of every training shard.

Words are runs of digits, letters and characters beyond ASCII, A-Z lowered, compared by 64-bit hashes. A phrase is a window
of ``window`` consecutive words of a benchmark item, or the whole of a shorter item.

Shard. About 2 MB of whole documents, in one task. Its text is the sequence of its words as symbols of the benchmark's
vocabulary; what lies between (other words, the ends of documents) is one separator, as no phrase can cross it. Separators
differ from each other, in order of position.
Index. The suffix array comes by prefix doubling: the first key holds as many symbols as 64 bits hold, later rounds sort
only suffixes that are still tied. Of it stay the Burrows-Wheeler transform as a wavelet matrix with bit counts for each 64
bits, the symbol counts, and positions of every 16th symbol and of those behind a separator.
Search. All phrases step backwards at once; ranges that run empty leave. Rows of the ranges that are left walk back by
rank to a sampled position, which tells the words hit. Hits of a document are merged into spans.

Texts beyond a shard's size are cut between words, and a piece begins with the last words of the one before, so that no
phrase is lost. Phrases come to the tasks in blocks of bounded size, one narrow pass over the documents for each block;
nothing is shuffled. Rows of an item that repeat its id add up; items without an id mark words but are not named.

Null, empty and wordless texts have no words and no hits. Documents that repeat an id, or have none, are rows of their
own. Without items there are no hits. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.llm.common import mix, slices, text_values
from faultlines.llm.shingles import _powers

SHARD_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
SAMPLED = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of every word, and the number of words before each row (rows + 1 values)."""
    low = _LOWER[flat]
    inside = np.zeros(len(flat) + 2, np.int8)
    inside[1:-1] = _WORD[low]
    step = np.diff(inside)
    cut = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(flat))]
    touching = np.unique(cut[(inside[cut] > 0) & (inside[cut + 1] > 0)])  # a word ends where its row ends
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(touching):
        begin, end = np.sort(np.concatenate([begin, touching])), np.sort(np.concatenate([end, touching]))
    up, down = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    return begin, end, mix((sums[end] - sums[begin]) * down[begin]), np.searchsorted(begin, offsets)


@dataclass
class Phrases:
    """Phrases as slices of the items' symbols; symbol k + 1 is the word with the k-th hash."""

    hashes: np.ndarray
    symbols: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    names: list[str | None]


def phrases(items: list[tuple[str | None, str | None]], window: int) -> Phrases:
    """All windows of (id, text) rows."""
    _, _, h, cuts = words(*text_values(pa.array([t or "" for _, t in items], pa.string())))
    hashes, symbols = np.unique(h, return_inverse=True)
    start, length, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        if b > a:
            own = np.arange(a, max(a, b - window) + 1)
            start.append(own)
            length.append(np.full(len(own), min(window, b - a)))
            item.append(np.full(len(own), k))
    return Phrases(hashes, symbols.astype(np.int64) + 1, np.concatenate(start), np.concatenate(length), np.concatenate(item), [i for i, _ in items])


class Bits:
    """A bit vector that counts ones before any position."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        own = np.packbits(bits, bitorder="little")
        packed[: len(own)] = own
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """Wavelet matrix: ranks of symbols and the symbol at a position, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(bit), len(bit) - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i comes to stand in the lowest level, for a symbol."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and where i comes to stand."""
        symbol = np.zeros(len(i), np.int64)
        for _, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
            symbol = symbol << 1 | one
        return symbol, i


def suffix_array(symbols: np.ndarray, size: int) -> np.ndarray:
    """Suffixes in order; 0 is a separator, each its own symbol and below all words, and the last symbol is one."""
    n, parts = len(symbols), int((symbols == 0).sum())
    rank = np.where(symbols == 0, np.cumsum(symbols == 0) - 1, symbols + (parts - 1))
    width = int(parts + size).bit_length()
    h, key = 1, rank.astype(np.int64)
    while (h + 1) * width <= 63:
        key[:-h] = (key[:-h] << width) | rank[h:]
        key[-h:] <<= width
        h += 1
    sa = np.argsort(key)
    slots, change = np.arange(n), np.ones(n, bool)
    change[1:] = key[sa][1:] != key[sa][:-1]
    rank = np.empty(n, np.int64)
    while True:
        rank[sa[slots]] = np.maximum.accumulate(np.where(change, slots, 0))
        tied = ~change
        tied[:-1] |= ~change[1:]
        slots = slots[tied]
        if not len(slots):
            return sa
        own = sa[slots]
        key = (rank[own] << 32) | rank[own + h]
        order = np.argsort(key)
        sa[slots], key = own[order], key[order]
        change = np.ones(len(slots), bool)
        change[1:] = key[1:] != key[:-1]
        h *= 2


class Index:
    """FM-index of symbols below ``size``; the last symbol is a separator (0)."""

    def __init__(self, symbols: np.ndarray, size: int):
        order = suffix_array(symbols, size)
        before = np.where(order > 0, symbols[order - 1], 0)
        self.first = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(symbols, minlength=size), out=self.first[1:])
        self.wavelet = Wavelet(before, size)
        self.base = self.wavelet.down(np.arange(size), np.zeros(size, np.int64))
        marked = (order % SAMPLED == 0) | (before == 0)
        self.marks, self.samples = Bits(marked), order[marked]

    def search(self, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high): the rows of every phrase that occurs."""
        live = np.arange(len(p.start))
        last = p.symbols[p.start + p.length - 1]
        low, high = self.first[last], self.first[last + 1]
        done, step = [], 1
        while True:
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
            ended = p.length[live] == step
            done.append((live[ended], low[ended], high[ended]))
            live, low, high = live[~ended], low[~ended], high[~ended]
            if not len(live):
                return tuple(np.concatenate(x) for x in zip(*done))
            symbol = p.symbols[p.start[live] + p.length[live] - 1 - step]
            lift = self.first[symbol] - self.base[symbol]
            low, high = self.wavelet.down(symbol, low) + lift, self.wavelet.down(symbol, high) + lift
            step += 1

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their rows."""
        out, walked = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, rows = np.arange(len(rows)), rows.copy()
        while len(at):
            found = self.marks.get(rows).astype(bool)
            out[at[found]] = self.samples[self.marks.rank(rows[found])] + walked[at[found]]
            at, rows = at[~found], rows[~found]
            symbol, place = self.wavelet.at(rows)
            rows = self.first[symbol] + place - self.base[symbol]
            walked[at] += 1
        return out


def occurrences(h: np.ndarray, cuts: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every occurrence in the words of some rows, in the order of the index."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(p.hashes) or not len(h):
        return nothing
    at = np.searchsorted(p.hashes, h)
    at[at == len(p.hashes)] = 0
    known = np.flatnonzero(p.hashes[at] == h)
    if not len(known):
        return nothing
    apart = np.ones(len(known), bool)
    apart[1:] = np.diff(known) > 1
    first = np.zeros(len(h) + 1, bool)
    first[cuts] = True
    apart |= first[known]
    place = np.arange(len(known)) + np.cumsum(apart)
    symbols, word = np.zeros(place[-1] + 2, np.int64), np.zeros(place[-1] + 2, np.int64)
    symbols[place], word[place] = at[known] + 1, known
    index = Index(symbols, len(p.hashes) + 1)
    phrase, low, high = index.search(p)
    count = high - low
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(low) else low
    return np.repeat(phrase, count), word[index.locate(rows)]


def _pieces(flat: np.ndarray, reach: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, words before) of pieces of one text, each beginning ``reach`` words before the end of the last."""
    begin, before = 0, 0
    while True:
        end = begin + SHARD_BYTES
        while end < len(flat) and _WORD[_LOWER[flat[end]]]:
            end += 1
        end = min(end, len(flat))
        yield begin, end, before
        if end == len(flat):
            return
        starts, _, _, _ = words(flat[begin:end], np.array([0, end - begin]))
        back = min(reach, len(starts) - 1)
        if back > 0:
            before, begin = before + len(starts) - back, begin + int(starts[len(starts) - back])
        else:
            before, begin = before + len(starts), end


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    gap = np.flatnonzero(np.diff(hit) > 1)
    return hit[np.concatenate([[0], gap + 1])], hit[np.concatenate([gap, [len(hit) - 1]])]


def _marked(flat: np.ndarray, offsets: np.ndarray, p: Phrases, held: list[np.ndarray]) -> list[tuple[int, np.ndarray, set[str], list[tuple[int, int]]]]:
    """Of every row: number of words, words hit (also those held from earlier phrases), items, and spans of the bytes hit.
    A single long text goes in pieces."""
    rows = len(offsets) - 1
    if rows == 1 and len(flat) > SHARD_BYTES:
        return [_marked_long(flat, p, held[0])]
    starts, ends, h, cuts = words(flat, offsets)
    phrase, word = occurrences(h, cuts, p)
    order = np.argsort(word, kind="stable")
    phrase, word = phrase[order], word[order]
    at, out = np.searchsorted(word, cuts), []
    for k in range(rows):
        own, found = word[at[k] : at[k + 1]], phrase[at[k] : at[k + 1]]
        hit, named, places = held[k], set(), []
        if len(own):
            hit = np.union1d(hit, _covered(own, p.length[found]) - cuts[k])
            named = {p.names[i] for i in np.unique(p.item[found]).tolist()} - {None}
        if len(hit):
            first, last = _runs(hit + cuts[k])
            places = list(zip((starts[first] - offsets[k]).tolist(), (ends[last] - offsets[k]).tolist()))
        out.append((int(cuts[k + 1] - cuts[k]), hit, named, places))
    return out


def _marked_long(flat: np.ndarray, p: Phrases, held: np.ndarray) -> tuple[int, np.ndarray, set[str], list[tuple[int, int]]]:
    total, items = 0, set()
    hits, begins, ends_ = [held[:0]], [held[:0]], [held[:0]]
    for begin, end, before in _pieces(flat, int(p.length.max(initial=1)) - 1):
        starts, ends, h, cuts = words(flat[begin:end], np.array([0, end - begin]))
        phrase, word = occurrences(h, cuts, p)
        total = before + len(starts)
        own = held[(held >= before) & (held < total)] - before
        if len(word):
            own = np.union1d(own, _covered(word, p.length[phrase]))
            items |= {p.names[i] for i in np.unique(p.item[phrase]).tolist()} - {None}
        hits.append(own + before)
        begins.append(starts[own] + begin)
        ends_.append(ends[own] + begin)
    hit, at = np.unique(np.concatenate(hits), return_index=True)
    first, last = _runs(hit) if len(hit) else (hit, hit)
    opened, closed = np.concatenate(begins)[at], np.concatenate(ends_)[at]
    return total, hit, items, list(zip(opened[np.searchsorted(hit, first)].tolist(), closed[np.searchsorted(hit, last)].tolist()))


def _covered(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All words of the occurrences, sorted and distinct."""
    return np.unique(np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()))


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(p, more: bool, kind: str):
    """One pass over the documents with a block of phrases. more: the text is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = p.value
        for batch in batches:
            for piece in slices(batch, 1, SHARD_BYTES):
                flat, offsets = text_values(piece.column(1).fill_null(""))
                held = [np.frombuffer(x or b"", np.int64) for x in piece.column("hits").to_pylist()]
                n, hits, items, spans = [], [], [], []
                for (count, hit, named, places), old in zip(_marked(flat, offsets, own, held), piece.column("items").to_pylist()):
                    n.append(count)
                    hits.append(hit.astype(np.int64).tobytes())
                    items.append(sorted(named | set(old or [])))
                    spans.append([{"start": a, "end": b} for a, b in places])
                text = piece.column(1) if more else pa.nulls(piece.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), text, pa.array(n, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPAN)],
                    ["id", "text", "n_words", "hits", "items", "spans"],
                )

    return run, f"id {kind}, text string, n_words long, hits binary, items array<string>, spans array<struct<start:long,end:long>>"


def hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", with_text: bool = False,
) -> DataFrame:
    """(id, text, n_words, n_hit, items, spans) of every document: ids (as strings, sorted) of the items of which a phrase
    occurs, and the merged spans of UTF-8 bytes that phrases cover. text is null unless asked for."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hits"),
        F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"),
    )
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        p = spark.sparkContext.broadcast(phrases([(r.name, r.text) for r in own], window))
        run, schema = _pass(p, with_text or b < blocks - 1, kind)
        out = out.mapInArrow(run, schema)
    n_hit = F.coalesce(F.octet_length("hits") / 8, F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "text", "n_words", n_hit.alias("n_hit"), "items", "spans")


def removed(found: DataFrame) -> DataFrame:
    """``hits`` with its text, without the bytes that the spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, at, kept = (text or "").encode(), 0, []
                for s in spans:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                texts.append(None if text is None else b"".join([*kept, raw[at:]]).decode())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)
