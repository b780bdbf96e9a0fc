"""BPE encoding and decoding with a pair occurrence index.

All words of a block that the worker has not met are laid out as one chain of symbols. An index maps every pair
that has a merge to all its positions. The active ranks are applied in ascending order: each merge visits the
listed positions from left to right, and the pairs that it makes are added to their own lists. A merge can only make
pairs of higher rank, because the parts of every merge were made by earlier ones; this is checked on loading.

Text rules are those of the vocabulary file: special tokens are cut out first, then NFC, white space and lower case
are normalised, and pieces between white space are split into words. Null and empty texts give no ids. Texts of any
length are encoded whole. A worker keeps the ids of the pieces it has met, up to a fixed number. ``encode`` hands them out
piece by piece, ``encode_flat`` numbers the pieces and gathers the ids of a block of texts in one array. Arrow splits its
plain texts, each distinct piece of a block is looked up once, and short words it has not met are merged in rounds: the pairs of
least rank of every word at once, which gives each word the same merges in the same order as the index.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from faultlines.llm.common import bounded_batches, holds, text_values

# In these texts, Python's lower case and white space are those of the vocabulary's normaliser, and NFC changes nothing.
_PLAIN = re.compile("[\t-\r\x20-~\xa0-įı-ɏ]*")
_PLAIN_ARROW = r"\A[\t-\r\x20-~\x{a0}-\x{12f}\x{131}-\x{24f}]*\z"
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-ɏ]+")
_WORDS_OR_BLANK = re.compile(_WORDS.pattern + "| ")
CACHE_PIECES = 500_000
CACHE_LENGTH = 64
CACHE_IDS = 4_000_000
BLOCK = 2500
SHORT = 64
NO_RANK = (1 << 31) - 1


def _byte_marks() -> list[str]:
    """The printable character that stands for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def _gathered(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of these rows one after the other, and how many each has; row i is flat[bounds[i] : bounds[i + 1]]."""
    sizes = np.diff(bounds)[rows]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(bounds[:-1][rows] - (ends - sizes), sizes) + np.arange(total)], sizes


class PairIndexBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        marks = _byte_marks()
        self.first, self.last = np.array([vocab[m] for m in marks]), np.array([vocab[m + end] for m in marks])
        self.unmark = {m: i for i, m in enumerate(marks)}
        self.made: list[tuple[int, int, int]] = []
        born: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, new = vocab[a], vocab[b], vocab[a + b]
            if max(born.get(a, -1), born.get(b, -1)) >= rank or new in born:
                raise ValueError("a merge uses a symbol that no earlier merge made")
            born[new] = rank
            self.made.append((a, b, new))
        keys = np.array([a << 32 | b for a, b, _ in self.made], np.int64)
        self.new = np.array([new for _, _, new in self.made])
        self.key_ranks = np.argsort(keys)
        self.keys = keys[self.key_ranks]
        self._start_anew([], np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.pieces: dict[str, bytes] = {}
        self.shown: dict[bytes, str] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 where it has none."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian 32-bit integers."""
        flat, cuts = self.words_flat(words)
        ids = flat.tobytes()
        return [ids[4 * x : 4 * y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())]

    def words_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (not empty) in one array, and where each word's ids begin (words + 1 values)."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym, n = self.first[flat], len(flat)
        sym[ends - 1] = self.last[flat[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[0] = -1
        before[ends[:-1]] = -1
        places = np.flatnonzero(after >= 0)
        ranks = self._ranks(sym[places], sym[places + 1])
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        active, at = np.unique(ranks, return_index=True)
        index: dict[int, list] = {r: [places[x:y]] for r, x, y in zip(active.tolist(), at.tolist(), [*at[1:].tolist(), len(places)])}
        active = active.tolist()

        def listed(ranks: np.ndarray, where: np.ndarray) -> None:
            held = ranks >= 0
            for k, p in zip(ranks[held].tolist(), where[held].tolist()):
                if k in index:
                    index[k].append(p)
                else:
                    index[k] = [p]
                    heapq.heappush(active, k)

        while active:
            now = heapq.heappop(active)
            a, b, new = self.made[now]
            found = index.pop(now)
            if isinstance(found[0], np.ndarray):
                p = np.sort(np.concatenate([found[0], np.array(found[1:], np.int64)])) if len(found) > 1 else found[0]
            else:
                p = np.array(sorted(found), np.int64)
            q = after[p]
            held = (q >= 0) & (sym[p] == a)
            held &= sym[np.where(held, q, 0)] == b
            p, q = p[held], q[held]
            if a == b and len(p) > 1:  # of overlapping pairs the left one is merged
                taken, free = -1, []
                for i, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
                    if x != taken:
                        free.append(i)
                        taken = y
                p, q = p[free], q[free]
            if not len(p):
                continue
            r = after[q]
            sym[p], sym[q] = new, -1
            after[p], after[q] = r, -1
            right = r >= 0
            before[r[right]] = p[right]
            left = before[p]
            x, y = left[left >= 0], p[right]
            both = self._ranks(np.concatenate([sym[x], sym[y]]), np.concatenate([sym[p[left >= 0]], sym[r[right]]]))
            listed(both, np.concatenate([x, y]))
        kept = sym >= 0
        return sym[kept].astype("<u4"), np.concatenate([[0], np.cumsum(kept)[ends - 1]])

    def short_words_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """words_flat for many words of few symbols each: in every round the pairs of least rank of each word are merged, in all words at once. A
        round visits every symbol that is left, so long words go to the pair index."""
        if not words:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        flat, bounds = text_values(pa.array(words, pa.large_string()))
        sizes = np.diff(bounds)
        sym, of = self.first[flat], np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        sym[bounds[1:] - 1] = self.last[flat[bounds[1:] - 1]]
        rank = np.full(len(sym), NO_RANK, np.int32)
        inner = np.flatnonzero(of[:-1] == of[1:])
        rank[inner] = self._least_ranks(sym[inner], sym[inner + 1])
        ended, names = [], np.arange(len(words))
        while len(names):
            least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            done = least == NO_RANK
            if 4 * done.sum() >= len(done):
                over = np.repeat(done, sizes)
                ended.append((names[done], sizes[done], sym[over]))
                names, sizes, least = names[~done], sizes[~done], least[~done]
                sym, rank = sym[~over], rank[~over]
                of = np.repeat(np.arange(len(names), dtype=np.int32), sizes)
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank < NO_RANK))
            near = np.diff(at, prepend=-2) == 1
            if near.any():  # of overlapping pairs the left one is merged
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(near, 0, k))) % 2 == 0]
            sym[at] = self.new[rank[at]]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            sizes = sizes - np.bincount(of[at], minlength=len(names))
            sym, rank, of = sym[kept], rank[kept], of[kept]
            at = at - np.arange(len(at))
            rank[at] = NO_RANK
            left = at[at > 0] - 1
            right = at[at < len(sym) - 1]
            pairs = np.concatenate([left, right])
            pairs = pairs[of[pairs] == of[pairs + 1]]
            rank[pairs] = self._least_ranks(sym[pairs], sym[pairs + 1])
        names, sizes, sym = (np.concatenate(x) for x in zip(*ended))
        flat, sizes = _gathered(sym.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)]), np.argsort(names))
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    def _all_words_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """words_flat, short words in rounds and long ones by the pair index."""
        long = np.array([len(w) > SHORT for w in words], bool)
        if not long.any():
            return self.short_words_flat(words)
        flat, cuts = self.short_words_flat([w for w in words if len(w) <= SHORT])
        more, ends = self.words_flat([w for w in words if len(w) > SHORT])
        bounds = np.concatenate([cuts, cuts[-1] + ends[1:]])
        flat, sizes = _gathered(np.concatenate([flat, more]), bounds, np.argsort(np.argsort(long, kind="stable")))
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    def _least_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NO_RANK where it has none."""
        ranks = self._ranks(a, b)
        return np.where(ranks < 0, NO_RANK, ranks)

    def _plain_words(self, piece: str) -> list[str]:
        return _WORDS.findall(piece)

    def _other_words(self, text: str) -> list[str]:
        """Words of a text that needs the vocabulary file's own normaliser and splitter."""
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(self.unmark[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _plan(self, text: str) -> list[str | bytes]:
        """Pieces of a text, in order: strings to be encoded, or the ids of special tokens. White space never lies
        inside a word, so what stands between is encoded apart."""
        if "<|" not in text and _PLAIN.fullmatch(text):
            return text.lower().split()
        plan: list[str | bytes] = []
        for part in self._cut.split(text):
            if part in self.special:
                plan.append(self.special[part].to_bytes(4, "little"))
            elif _PLAIN.fullmatch(part):
                plan += part.lower().split()
            else:
                plan += self._other_words(part)
        return plan

    def encode(self, texts: list[str | None]) -> list[list[bytes]]:
        """For each text the ids of its pieces; joined they are the text's ids. Millions of live pieces and no cycles: the
        cyclic collector would only walk over them again and again."""
        running = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if running:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[list[bytes]]:
        plans = [self._plan(t) if t else [] for t in texts]
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
            self.shown.clear()
        known, fresh = self.pieces, {}
        out = [list(map(known.get, plan)) for plan in plans]
        holes = [i for i, ids in enumerate(out) if None in ids]
        missing: dict[str, list[str]] = {}
        for i in holes:
            for piece, ids in zip(plans[i], out[i]):
                if ids is None and type(piece) is str and piece not in missing:
                    missing[piece] = self._plain_words(piece) if _PLAIN.fullmatch(piece) else [piece]
        words = list({w for ws in missing.values() for w in ws if w not in known})
        ids = dict(zip(words, self.words(words)))
        for piece, ws in missing.items():
            fresh[piece] = b"".join([ids[w] if w in ids else known[w] for w in ws])
        for i in holes:
            out[i] = [(p if type(p) is bytes else fresh[p]) if v is None else v for p, v in zip(plans[i], out[i])]
        known.update((p, v) for p, v in fresh.items() if len(p) <= CACHE_LENGTH)
        return out

    def encode_flat(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (texts + 1 values)."""
        running = gc.isenabled()
        gc.disable()
        try:
            met = len(self._number)
            texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
            numbers, ends = self._numbered(pc.fill_null(texts.cast(pa.large_string()), ""))
            self._learn(met)
            ids, sizes = _gathered(self._flat, self._bounds, numbers)
            if len(self._number) > CACHE_PIECES or len(self._flat) > CACHE_IDS:
                again = np.zeros(len(self._number), bool)
                again[numbers] = True
                self._keep(np.flatnonzero(again[:met]))
            return ids, np.concatenate([[0], np.cumsum(sizes)])[ends]
        finally:
            if running:
                gc.enable()

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and where each text's begin; a piece without a number gets the next one. Plain texts are
        split by Arrow and looked up once for each distinct piece, what others need is planned one by one."""
        number = self._number
        plain = pc.and_not(pc.match_substring_regex(texts, _PLAIN_ARROW), pc.match_substring(texts, "<|"))
        # empty pieces beside outer white space have no ids
        split = pc.ascii_split_whitespace(pc.replace_substring(pc.utf8_lower(texts.filter(plain)), "\xa0", " "))
        pieces = split.flatten().dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        distinct = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
        numbers, sizes = distinct[pieces.indices.to_numpy()], split.value_lengths().to_numpy()
        if len(sizes) < len(texts):
            plans = [self._plan(t) for t in texts.filter(pc.invert(plain)).to_pylist()]
            others = np.array([number[p] for plan in plans for p in plan], np.int64)
            bounds = np.concatenate([[0], np.cumsum([*sizes.tolist(), *map(len, plans)])])
            order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
            numbers, sizes = _gathered(np.concatenate([numbers, others]), bounds, np.argsort(order))
        return numbers, np.concatenate([[0], np.cumsum(sizes)])

    def _start_anew(self, pieces: list[str | bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Numbers of these pieces, and their ids one after the other."""
        self._number = defaultdict(count(len(pieces)).__next__, zip(pieces, range(len(pieces))))
        self._flat, self._bounds = flat, np.concatenate([[0], np.cumsum(sizes)])

    def _keep(self, numbers: np.ndarray) -> None:
        """Forgets all pieces but these; when the worker has met too many, those that it meets again stay."""
        numbers = numbers[np.diff(self._bounds)[numbers] <= CACHE_LENGTH][: CACHE_PIECES // 2]
        pieces = list(self._number)
        self._start_anew([pieces[i] for i in numbers.tolist()], *_gathered(self._flat, self._bounds, numbers))

    def _learn(self, met: int) -> None:
        """Ids of the pieces from number ``met`` on. Pieces of several words are put together from those of their words, which get numbers
        too."""
        number = self._number
        fresh = list(islice(number, met, None))
        mixed = [p for p in fresh if type(p) is str and not p.isalpha()]
        if not _PLAIN.fullmatch(" ".join(mixed)):
            mixed = [p for p in mixed if _PLAIN.fullmatch(p)]
        found = _WORDS_OR_BLANK.findall(" ".join(mixed))
        blank = np.fromiter(map(" ".__eq__, found), bool, len(found))
        words = [w for w in found if w != " "]
        of = np.fromiter(map(number.__getitem__, mixed), np.int64, len(mixed))
        owner = of[np.cumsum(blank)[~blank]]
        parts = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        new = len(number) - met
        single = np.ones(new, bool)
        single[of - met] = False
        single[owner[owner == parts] - met] = True
        owner, parts = owner[owner != parts], parts[owner != parts]
        at = np.flatnonzero(single)
        fresh += islice(number, met + len(fresh), None)
        whole = [fresh[i] for i in at.tolist()]
        special = np.array([type(w) is bytes for w in whole], bool)
        flat, cuts = self._all_words_flat([w for w in whole if type(w) is str])
        names = np.array([int.from_bytes(w, "little") for w in whole if type(w) is bytes], np.uint32)
        sizes, first = np.zeros(new, np.int64), np.zeros(new, np.int64)
        sizes[at[~special]], first[at[~special]] = np.diff(cuts), cuts[:-1]
        sizes[at[special]], first[at[special]] = 1, len(flat) + np.arange(len(names))
        flat = np.concatenate([flat, names])
        # ids of single words, in order of their numbers; pieces of several words have none yet
        base = np.concatenate([[0], np.cumsum(sizes)])
        alone = flat[np.repeat(first - base[:-1], sizes) + np.arange(base[-1])]
        held = np.concatenate([self._flat, alone])
        bounds = np.concatenate([self._bounds, self._bounds[-1] + base[1:]])
        if len(parts):
            joined, lengths = _gathered(held, bounds, parts)
            np.add.at(sizes, owner - met, lengths)
            order = np.argsort(np.concatenate([np.repeat(np.arange(new), np.diff(base)), np.repeat(owner - met, lengths)]), kind="stable")
            alone = np.concatenate([alone, joined])[order]
            held = np.concatenate([self._flat, alone])
            bounds = np.concatenate([self._bounds, self._bounds[-1] + np.cumsum(sizes)])
        self._flat, self._bounds = held, bounds

    def decode(self, pieces: list[bytes]) -> str:
        """Tokens joined by blanks: the vocabulary file names no decoder."""
        shown, tokens, out = self.shown, self.tokens, []
        for piece in pieces:
            text = shown.get(piece)
            if text is None:
                text = " ".join([tokens[i] for i in np.frombuffer(piece, "<u4").tolist()])
                if len(piece) <= 4 * CACHE_LENGTH and len(shown) < CACHE_PIECES:
                    shown[piece] = text
            out.append(text)
        return " ".join([t for t in out if t])


_LOADED: dict[str, PairIndexBpe] = {}
HELD = "bpe"


def loaded(path: str) -> PairIndexBpe:
    """One encoder for each vocabulary file and worker process, as long as the worker encodes."""
    holds(HELD, _LOADED.clear)
    if path not in _LOADED:
        _LOADED[path] = PairIndexBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids as an array."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                flat = [b"".join(x) for x in bpe.encode(piece.column(1).to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in flat])]).astype(np.int32)
                values = np.frombuffer(b"".join(flat), "<u4").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], [id_col, "ids"])

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, text of the array column ``ids``."""
    schema = f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode([np.asarray(x or [], "<u4").tobytes()]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text; counts and hashes of both results."""
    import hashlib

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                counts, ids, texts = [], [], []
                for pieces in bpe.encode(piece.column(1).to_pylist()):
                    flat = b"".join(pieces)
                    counts.append(len(flat) // 4)
                    ids.append(hashlib.sha256(flat).hexdigest())
                    texts.append(hashlib.sha256(bpe.decode(pieces).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, schema)
