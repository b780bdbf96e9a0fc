"""Operators on texts against brute force, on nulls, empties, ties, repeated rows, long texts and clashing names."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from faultlines.llm import bpe, common, fingerprints, jaccard_join, packing, secrets, suffix_dedup, token_counts

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> list[str]:
    return BLANKS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles(text: str, k: int) -> list[tuple]:
    words = lowered(text)
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def test_fingerprints(docs, rows, none, clashing):
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs, samples=32).collect()}
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    assert set(got) == set(order)
    errors, prints = [], defaultdict(set)
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(got[i].fingerprint)
        for other, near in ((edited, got[i].near_edited), (after, got[i].near_next)):
            a, b = Counter(shingles(text, 5)), Counter(shingles(other, 5))
            union = sum((a | b).values())
            exact = sum((a & b).values()) / union if union else 1.0
            assert 0 <= near <= 1 and abs(near - exact) < 0.45
            errors.append(near - exact)
    assert abs(np.mean(errors)) < 0.03
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.fingerprint(none, samples=8).collect() == []
    assert sorted(str(r.doc_id) for r in fingerprints.fingerprint(clashing, samples=8).collect()) == ["1", "1", "None"]


def test_gamma_draws_have_the_right_moments(spark):
    q, c = np.array(fingerprints.gamma_quantiles(1024)), np.array(fingerprints.gamma_slices(1024))
    assert abs(q.mean() - 2) < 0.01 and abs(q.var() - 2) < 0.05
    assert abs((1 / c).mean() - 1) < 1e-9 and (np.diff(c) > 0).all()
    shares, tail = [1.0, 0.1, 1e-3, 1e-5, 1e-9], fingerprints.TAIL / fingerprints.QUANTILES
    rows = spark.createDataFrame([(p,) for p in shares], "q double").select("q", fingerprints.gamma_tail(F.col("q")).alias("x")).collect()
    assert len(rows) == 5 and all(abs((1 + r.x) * np.exp(-r.x) / (r.q * tail) - 1) < 0.03 for r in rows)


def test_long_texts_with_repeated_shingles_have_no_bias(spark):
    rng, rows, exact = np.random.default_rng(5), [], []
    for pair in range(6):
        words = [f"w{v}" for v in rng.integers(0, 1 << 30, 18000)]
        passage = words[:2000]
        a, b = " ".join(words), " ".join(words + passage * (3 + pair))
        left, right = Counter(shingles(a, 5)), Counter(shingles(b, 5))
        exact.append(sum((left & right).values()) / sum((left | right).values()))
        rows += [(pair, 0, a), (pair, 1, b)]
    found = fingerprints.signatures(spark.createDataFrame(rows, "pair int, side int, text string").repartition(8), ["pair", "side"], "text", 512).collect()
    signature = {(r.pair, r.side): np.array(r.signature) for r in found}
    near = [(signature[i, 0] == signature[i, 1]).mean() for i in range(6)]
    assert abs(np.mean(near) - np.mean(exact)) < 0.02, (near, exact)


def check_packed(found, ids, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[i])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    fills = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        fills.append(at)
    assert sum(f < window for f in fills) <= 1  # only the last sequence has padding


@pytest.mark.parametrize("window", [4096, 256])
def test_packing(docs, rows, none, library, window):
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows}
    check_packed(packing.pack(docs, WORD, 2, window).collect(), ids, window)
    assert packing.pack(none, WORD, 2, window).collect() == []


def test_packing_keeps_repeated_rows(clashing):
    assert sorted(str(r.doc_id) for r in packing.pack(clashing, WORD, 2).collect()) == ["1", "1", "None"]


def test_nnls_finds_an_exact_mix():
    ways = packing.combinations(16, 3)
    use = np.array([[way.count(b) for way in ways] for b in range(1, 17)], float)
    target = use @ np.where(np.arange(len(ways)) % 5 == 0, 7.0, 0.0)
    x = packing.nnls(use, target)
    assert (x >= 0).all() and np.abs(use @ x - target).max() < 0.1


def test_bpe(docs, rows, none, clashing, library):
    found = {r.doc_id: r for r in bpe.digests(docs, WORD).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.encode(docs, WORD)
    shown = {r.doc_id: r.text for r in bpe.decode(encoded, WORD).collect()}
    assert all(shown[i] == library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in rows)
    assert bpe.encode(none, WORD).collect() == [] and bpe.digests(clashing, WORD).count() == 3


def test_bpe_with_a_full_cache(rows, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    own = bpe.PairIndexBpe(WORD)
    for i in range(0, len(rows), 4):
        texts = [t for _, t in rows[i : i + 4]]
        for t, pieces in zip(texts, own.encode(texts)):
            assert np.frombuffer(b"".join(pieces), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaa", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "é Å", "a\x1cb\x85c　d", "<|endoftext|><|startoftext|>x<|", "it's I'LL don’t 'S", "½²x_y__ ²"])
def test_bpe_on_odd_texts(text, library):
    pieces = bpe.loaded(WORD).encode([text])[0]
    assert np.frombuffer(b"".join(pieces), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, rows, none, clashing, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECE)
    odd = ["", " ", "  a", "a ", "a  b   ", "▁x▁▁y", "<s>x</s>", "\x00a", "a\r\n b", "é" * 100]
    for table in ({}, {"a": 1}):
        own = token_counts.Lengths(PIECE, table)
        assert [own.count(t) for t in odd] == [len(model.encode(t)) for t in odd]
    for r in token_counts.count(docs, PIECE, 100, table=50).collect():
        text = dict(rows)[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(model.encode(text)), len(model.encode(text)) > 100)
    assert token_counts.count(none, PIECE, 5).collect() == [] and token_counts.count(clashing, PIECE, 5).count() == 3


def brute_removed(rows, length):
    least: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            least[raw[p : p + length]] = min(i, least.get(raw[p : p + length], i))
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("length", [50, 20])
def test_suffix_dedup(docs, rows, none, clashing, length):
    found = suffix_dedup.dedup(docs, length, with_text=True, carry=("lang",)).collect()
    want = brute_removed(rows, length)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] and r.lang == "en"
        assert r.n_bytes - r.n_removed <= len(r.kept.encode()) <= r.n_bytes
    assert suffix_dedup.dedup(none, length).collect() == [] and suffix_dedup.dedup(clashing, length).count() == 3


def test_suffix_dedup_copies_under_a_shared_id(spark):
    """A copy takes no other text of its id with it, nor other rows without an id, and these stay sources."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (5, c), (5, d), (7, "x " + d), (9, e + " y"), (5, a)]
    found = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50, with_text=True).collect()
    last = 1 << 62
    want = brute_removed([((i or last) * 100 + k, t) for k, (i, t) in enumerate(rows)], 50)
    # rows of one id do not remove each other's bytes: the second (None, b) stays
    expected = [(i, *want[(i or last) * 100 + k][1:]) for k, (i, t) in enumerate(rows) if k != 3]
    expected.append((None, 0, 0, hashlib.sha256(b.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in found], key=key) == sorted(expected, key=key)
    assert sum(r.n_removed for r in found if r.doc_id == 7) == len(d)


@pytest.mark.parametrize("n,k", [(0, 1), (1, 1), (33, 1), (34, 2), (35, 3), (200, 2), (301, 250), (500, 1)])
def test_suffix_array(n, k):
    s = np.random.default_rng(n).integers(1, k + 1, n)
    text = s.tolist()
    assert suffix_dedup.suffix_array(s, small=4).tolist() == sorted(range(n), key=lambda i: text[i:])


def components_of(nodes, links):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in nodes}


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(docs, rows, none, clashing, size, num):
    sets = {i: set(shingles(t or "", size)) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    found = jaccard_join.join(docs, size, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(sets[i]), want[i]) for i in sets}
    assert jaccard_join.join(none, size, num, 100).collect() == []
    assert sorted(str(r.component_id) for r in jaccard_join.join(clashing, size, num, 100).collect()) == ["1", "1", "None"]


def test_jaccard_three_texts_under_one_id(spark):
    """Copies of every text of an id are in its component, also of those between its least and largest class."""
    texts = [" ".join(f"{x}{k}" for k in range(1)) for x in "abcde"]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[3]), *[(9, t) for t in texts[:4]], (5, texts[4])]
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, 100).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 1), (5, 5)}


def test_jaccard_blocks_of_one_tile(spark, monkeypatch):
    """A tile in many blocks still meets all its pairs, without an edge that was there before."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if j != 3 + k else f"x{k}" for j, w in enumerate(words)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: set(shingles(t, 1)) for i, t in enumerate(texts)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 96 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    assert {r.doc_id: r.component_id for r in jaccard_join.join(docs, 1, 96, 100).collect()} == want


@pytest.mark.parametrize("num", [80, 85])
def test_tile_keys_never_lose_a_link(num):
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 60, 100, 333, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            most = (100 - num) * n // 100
            gone = rng.integers(0, most + 1)
            more = 0
            while 100 * (n - gone) >= num * (n + more + 1):
                more += 1
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 64, rng.integers(0, more + 1), dtype=np.uint64)])
            low = jaccard_join.bands(2 * n + 2, num, 100)
            x, y = (jaccard_join.tile_keys(np.sort(v), low, num, 100) for v in (a, b))
            equal = len(a) == len(b) and set(a.tolist()) == set(b.tolist())
            shared = set((x >> np.uint64(1)).tolist()) & set((y >> np.uint64(1)).tolist())
            assert equal or shared, (n, gone, len(b))


def der(*parts: bytes, tag: int = 0x30) -> bytes:
    body = b"".join(parts)
    head = bytes([len(body)]) if len(body) < 128 else bytes([0x82, len(body) >> 8, len(body) & 255])
    return bytes([tag]) + head + body


KEY = der(der(b"\x00", tag=2), *[der(bytes(range(1, 120)), tag=2) for _ in range(3)])


def test_secret_structure():
    b64 = base64.b64encode(KEY).decode()
    jwt = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256"}', b'{"sub":"1"}', b"sig"))
    fake = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"foo":"HS256"}', b'{"sub":"1"}', b"sig"))
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64)) + "\n-----END RSA PRIVATE KEY-----"
    kinds = lambda text: Counter(k for k, _, _ in secrets.confirmed_spans(text))
    assert kinds(f"x {jwt} y") == {"jwt": 1} and not kinds(f"x {fake} y")["jwt"]
    assert kinds(pem)["pem"] == 1 and kinds(pem.replace("MII", "MIJ", 1))["pem"] == 0
    assert kinds(f"k={b64}")["key"] in (0, 1) and kinds(f"x {b64} y")["key"] == 1
    assert kinds(f"x {KEY.hex()} y")["key"] == 1 and not kinds("x " + "ab" * 40 + " y")
    assert kinds("x " + base64.b64encode(b'password="hunter2hunter2"').decode() + " y") == {"wrapped": 1}
    assert not kinds("x " + base64.b64encode(b"only some plain words here").decode() + " y")


def armoured(data: bytes, label: str, head: str = "") -> str:
    b64 = base64.b64encode(data).decode()
    lines = [b64[i : i + 64] for i in range(0, len(b64), 64)]
    return f"-----BEGIN {label}-----\n{head}" + "\n".join(lines) + f"\n-----END {label}-----"


def test_secrets_after_names_and_with_escapes_and_headers():
    b64, kinds = base64.b64encode(KEY).decode(), lambda text: Counter(k for k, _, _ in secrets.confirmed_spans(text))
    for text in (f"k={b64}", f"PRIVATE_KEY={b64}\n", f"https://h/?k={b64}&x=1", f'"line\\n{b64}\\n"'):
        assert secrets.confirmed_spans(text) == [("key", text.index(b64), text.index(b64) + len(b64))]
    for run in (KEY.hex(), KEY.hex().upper(), KEY.hex()[:100] + KEY.hex()[100:].upper()):
        for text in (f"x 0x{run} y", f"x 0X{run} y", f"k={run}"):
            assert secrets.confirmed_spans(text) == [("key", text.index(run), text.index(run) + len(run))]
    pem = armoured(KEY, "PRIVATE KEY")
    dek = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    cipher = np.random.default_rng(1).integers(0, 256, 160, np.uint8).tobytes()
    locked = armoured(cipher, "RSA PRIVATE KEY", dek)
    for block in (pem, locked, armoured(KEY, "RSA PRIVATE KEY", "Comment: mine\nX-Note: a-b\n\n")):
        for text in (block, block.replace("\n", "\r\n"), block.replace("\n", "\\n"), block.replace("\n", "\\r\\n"), block.replace("\n", "\\\\n"), block.replace("/", "\\/")):
            assert ("pem", 2, 2 + len(text)) in secrets.confirmed_spans(f"x {text} y"), text
    assert secrets.redacted('{"private_key": "' + pem.replace("\n", "\\n") + '\\n"}', "#") == '{"private_key": "#\\n"}'
    assert not kinds(armoured(cipher, "RSA PRIVATE KEY")) and not kinds(armoured(cipher[:-3], "RSA PRIVATE KEY", dek))["pem"]
    assert not kinds(armoured(b"only some plain words stand here", "PRIVATE KEY"))["pem"]


def test_secret_scan(docs, rows, none, clashing):
    found = {r.doc_id: r for r in secrets.digests(secrets.scan(docs)).collect()}
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for i, t in rows:
        text = t or ""
        base = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 8]
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        r = found[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(b[2] for b in sorted(base)).encode()).hexdigest()
        assert set(b[2] for b in base) <= set(r.spans.split(",")) | {""}
    assert secrets.scan(none).collect() == [] and secrets.scan(clashing).count() == 3
    redacted = secrets.redact(docs)
    assert redacted.columns == docs.columns
    assert not any("0123456789abcdef0123456789abcdef" in (r.text or "") for r in redacted.collect())
    assert secrets.redact(clashing).columns == clashing.columns


def test_sets_with_many_empty_slices_share_no_tile_by_them():
    rng, low = np.random.default_rng(3), jaccard_join.bands(400, 80, 100)
    keys = [jaccard_join.tile_keys(np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)), low, 80, 100) for n in range(200, 300)]
    assert len(np.unique(np.concatenate(keys) >> np.uint64(1))) == sum(map(len, keys))


def test_jaccard_pairs_of_many_tiles_come_once(spark):
    same = [jaccard_join.bitmap(np.arange(40 + i % 2).astype(np.uint64)) for i in range(6)]
    bitmaps = spark.createDataFrame([(i, 40 + i % 2, same[i]) for i in range(6)], "id bigint, n bigint, bits binary")
    members = spark.createDataFrame([(t, i, i % 3, 6) for t in range(50) for i in range(6)], "tile bigint, id bigint, comp bigint, rows bigint")
    found = jaccard_join._tile_pairs(members, bitmaps, 80, 100).collect()
    assert sorted(map(tuple, found)) == [(a, b) for a in range(6) for b in range(a + 1, 6) if a % 3 != b % 3]


def test_flat_encoding(rows, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    texts = [*(t for _, t in rows), None, "", " ", "a <|endoftext|> b<|startoftext|><|ENDOFTEXT|> c", "don't DON'T x1,000 \u00c9\u6f22 " + "z" * 300]
    own = bpe.PairIndexBpe(WORD)
    for _ in range(3):
        for at in range(0, len(texts), 7):
            ids, cuts = own.encode_flat(texts[at : at + 7])
            for t, a, b in zip(texts[at : at + 7], cuts.tolist(), cuts[1:].tolist()):
                assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids
        assert len(own._flat) == own._bounds[-1] and len(own._number) == len(own._bounds) - 1


def test_flat_encoding_merges_short_words_in_rounds(library, monkeypatch):
    rng, lookups, real = np.random.default_rng(8), [], bpe.PairIndexBpe._ranks
    plain = [chr(c) for c in range(0x250) if bpe._PLAIN.fullmatch(chr(c)) and bpe._PLAIN.fullmatch(chr(c).lower())]
    letters = list("abcdeinorstuABC\u00e9\u00df\u00f1")
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 14, 4000)] + ["".join(rng.choice(plain, n)) for n in rng.integers(1, 30, 300)]
    words += [c * n for c in "aeo!0" for n in (2, 3, 4, 5, 7, 63, 64, 65, 200)] + ["".join(rng.choice(letters, 3000))]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(300)] + [" ".join(words), "\xa0a\t\xa0b\n", "a\x1fb \x85", "\u0130 \u6f22 don't, a!<|endoftext|>", "x <|endoftext|>"]
    texts = [x for t in texts for x in (t, None, "", " ")]
    own = bpe.PairIndexBpe(WORD)
    monkeypatch.setattr(bpe.PairIndexBpe, "_ranks", lambda self, a, b: lookups.append(len(a)) or real(self, a, b))
    for given in (texts, pa.array(["x", *texts, "y"])[1:-1], pa.array(texts, pa.large_string())):
        own = bpe.PairIndexBpe(WORD)
        ids, cuts = own.encode_flat(given)
        assert len(cuts) == len(texts) + 1
        for t, a, b in zip(texts, cuts.tolist(), cuts[1:].tolist()):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids
    lookups.clear()
    own = bpe.PairIndexBpe(WORD)
    short = [w for w in words if len(w) <= 14]
    assert own.encode_flat([" ".join(short)])[0].tolist() == library.encode(" ".join(short), add_special_tokens=False).ids
    assert len(lookups) <= 30  # rounds, not one look-up for each rank that is met
    assert own.encode_flat([])[1].tolist() == [0]


def test_a_worker_keeps_the_encoder_for_encoding_only():
    encode, other = common.trimmed(iter, keep=bpe.HELD), common.trimmed(iter)
    held = bpe.loaded(WORD)
    assert list(encode([1])) == [1] and bpe.loaded(WORD) is held
    assert list(other([1])) == [1] and not bpe._LOADED
