"""Decontamination against comparing every window with every position."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlines.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(docs, items, window):
    found = []
    spans = {}
    for item, text in items:
        own = WORD.findall(lowered(text))
        for k in range(max(1, len(own) - window + 1) if own else 0):
            spans.setdefault(tuple(own[k : k + window]), set()).add(item)
    lengths = {len(w) for w in spans}
    for doc, text in docs:
        own = [(m.group(), m.start(), m.end()) for m in WORD.finditer(lowered(text))]
        hit, named = set(), set()
        for n in lengths:
            for k in range(len(own) - n + 1):
                if (at := tuple(w for w, _, _ in own[k : k + n])) in spans:
                    hit |= set(range(k, k + n))
                    named |= spans[at]
        gone = []
        for k in sorted(hit):
            if gone and k - 1 in hit:
                gone[-1][1] = own[k][2]
            else:
                gone.append([own[k][1], own[k][2]])
        kept, at = "", 0
        for a, b in gone:
            kept, at = kept + (text or "")[at:a], b
        found.append((doc, len(own), len(hit), tuple(sorted(str(i) for i in named if i is not None)), None if text is None else kept + text[at:]))
    return sorted(found, key=repr)


def result(frame):
    return sorted(((r[0], r.n_words, r.n_hit, tuple(r["items"]), r.text) for r in D.removed(frame).collect()), key=repr)


@pytest.fixture(scope="module")
def tables(rows):
    """The hard texts, and items cut from them: long, short, of one word, repeated, without words, without an id."""
    rng = random.Random(4)
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(texts[0].split()[3:30])), (2, "a"), (3, "ab ab ab"), (4, None), (5, " .. "), (2, "ONE, Two.Three"), (None, " ".join(texts[5].split()[:14]))]
    items += [(10 + k, " ".join(rng.choice(texts).split()[2:20])) for k in range(12)]
    docs = list(rows)
    for k in range(30):
        own, part = rng.choice(texts).split(), rng.choice(items)[1] or ""
        at = rng.randrange(len(own) + 1)
        docs.append((500 + k, " ".join(own[:at]) + rng.choice([" ", "\n-- ", ", "]) + part.upper().replace(" ", rng.choice([" ", "; ", "\t"])) + " " + " ".join(own[at:])))
    return docs, items


@pytest.mark.parametrize("window", [10, 3, 1])
def test_as_brute_force(spark, tables, window):
    docs, items = tables
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = D.hits(frame, spark.createDataFrame(items, ITEMS), window, with_text=True)
    assert result(found) == expected(docs, items, window)


def test_blocks_of_phrases_and_pieces_of_texts(spark, tables, monkeypatch):
    docs, items = tables
    whole = [(1, " ".join(t or "" for _, t in docs)), (2, "word " * 3000), (3, None)]
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    frame = spark.createDataFrame(whole, "doc_id long, text string")

    def small(batches):  # pieces are cut in the workers
        D.SHARD_BYTES = 900
        yield from batches

    found = D.hits(frame.mapInArrow(small, frame.schema), spark.createDataFrame(items, ITEMS), 10, with_text=True)
    assert result(found) == expected(whole, items, 10)


def test_pieces_overlap(tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(D, "SHARD_BYTES", 150)
    p = D.phrases([(str(i), t) for i, t in items], 10)
    text = " ".join(t or "" for _, t in docs)
    raw = np.frombuffer(text.encode(), np.uint8)
    n, hit, _, _ = D._marked(raw, np.array([0, len(raw)]), p, [np.zeros(0, np.int64)])[0]
    want = expected([(1, text)], items, 10)[0]
    assert (n, len(hit)) == want[1:3]


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_and_index(seed):
    rng = np.random.default_rng(seed)
    size, n = int(rng.integers(2, 9)), int(rng.integers(1, 300))
    symbols = np.concatenate([rng.integers(0, size, n) if seed % 3 else np.full(n, 1), [0]])
    order = D.suffix_array(symbols, size)
    keys = [(0, i) if s == 0 else (1, int(s)) for i, s in enumerate(symbols)]
    assert order.tolist() == sorted(range(n + 1), key=lambda i: keys[i:])
    index = D.Index(symbols, size)
    assert index.locate(np.arange(n + 1)[symbols[order] > 0]).tolist() == order[symbols[order] > 0].tolist()


def test_empty_tables_and_clashing_columns(spark, none, clashing):
    items = spark.createDataFrame([(1, "words stand here twice")], ITEMS)
    assert D.hits(none, items).count() == 0
    assert [r.n_hit for r in D.hits(clashing, spark.createDataFrame([], ITEMS)).collect()] == [0, 0, 0]
    more = items.withColumns({"name": F.lit(1), "n_words": F.lit(2), "hits": F.lit(3)})
    assert sorted(r.n_hit for r in D.hits(clashing.withColumn("hits", F.lit(1)), more).collect()) == [0, 4, 4]
