"""Conversation repair against plain dynamic programming over (cost, audit), row by row."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from faultlines.llm import conversation_repair as C

TURNS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)
FOLLOWS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain(rows):
    """Least (cost, audit, turns) by relaxing all states row by row; rows: (role, text, fault)."""

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, turns) in list(best.items()):
                for to in FOLLOWS[state]:
                    if to != "s":
                        new = (cost + 2, audit + "I", turns + [({"u": "user", "a": "assistant"}[to], "")])
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, turns) in best.items():
            options = [(state, (cost + 3, audit + "D", turns))]
            if fault not in ("b", "d"):
                stay = cost + (fault == "t")
                if role[:1] in FOLLOWS[state]:
                    options.append((role[:1], (stay, audit + "K", turns + [(role, text)])))
                for to in FOLLOWS[state]:
                    if to != "s":
                        options.append((to, (stay + 2, audit + "R", turns + [({"u": "user", "a": "assistant"}[to], text)])))
            for to, new in options:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def expected(table):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of every id."""
    groups, ids = defaultdict(list), set()
    for conv, turn, role, text in table:
        ids.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        damage = zlib.crc32(key.encode()) % 20
        if damage == 0:
            continue
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        role = "user" if damage == 4 else role
        groups[conv] += [(turn, role, text)] * (2 if damage == 3 else 1)
    out = {}
    for conv in ids:
        rows = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {r[0] for r in rows} - {None}
        faults = [m[2] for m in marked]
        cost, audit, kept = plain(marked) if marked else (0, "", [])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest)
    return out


def result(frame):
    return {r.conv_id: tuple(r)[1:9] for r in frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.mark.parametrize("length", [0, 1, 2, 5, 8, 9, 16, 17, 40, 130, 700])
def test_edits_are_cheapest_and_least(length):
    rng = random.Random(length)
    for _ in range(300 if length < 20 else 12):
        kinds = "".join(rng.choice("xsuaoSUAO" if rng.random() < 0.5 else "uaua") for _ in range(length))
        rows = [({"o": "other"}.get(k.lower(), k.lower()), str(i), "b" if k == "x" else "t" if k.isupper() else "") for i, k in enumerate(kinds)]
        codes, state = C.edits(kinds, C.START, C.END)
        codes += C.END_CODES[state]
        cost, audit, turns = plain(rows)
        assert (C.cost(kinds, codes), codes.translate(C.AUDIT)) == (cost, audit)
        assert list(C.turns_of(codes, [(r, t) for r, t, _ in rows])) == turns


def conversations():
    """Short ones, one that holds a third of all rows, null ids, turns, roles and texts, other roles, repeats, blanks."""
    rng = random.Random(9)
    says = ["Hello there.", "No end", "", "  \n", "Why?", "Done! ", None, "é…", "x" * 3000, "Same words."]
    rows = []
    for conv in [*range(60), None]:
        for turn in rng.sample(range(12), rng.randint(1, 9)):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "tool", None, "ua", ""]), rng.choice(says)))
    rows += [(1000, t, "user" if t % 2 else "assistant", f"turn {t % 150}." if t % 9 else "cut") for t in range(400)]
    # of one turn only one row, since their order is free
    return list({(r[0], r[1]): r for r in rows}.values())


def test_as_plain(spark):
    table = conversations()
    frame = spark.createDataFrame(table, TURNS).repartition(5)
    assert result(C.repair(frame)) == expected(table)


def test_long_conversation_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_BYTES", 700)
    table = conversations()
    frame = spark.createDataFrame(table, TURNS).repartition(4)
    walked = C._walked(frame, "conv_id", "turn", "role", "text").where("kind is not null and key = '=1000'")
    assert walked.select("part").distinct().count() > 5
    assert result(C.repair(frame)) == expected(table)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 5, "user", "Same.")] * 40 + [(2, None, "user", "One.")] * 3
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as key", "'p' as part", "0 as pos", "'z' as kind", "2 as digest", "3 as cost")
    assert result(C.repair(frame)) == expected(rows)


def test_empty_table_and_dropped_rows(spark):
    assert C.repair(spark.createDataFrame([], TURNS)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = result(C.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS)))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
