"""Conversation structure repair by the auction shortest-path algorithm.

The rows of a conversation are layers of a lattice with four nodes each: nothing kept yet, after a system turn, after a
user turn, after an assistant turn. Arcs are edits with integer costs: D (delete, 3), K (keep, 0), R (rerole, 2), I (insert,
2), one more where a truncated row stays. Blank and repeated rows can only be deleted. A path that ends with nothing or after an assistant turn spells
initials of the form (s?(ua)+)?.

Auction. Every node has a price, at first 0. A path grows from the origin: where the end's price is below the least of
(cost + price of the next node) it is raised to that and the path contracts by one node, else the path is extended along
that arc. At the sink the price of the origin is the least cost, and every arc of every cheapest path is tight (its cost is
the difference of its prices). The cheapest edits that are least in ASCII are traced along tight arcs in the order D, I, K, R;
arcs that lead nowhere are left again.

Long conversations. Blocks of a few rows are solved for each pair of nodes at their ends, blocks of blocks again by auctions
over the costs found, and so on; then prices at the block ends tell each block how to finish. The cheapest edits are the same.

Spark. Rows are sorted by range of (conversation, turn, role, hash of text), so a conversation of any length is spread over
partitions. Conversations that lie inside one partition are repaired there. Those at a partition's ends are stored as
segments: their repeated rows are found by an aggregation, each segment is solved for all pairs of ends, one group per conversation with
a few numbers a segment joins them, and each segment is then traced on its own. Only the digest of all repaired turns,
which is sequential by nature, reads a split conversation in one task, as a stream.

Nulls: a null id, turn, role or text reads as one blank in all strings; null turns sort first and count in no gap. Rows of
one turn sort by role and a hash of the text. A conversation without rows (all dropped) has zeros, an empty audit and the digest of
the empty string. An empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlines.llm.common import parts_for, stored

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where a kept row leads, by state and initial; where a rerole or an insertion leads.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
#: Least cost from each state behind the last row to the end, and the insertions that it takes.
END, END_CODES = (0, 4, 2, 0), ("", "ua", "a", "")
#: Edits tell the role they make: u, a inserted; U, A reroled.
AUDIT = str.maketrans("uaUA", "IIRR")
LEAF, FAN = 8, 8
WHOLE = 16
PART_BYTES = 16 << 20
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}

Matrix = tuple[tuple[float, ...], ...]
INF = float("inf")


def auction(arcs: list[list[tuple]], price: list[float], origin: int, sink: int, most: float = INF) -> float:
    """Price of the origin when the path from it reaches the sink, whose price is 0: the least cost; infinite if that
    passes ``most``. arcs: (code, cost, target) of every node. Prices stay feasible for every origin."""
    path = [origin]
    while path[-1] != sink:
        node = path[-1]
        best, target = INF, -1
        for _, cost, to in arcs[node]:
            if cost + price[to] < best:
                best, target = cost + price[to], to
        if price[node] < best:
            price[node] = best
            if node != origin:
                path.pop()
            elif best > most:
                return INF
        else:
            path.append(target)
    return price[origin]


def traced(arcs: list[list[tuple]], price: list[float], origin: int, sink: int) -> tuple[str, int]:
    """Codes along the tight arcs to the sink, least in the order of the arcs, and the last node before the sink."""
    path, codes, turns, dead = [origin], [], [iter(arcs[origin])], set()
    while path[-1] != sink:
        node = path[-1]
        for code, cost, to in turns[-1]:
            if price[node] == cost + price[to] and to not in dead:
                path.append(to)
                codes.append(code)
                turns.append(iter(arcs[to]))
                break
        else:
            dead.add(path.pop())
            turns.pop()
            codes.pop()
    return "".join(codes), path[-2]


def lattice(kinds: str, exits: tuple[float, ...]) -> list[list[tuple]]:
    """Arcs of the rows, in audit order. kinds: a character a row, x for rows to be deleted, else the initial (o for others), upper case where
    truncated. exits: cost from each state behind the last row to the sink, which is the last node."""
    sink = 4 * (len(kinds) + 1)
    arcs: list[list[tuple]] = []
    for i, kind in enumerate(kinds):
        stay = int(kind.isupper())
        for state in STATES:
            here, code = 4 * i, "a" if NEXT[state] == ASSISTANT else "u"
            own = [("D", 3, here + 4 + state), (code, 2, here + NEXT[state])]
            if kind != "x":
                if (to := KEPT[state].get(kind.lower())) is not None:
                    own.append(("K", stay, here + 4 + to))
                own.append((code.upper(), 2 + stay, here + 4 + NEXT[state]))
            arcs.append(own)
    arcs += [[("", exits[state], sink)] if exits[state] < INF else [] for state in STATES]
    return [*arcs, []]


def _towards(state: int) -> tuple[float, ...]:
    return tuple(0 if s == state else INF for s in STATES)


@functools.lru_cache(maxsize=1 << 15)
def leaf_matrix(kinds: str) -> Matrix:
    """Least cost between each state before and each state behind a few rows."""
    columns = []
    for state in STATES:
        arcs = lattice(kinds, _towards(state))
        price = [0.0] * len(arcs)
        columns.append([auction(arcs, price, origin, len(arcs) - 1, 4 * len(kinds) + 8) for origin in STATES])
    return tuple(zip(*columns))


def _layers(matrices: list[Matrix], exits: tuple[float, ...]) -> list[list[tuple]]:
    """Arcs over blocks; each layer's costs are lowered by its least, so that prices stay small."""
    sink, arcs = 4 * (len(matrices) + 1), []
    for i, m in enumerate(matrices):
        least = min(map(min, m))
        arcs += [[("", m[s][t] - least, 4 * i + 4 + t) for t in STATES if m[s][t] < INF] for s in STATES]
    arcs += [[("", exits[state], sink)] if exits[state] < INF else [] for state in STATES]
    return [*arcs, []]


@functools.lru_cache(maxsize=1 << 12)
def composed(matrices: tuple[Matrix, ...]) -> Matrix:
    """The matrix of blocks in a row."""
    low = sum(min(map(min, m)) for m in matrices)
    columns = []
    for state in STATES:
        arcs = _layers(list(matrices), _towards(state))
        price = [0.0] * len(arcs)
        columns.append([auction(arcs, price, origin, len(arcs) - 1, 1e300) + low for origin in STATES])
    return tuple(zip(*columns))


def tails(matrices: list[Matrix], exits: tuple[float, ...]) -> list[tuple[float, ...]]:
    """Least cost to the end from each state before each block and behind the last, less the least of the four."""

    def level(found) -> tuple[float, ...]:
        least = min(found)
        return tuple(v - least for v in found)

    if len(matrices) > FAN:
        size = FAN
        while size * FAN < len(matrices):
            size *= FAN
        groups = [matrices[k : k + size] for k in range(0, len(matrices), size)]
        outer, out = tails([joined(g) for g in groups], exits), []
        for group, end in zip(groups, outer[1:]):
            out += tails(group, end)[:-1]
        return [*out, outer[-1]]
    arcs = _layers(matrices, exits)
    price = [0.0] * len(arcs)
    for origin in range(len(arcs) - 1):
        auction(arcs, price, origin, len(arcs) - 1, 1e300)
    return [level(price[4 * i : 4 * i + 4]) for i in range(len(matrices) + 1)]


def joined(matrices: list[Matrix]) -> Matrix:
    while len(matrices) > 1:
        matrices = [composed(tuple(matrices[k : k + FAN])) for k in range(0, len(matrices), FAN)]
    return matrices[0]


def _pieces(kinds: str) -> list[str]:
    size = LEAF
    while size * FAN < len(kinds):
        size *= FAN
    return [kinds[k : k + size] for k in range(0, len(kinds), size)]


def matrix(kinds: str) -> Matrix:
    """Least cost between each state before and each state behind any number of rows."""
    return leaf_matrix(kinds) if len(kinds) <= LEAF else joined([matrix(p) for p in _pieces(kinds)])


@functools.lru_cache(maxsize=1 << 15)
def _short(kinds: str, entry: int, exits: tuple[float, ...]) -> tuple[str, int]:
    arcs = lattice(kinds, exits)
    price = [0.0] * len(arcs)
    auction(arcs, price, entry, len(arcs) - 1)
    codes, last = traced(arcs, price, entry, len(arcs) - 1)
    return codes, last - 4 * len(kinds)


def edits(kinds: str, entry: int, exits: tuple[float, ...]) -> tuple[str, int]:
    """Cheapest edit codes of the rows from the entry state, least in ASCII among the cheapest, and the state behind."""
    if len(kinds) <= WHOLE:
        return _short(kinds, entry, exits)
    pieces, codes, state = _pieces(kinds), [], entry
    for piece, end in zip(pieces, tails([matrix(p) for p in pieces], exits)[1:]):
        own, state = edits(piece, state, end)
        codes.append(own)
    return "".join(codes), state


def cost(kinds: str, codes: str) -> int:
    """Cost of the edits; insertions belong to no row."""
    total, rows = 0, iter(kinds)
    for code in codes:
        if code in "ua":
            total += 2
        else:
            stays = next(rows).isupper()
            total += 3 if code == "D" else 2 * (code in "UA") + stays
    return total


def turns_of(codes: str, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Repaired (role, text) of edit codes and the rows they edit."""
    own = iter(rows)
    for code in codes:
        if code in "ua":
            yield ROLES[code], ""
            continue
        role, text = next(own)
        if code != "D":
            yield (role if code == "K" else ROLES[code.lower()]), text


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in pairwise(initials))


def _digest(turns) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


def _string(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, turn, role, text) after the damage that the checksum of id and turn chooses."""
    conv, turn = F.col(id_col), F.col(turn_col)
    rows = turns.select(
        _key(conv).alias("key"), turn.cast("long").alias("turn"), _string(F.col(role_col)).alias("role"), _string(F.col(text_col)).alias("text"),
        (F.crc32(F.concat(_string(conv), F.lit(":"), _string(turn)).cast("binary")) % 20).alias("damage"), F.monotonically_increasing_id().alias("tie"),
    ).where("damage <> 0")
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "turn", role.alias("role"), text.alias("text"), "tie", F.explode(copies).alias("copy"))


def _key(conv: Column) -> Column:
    """A string for every id, null's unlike all others."""
    return F.when(conv.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def _with_kinds(rows: DataFrame) -> DataFrame:
    """kind: x for blank rows, else s, u, a or o by the role's initial, upper case where truncated."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return rows.withColumn("initial", known).withColumn("kind", F.when(blank, "x").when(ended, F.col("initial")).otherwise(F.upper("initial")))


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
WALKED = f"key string, part int, pos long, turn long, role string, text string, initial string, kind string, {COUNTS}"
NAMES = [x.split()[0] for x in WALKED.split(", ")]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition: repaired conversations that lie inside it, rows of the first and the last."""
    out: list[tuple] = []
    rows: list[tuple] = []
    part, first, at = 0, True, 0

    def opened(ended: list[tuple]) -> None:
        nonlocal at
        for key, _, turn, role, text, initial, kind in ended:
            out.append((key, part, at, turn, role, text, initial, kind, *[None] * 8))
            at += 1

    def repaired(ended: list[tuple]) -> None:
        seen: set[tuple[str, str]] = set()
        kinds, counts = [], {"b": 0, "d": 0, "t": 0}
        for _, _, _, role, text, _, kind in ended:
            again = (role, text) in seen
            seen.add((role, text))
            fault = "b" if kind == "x" else "d" if again else "t" if kind.isupper() else ""
            if fault:
                counts[fault] += 1
            kinds.append("x" if again else kind)
        turns = {r[2] for r in ended if r[2] is not None}
        marks = "".join(kinds)
        codes, state = edits(marks, START, END)
        codes += END_CODES[state]
        out.append((
            ended[0][0], part, None, None, None, None, None, None, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["b"], counts["d"], counts["t"],
            _illegal([r[5] for r in ended]), cost(marks, codes), codes.translate(AUDIT), _digest(turns_of(codes, [(r[3], r[4]) for r in ended])),
        ))

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(NAMES)
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 4, *[pa.int64()] * 6, pa.string(), pa.string()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], NAMES)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][0] != row[0]:
                (opened if first else repaired)(rows)
                rows, first = [], False
            part = row[1]
            rows.append(row)
        if first:  # may be of any length: nothing of it is held
            opened(rows[:-1])
            rows = rows[-1:]
        yield flushed()
    at = 0 if not first else at
    opened(rows)
    yield flushed()


SEGMENT = "key string, part int, kinds string, costs array<double>"


def _solved(segments: DataFrame) -> DataFrame:
    """Costs between all states at the ends of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [[v for row in matrix(k) for v in row] for k in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(costs, pa.list_(pa.float64()))], ["key", "part", "kinds", "costs"])

    return segments.select("key", "part", "kinds").mapInArrow(run, SEGMENT)


def _ended(solved: DataFrame) -> DataFrame:
    """(key, part, exits): costs from the states behind each segment to the conversation's end. A group has one row of 16
    numbers for each partition that the conversation spans."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        matrices = [tuple(tuple(c[4 * s : 4 * s + 4]) for s in STATES) for c in table.column("costs").to_pylist()]
        found = [list(v) for v in tails(matrices, END)[1:]]
        return pa.table({"key": table.column("key"), "part": table.column("part"), "exits": pa.array(found, pa.list_(pa.float64()))})

    return solved.select("key", "part", "costs").groupBy("key").applyInArrow(run, "key string, part int, exits array<double>")


def _traced(solved: DataFrame, ended: DataFrame) -> DataFrame:
    """(key, part, codes, costs, states): for each state before the segment, its edits, their cost and the state behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[edits(kinds, s, tuple(exits)) for s in STATES] for kinds, exits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            costs = [[cost(kinds, codes) for codes, _ in own] for kinds, own in zip(batch.column(2).to_pylist(), found)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([[c for c, _ in own] for own in found], pa.list_(pa.string())), pa.array(costs, pa.list_(pa.int64())),
                 pa.array([[s for _, s in own] for own in found], pa.list_(pa.int32()))],
                ["key", "part", "codes", "costs", "states"],
            )

    return solved.join(ended, ["key", "part"]).select("key", "part", "kinds", "exits").mapInArrow(
        run, "key string, part int, codes array<string>, costs array<long>, states array<int>"
    )


def _entered(traced_rows: DataFrame) -> DataFrame:
    """(key, part, entry, tail): the state before each segment, and what is inserted behind the last."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        state, entries = START, []
        for states in table.column("states").to_pylist():
            entries.append(state)
            state = states[state]
        tail = [""] * (len(entries) - 1) + [END_CODES[state]]
        return pa.table({"key": table.column("key"), "part": table.column("part"), "entry": pa.array(entries, pa.int32()), "tail": pa.array(tail)})

    return traced_rows.select("key", "part", "states").groupBy("key").applyInArrow(run, "key string, part int, entry int, tail string")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation from its sorted rows (key, codes, role, text); rows stream through."""
    own, running, empty = None, hashlib.sha256(), True
    for batch in batches:
        keys, digests = [], []
        for key, codes, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != own:
                if own is not None:
                    keys.append(own)
                    digests.append(running.hexdigest())
                own, running, empty = key, hashlib.sha256(), True
            for r, t in turns_of(codes, [(role, text)]):
                running.update(f"{'' if empty else chr(10)}{r}:{t}".encode())
                empty = False
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["key", "repaired_sha256"])
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([running.hexdigest()])], ["key", "repaired_sha256"])


def _edited(walked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of the conversations at partition ends: their rows with faults, their segments, the edits of each segment, and (key,
    part, pos, codes, role, text) in order, where codes edit the row."""
    rows = walked.where("kind is not null").select("key", "part", "pos", "turn", "role", "text", "initial", "kind")
    digest = F.sha2("text", 256).alias("digest")
    repeated = rows.groupBy("key", "role", digest).agg(F.min(F.struct("part", "pos")).alias("held"), F.count("*").alias("n")).where("n > 1")
    marked = stored(
        rows.select("key", "part", "pos", "turn", "role", digest, "initial", "kind").join(repeated, ["key", "role", "digest"], "left").select(
            "key", "part", "pos", "turn", "initial", F.coalesce(F.struct("part", "pos") > F.col("held"), F.lit(False)).alias("again"), F.col("kind").alias("own")
        ).withColumn("kind", F.when(F.col("again"), "x").otherwise(F.col("own"))),
        "repair-marked",
    )

    def in_order(c: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "")

    segments = stored(marked.groupBy("key", "part").agg(in_order("kind").alias("kinds"), in_order("initial").alias("initials")), "repair-segments")
    solved = stored(_solved(segments), "repair-solved")
    found = stored(_traced(solved, _ended(solved)), "repair-traced")
    chosen = found.join(_entered(found), ["key", "part"]).select(
        "key", "part", F.col("codes")[F.col("entry")].alias("codes"), "tail", (F.col("costs")[F.col("entry")] + 2 * F.length("tail")).alias("cost")
    )
    chosen = stored(chosen, "repair-chosen")
    steps = chosen.select("key", "part", F.posexplode(F.regexp_extract_all("codes", F.lit("[ua]*[DKUA]"), F.lit(0))).alias("pos", "codes")).withColumn("pos", F.col("pos").cast("long"))
    ends = chosen.where("tail <> ''").select("key", "part", F.lit((1 << 62)).alias("pos"), F.col("tail").alias("codes"), F.lit("").alias("role"), F.lit("").alias("text"))
    edited = rows.select("key", "part", "pos", "role", "text").join(steps, ["key", "part", "pos"]).select("key", "part", "pos", "codes", "role", "text").union(ends)
    return marked, segments, chosen, edited


def _joined(walked: DataFrame) -> DataFrame:
    """Results of the conversations at partition ends."""
    marked, segments, chosen, edited = _edited(walked)
    by_turn = marked.groupBy("key", "turn").agg(
        F.count_if(F.col("own") == "x").alias("blank"), F.count_if((F.col("own") != "x") & F.col("again")).alias("duplicate"),
        F.count_if((F.col("own") != "x") & ~F.col("again") & (F.col("own") == F.upper("own"))).alias("truncated"),
    )
    counts = by_turn.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )

    def pairs(table: pa.Table) -> pa.Table:
        own = table.sort_by("part").column("initials").to_pylist()
        found = sum(_illegal([a[-1], b[0]]) for a, b in pairwise(own))
        return pa.table({"key": table.column("key")[:1], "illegal": pa.array([found], pa.int64())})

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_illegal(list(own)) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["key", "inside"])

    ends = F.concat(F.substring("initials", 1, 1), F.substring("initials", -1, 1)).alias("initials")
    between = segments.select("key", "part", ends).groupBy("key").applyInArrow(pairs, "key string, illegal long")
    within = segments.select("key", "initials").mapInArrow(inside, "key string, inside long").groupBy("key").agg(F.sum("inside").alias("inside"))
    illegal = between.join(within, "key").select("key", (F.col("illegal") + F.col("inside")).alias("illegal"))
    audits = chosen.groupBy("key").agg(
        F.sum("cost").alias("cost"),
        F.translate(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.concat("codes", "tail").alias("codes")))), lambda x: x["codes"]), ""), "uaUA", "IIRR").alias("audit"),
    )
    parts = edited.select("key", "part", "pos", "codes", "role", "text").repartition("key").sortWithinPartitions("key", "part", "pos")
    digests = parts.select("key", "codes", "role", "text").mapInArrow(_streamed, "key string, repaired_sha256 string")
    return counts.join(illegal, "key").join(audits, "key").join(digests, "key")


def _walked(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows after damage, sorted by range and walked through; written to the shared folder."""
    size = turns.agg(F.sum(F.octet_length(text_col) + 64)).first()[0] or 0
    parts = parts_for(size, PART_BYTES, 8)
    rows = _with_kinds(damaged(turns, id_col, turn_col, role_col, text_col))
    order = ["key", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"), "tie", "copy"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(dealt.select("key", F.spark_partition_id().alias("part"), "turn", "role", "text", "initial", "kind").mapInArrow(_walk, WALKED), "repair-walked")


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation id: counts of faults, least cost, audit string and digest of the repaired turns."""
    walked = _walked(turns, id_col, turn_col, role_col, text_col)
    names = NAMES[8:]
    results = walked.where("kind is null").select("key", *names).unionByName(_joined(walked).select("key", *names))
    ids = turns.select(id_col).distinct().withColumn("_key", _key(F.col(id_col)))
    empty = {n: F.lit(0).cast("long") for n in names[:-2]} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return ids.join(results.withColumnRenamed("key", "_key"), "_key", "left").select(id_col, *[F.coalesce(n, empty[n]).alias(n) for n in names])
