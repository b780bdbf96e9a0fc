"""Packing by non-negative least squares.

1. Every text is encoded once. A document of T tokens fills T // window sequences alone; its remainder is a piece of
   r < window tokens. Ids, remainders and the rank of each piece in its length bin are written to the shared folder.
2. The histogram over length bins (a fixed number of rows) goes to the driver. All multisets of at most ``depth`` bins
   that fill a window are enumerated, non-negative least squares finds how often each is to be used, and the counts are
   rounded. They are trimmed so that planned sequences never need more tokens than the pieces have.
3. A piece takes the slot of its bin given by its global rank (sums by task, no sort of the corpus). Pieces beyond
   the planned slots are residual: they are cut greedily along the free space of all sequences in order, and beyond
   the planned ones into full windows. Only the last sequence can have padding.

Free space and residual tokens are two lines of equal scale; they meet in an equi-join on line blocks, so that no task
sees more than a block. Null and empty texts are documents of the end id alone; repeated rows are packed each on
its own; an empty table gives no rows; documents of any length are packed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.llm import bpe
from faultlines.llm.common import bounded_batches, stored, trimmed

BIN = 64
DEPTH = 3
LINE_BLOCK = 1 << 18


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative x of least |a x - b| by coordinate descent."""
    gram, target = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    slope = -target.copy()
    for _ in range(rounds):
        largest = 0.0
        for j in range(len(x)):
            new = max(0.0, x[j] - slope[j] / gram[j, j])
            if new != x[j]:
                slope += gram[:, j] * (new - x[j])
                largest = max(largest, abs(new - x[j]))
                x[j] = new
        if largest <= 1e-6 * max(1.0, float(b.max(initial=0.0))):
            break
    return x


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most depth bins (1..bins) that sum to bins."""
    return [c for d in range(1, depth + 1) for c in combinations_with_replacement(range(1, bins + 1), d) if sum(c) == bins]


def plan(histogram: dict[int, int], tokens: int, window: int, width: int = BIN, depth: int = DEPTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots as (bin, first rank, end rank, first sequence, position), and the number of planned sequences.

    tokens: of all pieces; the planned sequences hold no more than that.
    """
    bins = -(-window // width)
    ways = combinations(bins, depth)
    have = np.array([histogram.get(b, 0) for b in range(1, bins + 1)], float)
    use = np.zeros((bins, len(ways)))
    for j, way in enumerate(ways):
        for b in way:
            use[b - 1, j] += 1
    repeat = np.rint(nnls(use, have)).astype(np.int64)
    room = tokens // window
    for j in np.argsort(-use.sum(axis=0), kind="stable"):  # the deepest combinations lose most to rounding up
        over = int(repeat.sum()) - room
        if over <= 0:
            break
        repeat[j] -= min(over, int(repeat[j]))
    slots, taken, sequence = [], dict.fromkeys(range(1, bins + 1), 0), 0
    for way, n in zip(ways, repeat.tolist()):
        if n:
            for position, b in enumerate(way):
                slots.append((b, taken[b], taken[b] + n, sequence, position))
                taken[b] += n
            sequence += n
    return slots, sequence


def _encoded(docs: DataFrame, path: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (uid part, id, ids as packed integers, tokens, remainder, bin, rank of the piece in its bin and task)."""
    schema = f"part int, seat bigint, {id_col} {docs.schema[id_col].dataType.simpleString()}, ids binary, tokens bigint, rest int, bin int, rank bigint"
    bins = -(-window // BIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, seat = bpe.loaded(path), np.zeros(bins + 1, np.int64), 0
        small = max(encoder.tokens) < 65536 and end_id < 65536
        for batch in batches:
            for at in range(0, batch.num_rows, bpe.BLOCK):
                piece = batch.slice(at, bpe.BLOCK)
                ids, cuts = encoder.encode_flat(piece.column(1))
                ids = np.insert(ids, cuts[1:], end_id).astype("<u2" if small else "<u4")
                cuts += np.arange(len(cuts))
                tokens = np.diff(cuts)
                rest = tokens % window
                bin_ = -(-rest // BIN)
                rank = np.empty(len(tokens), np.int64)
                for b in np.unique(bin_):
                    own = np.flatnonzero(bin_ == b)
                    rank[own] = seen[b] + np.arange(len(own))
                    seen[b] += len(own)
                offsets = pa.py_buffer((cuts * ids.itemsize).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(tokens), [None, offsets, pa.py_buffer(ids)])
                part = piece.column(2)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(seat + np.arange(len(tokens))), piece.column(0), packed, pa.array(tokens),
                     pa.array(rest.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(rank)],
                    ["part", "seat", id_col, "ids", "tokens", "rest", "bin", "rank"],
                )
                seat += len(tokens)

    return docs.select(id_col, text_col, F.spark_partition_id().alias("part")).mapInArrow(trimmed(run, keep=bpe.HELD), schema)


def _before(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of value over all smaller keys, for one row per key; df has one row per (key, value) and few keys."""
    from pyspark.sql import Window

    return df.select(key, (F.sum(value).over(Window.orderBy(key)) - F.col(value)).alias("before"))


def _pieces(held: DataFrame, slots: list[tuple], planned: int, full: int, window: int) -> DataFrame:
    """Rows (part, seat, start, length, sequence, offset) of every piece."""
    from pyspark.sql import Window

    spark = held.sparkSession
    ends = held.select("part", "seat", "tokens", "rest", "bin", "rank")
    by_bin = ends.groupBy("bin", "part").agg(F.count("*").alias("n"))
    first = by_bin.select("bin", "part", (F.sum("n").over(Window.partitionBy("bin").orderBy("part")) - F.col("n")).alias("first"))
    table = {b: np.array([s[1:] for s in slots if s[0] == b]) for b in {s[0] for s in slots}}

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = batch.column("bin").to_numpy(), batch.column("at").to_numpy()
            sequence, position = np.full(len(bins), -1, np.int64), np.zeros(len(bins), np.int32)
            for b in np.unique(bins):
                if b in table:
                    own, t = np.flatnonzero(bins == b), table[b]
                    at = np.searchsorted(t[:, 0], ranks[own], side="right") - 1
                    inside = ranks[own] < t[at, 1]
                    own, at = own[inside], at[inside]
                    sequence[own] = t[at, 2] + ranks[own] - t[at, 0]
                    position[own] = t[at, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "seat", "start", "rest")), pa.array(sequence), pa.array(position)],
                ["part", "seat", "start", "rest", "sequence", "position"],
            )

    ranked = ends.where("rest > 0").join(first, ["bin", "part"]).select(
        "part", "seat", (F.col("tokens") - F.col("rest")).alias("start"), "rest", "bin", (F.col("rank") + F.col("first")).alias("at")
    )
    seats = stored(ranked.mapInArrow(seated, "part int, seat bigint, start bigint, rest int, sequence bigint, position int"), "pack-seats")

    whole = held.where(F.col("tokens") >= window).select("part", "seat", F.expr(f"cast(tokens div {window} as bigint)").alias("n"))
    wholes_by = _before(whole.groupBy("part").agg(F.sum("n").alias("n")), "part", "n")
    order = Window.partitionBy("part").orderBy("seat")
    filled = (
        whole.withColumn("own", F.sum("n").over(order) - F.col("n"))
        .join(wholes_by, "part")
        .select("part", "seat", (F.col("own") + F.col("before")).alias("sequence"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
        .select("part", "seat", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("sequence") + F.col("k")).alias("sequence"), F.lit(0).cast("long").alias("offset"))
    )

    # planned slots: at most depth rows to a sequence
    placed = seats.where("sequence >= 0")
    listed = F.array_sort(F.collect_list(F.struct("position", "part", "seat", "start", "rest")))
    sequences = stored(
        placed.groupBy("sequence").agg(listed.alias("held")).withColumn("fill", F.aggregate("held", F.lit(0), lambda a, x: a + x["rest"])), "pack-planned"
    )
    slotted = sequences.select("sequence", F.posexplode("held").alias("i", "x"), "held").select(
        "x.part", "x.seat", "x.start", F.col("x.rest").cast("long").alias("length"), (F.col("sequence") + full).alias("sequence"),
        F.aggregate(F.slice("held", 1, F.col("i")), F.lit(0), lambda a, x: a + x["rest"]).cast("long").alias("offset"),
    )

    # free space of the planned sequences as one line, in order of sequence; sequences with no piece are all free
    block = 1 << 14
    free = (
        spark.range(planned).select(F.col("id").alias("sequence")).join(sequences.select("sequence", "fill"), "sequence", "left")
        .select("sequence", F.coalesce("fill", F.lit(0)).cast("long").alias("fill"), F.expr(f"sequence div {block}").alias("block"))
        .withColumn("free", F.lit(window) - F.col("fill"))
    )
    before = _before(free.groupBy("block").agg(F.sum("free").alias("free")), "block", "free")
    gaps = (
        free.withColumn("own", F.sum("free").over(Window.partitionBy("block").orderBy("sequence")) - F.col("free"))
        .join(before, "block")
        .where("free > 0")
        .select("sequence", F.col("fill").alias("at"), (F.col("own") + F.col("before")).alias("a"), (F.col("own") + F.col("before") + F.col("free")).alias("b"))
    )
    residual = seats.where("sequence < 0").select("part", "seat", "start", F.col("rest").cast("long").alias("rest"))
    residual_by = _before(residual.groupBy("part").agg(F.sum("rest").alias("rest")), "part", "rest")
    line = (
        residual.withColumn("own", F.sum("rest").over(order) - F.col("rest"))
        .join(residual_by, "part")
        .select("part", "seat", "start", (F.col("own") + F.col("before")).alias("a"), (F.col("own") + F.col("before") + F.col("rest")).alias("b"))
    )
    line = stored(line, "pack-line")
    gaps = stored(gaps, "pack-gaps")
    room = gaps.agg(F.coalesce(F.max("b"), F.lit(0))).first()[0]

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.explode(F.sequence(F.expr(f"a div {LINE_BLOCK}"), F.expr(f"(b - 1) div {LINE_BLOCK}"))))

    g = cut(gaps).select("block", "sequence", "at", F.col("a").alias("ga"), F.col("b").alias("gb"))
    low, high = F.greatest("a", "ga", F.col("block") * LINE_BLOCK), F.least("b", "gb", (F.col("block") + 1) * LINE_BLOCK)
    filling = (
        cut(line.where(F.col("a") < room)).join(g, "block").where((F.col("a") < F.col("gb")) & (F.col("ga") < F.col("b")))
        .select("part", "seat", "start", "a", "ga", "at", "sequence", low.alias("low"), high.alias("high"))
        .where("low < high")
        .groupBy("part", "seat", "start", "a", "sequence", "at", "ga").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .select("part", "seat", (F.col("start") + F.col("low") - F.col("a")).alias("start"), (F.col("high") - F.col("low")).alias("length"),
                (F.col("sequence") + full).alias("sequence"), (F.col("at") + F.col("low") - F.col("ga")).alias("offset"))
    )
    # beyond the planned sequences every window is free
    tail = line.where(F.col("b") > room).withColumn("low", F.greatest(F.col("a"), F.lit(room)) - room).withColumn("high", F.col("b") - room)
    beyond = (
        tail.withColumn("w", F.explode(F.sequence(F.expr(f"low div {window}"), F.expr(f"(high - 1) div {window}"))))
        .withColumn("x", F.greatest(F.col("low"), F.col("w") * window)).withColumn("y", F.least(F.col("high"), (F.col("w") + 1) * window))
        .select("part", "seat", (F.col("start") + F.col("x") + room - F.col("a")).alias("start"), (F.col("y") - F.col("x")).alias("length"),
                (F.col("w") + full + planned).alias("sequence"), (F.col("x") - F.col("w") * window).alias("offset"))
    )
    return filled.unionByName(slotted).unionByName(filling).unionByName(beyond)


def pack(docs: DataFrame, path: str, end_id: int, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, checksum of its ids, tokens of its document, sequence, offset there."""
    held = stored(_encoded(bounded_batches(docs), path, end_id, window, id_col, text_col), "pack-ids")
    counts = held.groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("rest").alias("rest"), F.sum(F.expr(f"tokens div {window}")).alias("full")
    ).collect()
    histogram = {r.bin: r.n for r in counts if r.bin}
    tokens, full = sum(r.rest for r in counts), sum(r.full for r in counts)
    slots, planned = plan(histogram, tokens, window)
    pieces = _pieces(held, slots, planned, full, window)
    wanted = pieces.groupBy("part", "seat").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence", "offset"))).alias("pieces"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pieces")
            lengths = lists.value_lengths().to_numpy()
            fields = {f: lists.flatten().field(f).to_numpy() for f in ("start", "length", "sequence", "offset")}
            row = np.repeat(np.arange(len(lengths)), lengths)
            tokens = batch.column("tokens").to_numpy()
            sums, last, ids = np.empty(len(row), np.int64), -1, None
            for k, (i, a, n) in enumerate(zip(row.tolist(), fields["start"].tolist(), fields["length"].tolist())):
                if i != last:
                    raw = batch.column("ids")[i].as_buffer()
                    ids, last = np.frombuffer(raw, "<u4" if len(raw) == 4 * tokens[i] else "<u2"), i
                sums[k] = zlib.crc32(ids[a : a + n].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(row)), pa.array(fields["start"]), pa.array(fields["length"]), pa.array(sums),
                 pa.array(tokens[row]), pa.array(fields["sequence"]), pa.array(fields["offset"])],
                [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return held.select("part", "seat", id_col, "ids", "tokens").join(wanted, ["part", "seat"]).mapInArrow(trimmed(run), schema)
