"""N-gram Jaccard join: size-banded tiles, hashed bitmaps as an upper bound, exact intersection of sorted arrays.

Bands. Set sizes fall into bands such that linked sets lie in one band or in neighbours. For the pairs whose smaller
set lies in band s, the sets differ in at most k(s) shingles. The hash space is cut into more than k(s) slices, so the
two sets agree on at least one slice entirely. The digest of a slice is a tile key; only sets of one tile are compared.
Slices that are empty agree without saying anything: there are as many spare slices as a set may have empty ones.
Two sets that agree on empty slices only have both more empty ones than that. Such sets are sliced again by another
hash, where the same holds, and only after ``LEVELS`` hashes give keys for their empty slices. A key of an empty slice would put all
such sets of a band in one tile. No key is dropped, so no link is lost.

Tiles. Every set of a tile is first tested against one other (the smallest id it shares most tiles with). After
these links are merged, only tiles with sets of different components remain; they are cut into blocks of bounded size, and within a block sorted by set size the bitmaps are compared: a bit
of one that the other lacks is a shingle the other lacks, so the overlap is at most the size less those bits. Near copies share
many tiles, so what passes is gathered as one row for each set and task, and again by set, before it is intersected exactly.

Equal sets are one node to each task. Null, blank and empty texts have an empty set and no links; texts with fewer
words than the shingle have one shingle; rows that repeat an id are one node with the links of all of them; rows without
an id keep their count and get no component. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.llm.common import bounded_batches, buckets_of, dropped, mix, parts_for, slices, stored, trimmed
from faultlines.llm.components import components
from faultlines.llm.shingles import sets

KEY_BYTES = 12
PART_BYTES = 6 << 20
BLOCK = 2048
HELD_KEYS = 600_000
LEVELS = 12
HELD_PAIRS = 500_000


def bands(largest: int, num: int, den: int) -> np.ndarray:
    """Lower bounds of the bands up to one beyond the largest size."""
    out = [1, 2]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, (out[-1] - 1) * den // num + 1))
    return np.array([*out, max(out[-1] + 1, (out[-1] - 1) * den // num + 1)], np.int64)


def _slices(low: np.ndarray, s: int, num: int, den: int) -> tuple[int, int]:
    """Number of slices of scheme s and how many of them may be empty; 0 where only equal sets link. The smallest set of
    a band has most empty slices: a little more than it has on average."""
    k = (den - num) * (int(low[s + 1]) - 1) // num
    spare = 0 if k < 4 else 1 + int(1.25 * k * math.exp(-int(low[s]) / (k + 1)))
    return (k + 1 + spare, spare) if k else (0, 0)


def tile_keys(h: np.ndarray, low: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of one sorted set; the last bit tells whether the set lies in the lower band of the key's scheme."""
    own = int(np.searchsorted(low, len(h), side="right")) - 1
    found = []
    for s in (own, own - 1):
        n, spare = _slices(low, s, num, den) if s >= 0 else (0, 0)
        for level in range(LEVELS if n else 0):
            dealt = np.sort(mix(h, 100 + level)) if level else h
            at = buckets_of(dealt, n)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            digest = np.add.reduceat(mix(dealt, 7), first)
            index = at[first].astype(np.uint64)
            more = n - len(first) > spare
            if more and level == LEVELS - 1:
                empty = np.setdiff1d(np.arange(n, dtype=np.uint64), index)
                index, digest = np.concatenate([index, empty]), np.concatenate([digest, np.zeros(len(empty), np.uint64)])
            key = mix(digest ^ mix((index << np.uint64(20)) + np.uint64(level << 56 | s), 11))
            found.append((key & ~np.uint64(1)) | np.uint64(s == own))
            if not more:
                break
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _set_ids(cuts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    out = []
    for salt in (21, 22):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, salt), dtype=np.uint64)])
        out.append((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64))
    return out[0], out[1]


def _sizes(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, s1, s2) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                cuts, h = sets(piece.column(1), size)
                s1, s2 = _set_ids(cuts, h)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(cuts)), pa.array(s1), pa.array(s2)], ["id", "n", "s1", "s2"])

    return docs.mapInArrow(trimmed(run), "id bigint, n bigint, s1 bigint, s2 bigint")


def _dealt_keys(docs: DataFrame, size: int, low: np.ndarray, num: int, den: int, parts: int) -> DataFrame:
    """(bucket, base, blob): tile keys and ids of all sets, packed by bucket; equal sets of a task count once."""

    def packed(keys: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if keys:
            key, id_ = np.concatenate(keys), np.concatenate(ids)
            order = np.argsort(key)
            key, id_ = key[order], id_[order]
            base = int(id_.min())
            wide = int(id_.max()) - base >= 1 << 32
            cuts = np.searchsorted(buckets_of(key, parts), np.arange(parts + 1))
            rows = [(b, key[x:y].tobytes() + (id_[x:y] - base).astype(np.int64 if wide else np.uint32).tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int32()), pa.array([base] * len(rows), pa.int64()), pa.array([wide] * len(rows), pa.bool_()), pa.array([v for _, v in rows], pa.binary())],
                ["bucket", "base", "wide", "blob"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        keys, ids, held = [], [], 0
        for batch in batches:
            for piece in slices(batch, 1):
                cuts, h = sets(piece.column(1), size)
                s1, s2 = _set_ids(cuts, h)
                for id_, a, b, x, y in zip(piece.column(0).to_pylist(), cuts.tolist(), cuts[1:].tolist(), s1.tolist(), s2.tolist()):
                    if id_ is None or a == b or (x, y) in seen:
                        continue
                    seen.add((x, y))
                    key = tile_keys(h[a:b], low, num, den)
                    keys.append(key)
                    ids.append(np.full(len(key), id_, np.int64))
                    held += len(key)
                if held > HELD_KEYS:
                    yield from packed(keys, ids)
                    keys, ids, held = [], [], 0
        if held:
            yield from packed(keys, ids)

    return docs.mapInArrow(trimmed(run), "bucket int, base bigint, wide boolean, blob binary")


def _shared_tiles(dealt: DataFrame, parts: int) -> DataFrame:
    """(tile, id, first) of the tiles with two sets or more, one of them in the lower band. A tile is named by its
    members, so tiles with the same members are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for batch in batches:
            for base, wide, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                raw = blob.as_buffer()
                n = len(raw) // (16 if wide else 12)
                keys.append(np.frombuffer(raw, np.uint64, n))
                ids.append(np.frombuffer(raw, np.int64 if wide else np.uint32, n, 8 * n).astype(np.int64) + base)
        if not keys:
            return
        key, id_ = np.concatenate(keys), np.concatenate(ids)
        keys.clear()
        ids.clear()
        order = np.lexsort((id_, key >> np.uint64(1)))
        key, id_ = key[order], id_[order]
        tile = key >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        count = np.diff(np.append(first, len(tile)))
        good = (count > 1) & (np.maximum.reduceat(key & np.uint64(1), first) > 0)
        name = np.add.reduceat(mix(id_.view(np.uint64), 31), first)
        name, at = np.unique(np.where(good, name, 0), return_index=True)
        at = at[good[at]]
        name = np.add.reduceat(mix(id_.view(np.uint64), 31), first)[at].view(np.int64)
        lengths = count[at]
        rows = np.repeat(first[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(at) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(name, lengths)), pa.array(id_[rows]), pa.array(np.repeat(id_[first[at]], lengths))], ["tile", "id", "first"]
        )

    return dealt.repartition(parts, "bucket").mapInArrow(trimmed(run), "tile bigint, id bigint, first bigint").distinct()


def bitmap(h: np.ndarray) -> bytes:
    """One bit for each hash, in a width of at least twice the set's size (a power of two from 256 to 65,536)."""
    width = 1 << min(16, max(8, (2 * len(h) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps at the width of the narrowest, as rows of 64-bit words."""
    width = min(map(len, bitmaps))
    rows = np.empty((len(bitmaps), width // 8), np.uint64)
    for i, b in enumerate(bitmaps):
        words = np.frombuffer(b, np.uint64)
        while len(words) > width // 8:
            words = words[: len(words) // 2] | words[len(words) // 2 :]
        rows[i] = words
    return rows


def _bitmaps(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                cuts, h = sets(piece.column(1), size)
                bits = [bitmap(h[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(cuts)), pa.array(bits, pa.binary())], ["id", "n", "bits"])

    return docs.mapInArrow(trimmed(run), "id bigint, n bigint, bits binary")


def _arrays(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                cuts, h = sets(piece.column(1), size)
                own = [h[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(own, pa.binary())], ["id", "hashes"])

    return docs.mapInArrow(trimmed(run), "id bigint, hashes binary")


def _paired(pairs: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    """The pairs (a, b) with columns of both sides."""
    left = table.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in names])
    right = table.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in names])
    return pairs.join(left, "a").join(right, "b").select("a", "b", *[f"{c}_{side}" for c in names for side in "ab"])


def _bounded(pairs: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, xa, xb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                need = -(-num * (x + y) // (num + den))
                bits = folded([xa.as_py(), xb.as_py()])
                keep.append(min(x - int(np.bitwise_count(bits[0] & ~bits[1]).sum()), y - int(np.bitwise_count(bits[1] & ~bits[0]).sum())) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _paired(pairs, bitmaps, "n", "bits").mapInArrow(trimmed(run), "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link. Sets are made for the documents of these pairs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ha, hb in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(ha.as_buffer(), np.uint64), np.frombuffer(hb.as_buffer(), np.uint64)
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= -(-num * (len(x) + len(y)) // (num + den)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    arrays = stored(_arrays(docs.join(wanted, "id", "left_semi"), size), "jaccard-sets")
    links = stored(_paired(pairs, arrays, "hashes").mapInArrow(trimmed(run), "a bigint, b bigint"), "jaccard-links")
    dropped(arrays)
    return links


def _tile_pairs(members: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components in one tile whose bitmaps allow a link, each once. members: tile, id, comp, rows of
    the tile."""
    blocks = F.expr(f"cast(ceil(rows / {BLOCK}) as int)")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = (
        members.join(bitmaps, "id").withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tile", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("left"), "n", "id", "comp", "bits")
    )

    def block(rows: list[tuple], near: dict[int, set[int]]) -> int:
        split = rows[0][1] != rows[0][2]
        n = np.array([r[4] for r in rows])
        left, ids, comp = np.array([r[3] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        bits = folded([r[7] for r in rows])
        ends = np.searchsorted(n, n * den // num, side="right")
        met = 0
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, ends[i])
            j = j[(comp[j] != comp[i]) & ((left[j] != left[i]) | (not split))]
            if len(j):
                need = -(-num * (n[i] + n[j]) // (num + den))
                ok = n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64) >= need
                j, need = j[ok], need[ok]
                j = j[n[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1, dtype=np.int64) >= need]
                own = int(ids[i])
                for other in ids[j].tolist():
                    near.setdefault(min(own, other), set()).add(max(own, other))
                met += len(j)
        return met

    def listed(near: dict[int, set[int]]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(near), pa.int64()), pa.array([sorted(v) for v in near.values()], pa.list_(pa.int64()))], ["a", "near"]
        )
        near.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        near: dict[int, set[int]] = {}
        met = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    met += block(held, near)
                    held = []
                    if met > HELD_PAIRS:
                        yield listed(near)
                        met = 0
                held.append(row)
        if held:
            block(held, near)
        yield listed(near)

    dealt = spread.repartition("tile", "x", "y").sortWithinPartitions("tile", "x", "y", "n", "id")
    found = dealt.mapInArrow(trimmed(run), "a bigint, near array<bigint>").groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return found.select("a", F.explode("near").alias("b"))


def join(docs: DataFrame, size: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id). Two rows link when den * intersection >= num * union."""
    docs = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sizes = stored(_sizes(docs, size), "jaccard-sizes")
    total = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("largest")).first()
    low = bands(total.largest or 1, num, den)
    share = 2 * (den - num) / num
    parts = parts_for(int((total.n or 0) * share) * KEY_BYTES, PART_BYTES)
    tiles = stored(_shared_tiles(_dealt_keys(docs, size, low, num, den, parts), parts), "jaccard-tiles")

    wanted = tiles.select("id").distinct()
    bitmaps = stored(_bitmaps(docs.join(wanted, "id", "left_semi"), size), "jaccard-bitmaps")
    tried = (
        tiles.where("id <> first").groupBy("id", "first").agg(F.count("*").alias("n"))
        .groupBy("id").agg(F.max_by("first", F.struct("n", "first")).alias("first"))
        .select(F.col("first").alias("a"), F.col("id").alias("b"))
    )
    links = _verified(stored(_bounded(tried, bitmaps, num, den), "jaccard-tried"), docs, size, num, den)
    known = components(links)
    placed = stored(
        tiles.join(known.withColumnRenamed("node", "id"), "id", "left").select("tile", "id", F.coalesce("component", "id").alias("comp")), "jaccard-placed"
    )
    dropped(tiles)
    open_tiles = placed.groupBy("tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows")).where("x <> y").select("tile", "rows")
    members = stored(placed.join(open_tiles, "tile"), "jaccard-open")
    dropped(placed)
    more = _verified(stored(_tile_pairs(members, bitmaps, num, den), "jaccard-pairs"), docs, size, num, den)
    dropped(members, bitmaps)

    # equal sets are contracted to their smallest id before the components of all links
    classes = sizes.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("least"))
    held = stored(sizes.where("n > 0 and id is not null").join(classes, ["s1", "s2"]).select("id", "least").distinct(), "jaccard-held")
    by_id = stored(held.groupBy("id").agg(F.min("least").alias("least"), F.max("least").alias("most")), "jaccard-classes")
    rep = by_id.select("id", "least")
    # an id with several sets links the classes of all of them
    several = by_id.where("least <> most").select("id", F.col("least").alias("a")).join(held, "id")
    edges = (
        links.union(more).join(rep.toDF("a", "ra"), "a").join(rep.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        .union(several.select("a", F.col("least").alias("b")))
    )
    merged = components(edges)
    named = rep.join(merged.toDF("least", "component"), "least", "left").select("id", F.coalesce("component", "least").alias("component"))
    return sizes.join(named, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
