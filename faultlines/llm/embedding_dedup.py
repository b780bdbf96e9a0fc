"""Embedding near-dedup by product quantisation.

Equal vectors of one label are one row with a count. Coarse centroids and residual codebooks are fitted on at most
``SAMPLE`` of these; every row is indexed: it lies in the inverted list of its nearest centroid (lists are kept apart by
label) with a code of ``SUBSPACES`` bytes for its residual, and the norm of what the code leaves out. Every row also probes
all lists whose centroid is at most ``MARGIN`` farther than its nearest. In a list, table lookups give the asymmetric
distance of each prober to each code; pairs that could lie within the threshold go to an exact cosine in double precision.

Lists and their probers are cut into blocks of bounded size, so a list with any share of all rows is many tasks. Tasks
return link counts and one edge a row, never all pairs. A pair that both sides find is counted once.

Vectors that are null, zero or hold null or non-finite components, and rows with a null label or id, link with
nothing: 0 links, own component, kept. Shorter vectors count as padded with zeros. Rows that repeat an id share their
links. Only id, embedding and label are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlines.llm.common import stored
from faultlines.llm.components import components

SAMPLE = 20_000
SUBSPACES = 16
CODES = 32
MARGIN = 0.08
SPREAD = 5.0
OWN_BLOCK = 1024
PROBE_BLOCK = 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """At most k centroids, from distinct starting rows."""
    rng = np.random.default_rng(seed)
    start = np.unique(x, axis=0)
    centers = start[rng.permutation(len(start))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((centers**2).sum(axis=1) - 2 * x @ centers.T, axis=1)
        count = np.bincount(near, minlength=len(centers))
        for d in range(x.shape[1]):
            sums = np.bincount(near, x[:, d], len(centers))
            centers[count > 0, d] = sums[count > 0] / count[count > 0]
    return centers


class Quantiser:
    """Coarse centroids and residual codebooks."""

    def __init__(self, x: np.ndarray, lists: int):
        self.dim = x.shape[1]
        self.centers = kmeans(x, lists)
        near, _ = self.nearest(x)
        rest = x - self.centers[near]
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODES, seed=a) for a, b in zip(self.cuts, self.cuts[1:])]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (self.centers**2).sum(axis=1) - 2 * x @ self.centers.T, 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = self.distances(x)
        at = far.argmin(axis=1)
        return at, far[np.arange(len(x)), at]

    def codes(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the norm of the residual's error."""
        rest = x - self.centers[at]
        code = np.empty((len(x), len(self.books)), np.uint8)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            book = self.books[m]
            code[:, m] = np.argmin((book**2).sum(axis=1) - 2 * rest[:, a:b] @ book.T, axis=1)
            rest[:, a:b] -= book[code[:, m]]
        return code, np.sqrt((rest**2).sum(axis=1))

    def asymmetric(self, probes: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Squared distances of probes to coded rows of list ``at`` by table lookup."""
        rest = probes - self.centers[at]
        out = np.zeros((len(probes), len(code)), np.float32)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            table = ((rest[:, None, a:b] - self.books[m]) ** 2).sum(axis=2).astype(np.float32)
            out += table[:, code[:, m]]
        return out


def _vectors(column) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def links(vectors: DataFrame, threshold: float, lists: int | None = None, margin: float = MARGIN, id_col: str = "vec_id",
          vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: (id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    double = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), double.alias("v"))
    finite = F.coalesce(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda v: v != 0)
    # -0.0 + 0.0 is 0.0, so equal vectors have equal bytes
    valid = rows.where(F.coalesce(fine, F.lit(False))).select("id", "label", F.transform("v", lambda v: v + F.lit(0.0)).alias("v"))
    classes = stored(valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vec-classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    ids = rows.select("id")
    if not facts.n:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = facts.dim
    lists = lists or max(8, min(4096, round(math.sqrt(facts.n) / 2)))

    def unit(values: list) -> np.ndarray:
        """Rows of length 1, scaled first so that squares neither overflow nor vanish."""
        x = np.zeros((len(values), dim))
        for i, v in enumerate(values):
            x[i, : len(v)] = v
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x**2).sum(axis=1, keepdims=True))

    sample = classes.orderBy(F.xxhash64("rep", "label"), "rep").limit(SAMPLE).select("v").collect()
    model = spark.sparkContext.broadcast(Quantiser(unit([r.v for r in sample]), lists))

    def indexed(batches):
        q = model.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                piece = batch.slice(start, 2000)
                x = unit(piece.column("v").to_pylist())
                far = q.distances(x)
                at = far.argmin(axis=1)
                code, error = q.codes(x, at)
                probes = [np.flatnonzero(f <= f[a] + margin).astype(np.int32) for f, a in zip(far, at)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("label"), piece.column("rep"), piece.column("n"), pa.array(at, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array([p.tolist() for p in probes], pa.list_(pa.int32()))],
                    ["label", "rep", "n", "list", "x", "code", "error", "probes"],
                )

    index = stored(
        classes.mapInArrow(indexed, "label string, rep bigint, n bigint, list int, x binary, code binary, error double, probes array<int>"), "vec-index"
    )
    none = F.lit(None)
    probing = index.select("label", "rep", "n", F.col("list").alias("home"), "x", F.explode("probes").alias("list"))
    owned = index.groupBy("label", "list").agg(F.count("*").alias("own"))
    asked = probing.groupBy("label", "list").agg(F.count("*").alias("ask"))
    sizes = stored(
        owned.join(asked, ["label", "list"]).select(
            "label", "list", F.expr(f"cast(ceil(own / {OWN_BLOCK}) as int)").alias("ob"), F.expr(f"cast(ceil(ask / {PROBE_BLOCK}) as int)").alias("pb")
        ), "vec-sizes",
    )
    hashed = F.xxhash64("rep", "label")
    a = index.join(sizes, ["label", "list"]).select(
        "label", "list", F.pmod(hashed, F.col("ob")).cast("int").alias("o"), F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("p"),
        F.lit(True).alias("own"), "rep", "n", F.col("list").alias("home"), "x", "code", "error",
    )
    b = probing.join(sizes, ["label", "list"]).select(
        "label", "list", F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("o"), F.pmod(hashed, F.col("pb")).cast("int").alias("p"),
        F.lit(False).alias("own"), "rep", "n", "home", "x", none.cast("binary").alias("code"), none.cast("double").alias("error"),
    )

    def searched(table: pa.Table) -> pa.Table:
        q = model.value
        own = table.column("own").to_numpy()
        mine, asking = table.filter(pa.array(own)), table.filter(pa.array(~own))
        names = ["rep", "links", "to"]
        if not mine.num_rows or not asking.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        at = table.column("list")[0].as_py()
        x, y = _vectors(mine.column("x")), _vectors(asking.column("x"))
        code = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        error = mine.column("error").to_numpy()
        reach = 2 - 2 * threshold
        # the code's error is nearly at right angles to the difference of a close pair
        bound = reach + error**2 + SPREAD * 2 * math.sqrt(reach) * error / math.sqrt(q.dim) + 1e-4
        i, j = np.nonzero(q.asymmetric(y, at, code) <= bound.astype(np.float32))
        close = np.concatenate([(y[i[k : k + 200_000]] * x[j[k : k + 200_000]]).sum(axis=1) for k in range(0, len(i), 200_000)] or [np.zeros(0)]) >= threshold
        i, j = i[close], j[close]
        ids, others = mine.column("rep").to_numpy(), asking.column("rep").to_numpy()
        home = asking.column("home").to_numpy()
        apart = ids[j] != others[i]
        i, j = i[apart], j[apart]
        foreign = home[i] != at
        if foreign.any():  # where both sides probe each other, the smaller list counts the pair
            far = q.distances(x)
            asks = far <= far[:, [at]] + margin
            keep = ~foreign | (home[i] > at) | ~asks[j, home[i]]
            i, j, foreign = i[keep], j[keep], foreign[keep]
        n, m = mine.column("n").to_numpy(), asking.column("n").to_numpy()
        to_y = np.bincount(i, n[j], len(y)).astype(np.int64)
        to_x = np.bincount(j[foreign], m[i[foreign]], len(x)).astype(np.int64)
        low_x, low_y = ids.copy(), others.copy()
        while True:
            before = low_x.sum() + low_y.sum()
            np.minimum.at(low_x, j, low_y[i])
            np.minimum.at(low_y, i, low_x[j])
            if low_x.sum() + low_y.sum() == before:
                break
        rep, count, to = np.concatenate([ids, others]), np.concatenate([to_x, to_y]), np.concatenate([low_x, low_y])
        some = (count > 0) | (to != rep)
        return pa.table([pa.array(rep[some]), pa.array(count[some]), pa.array(to[some])], names)

    found = stored(a.union(b).groupBy("label", "list", "o", "p").applyInArrow(searched, "rep bigint, links bigint, to bigint"), "vec-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    merged = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    per_class = (
        classes.join(counts, "rep", "left").join(merged.toDF("rep", "component"), "rep", "left")
        .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    by_id = valid.join(per_class, ["label", "v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    return ids.join(by_id, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )
