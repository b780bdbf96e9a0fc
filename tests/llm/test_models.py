"""Classifiers by held-out accuracy, embedding links by brute force, the pipeline stage by stage."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlines.llm import embedding_dedup, quality, toxicity
from faultlines.llm.components import components

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("method,label,least", [(toxicity, "toxic", 0.8), (quality, "quality", 0.95)])
def test_held_out(spark, method, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = method.fit(docs, labels.where(fold != 1))
    rows = method.score(docs, model).join(labels.where(fold == 1), "doc_id").collect()
    assert auc(np.array([r.score for r in rows]), np.array([r[label] for r in rows])) > least
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("method,label", [(toxicity, "toxic"), (quality, "quality")])
def test_without_labels_and_hard_rows(spark, docs, none, clashing, method, label):
    empty = spark.createDataFrame([], f"doc_id long, {label} int")
    model = method.fit(docs, empty)
    scores = {r.score for r in method.score(docs, model).collect()}
    assert len(scores) == 1 and max(scores) < 1e-6
    one = spark.createDataFrame([(1, 1), (4, 1), (None, 1), (7, None)], f"doc_id long, {label} int")
    assert {round(r.score, 6) for r in method.score(docs, method.fit(docs, one)).collect()} == {1.0}
    assert method.score(none, model).collect() == [] and method.score(clashing, model).count() == 3


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    margin = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-3 * margin))).astype(float)
    at, level = toxicity.isotonic(margin, y)
    assert (np.diff(level) >= 0).all() and (np.diff(at) >= 0).all()


def test_factorisation_machine_identity():
    """The linear-time form equals the sum over pairs."""
    rng = np.random.default_rng(4)
    model = quality._constant(0.5)
    model.factor = rng.normal(size=model.factor.shape)
    model.weight = rng.normal(size=model.weight.shape)
    r, c, v = np.zeros(5, int), np.array([3, 9, 11, 20, 40]), rng.normal(size=5)
    dense = rng.normal(size=(1, quality.STATS))
    x = np.zeros(quality.WORDS + quality.STATS)
    x[c], x[quality.WORDS :] = v, dense[0]
    own = np.flatnonzero(x)
    pairs = sum(model.factor[i] @ model.factor[j] * x[i] * x[j] for k, i in enumerate(own) for j in own[k + 1 :])
    assert np.isclose(model.margin(1, r, c, v, dense)[0], model.bias + model.weight @ x + pairs)


def brute_links(rows, threshold):
    fine = [(i, l, np.array(v, float)) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    wide = max(len(v) for _, _, v in fine)
    fine = [(i, l, np.pad(v, (0, wide - len(v)))) for i, l, v in fine]
    count, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, l, v) in enumerate(fine):
        for j, m, w in fine[k + 1 :]:
            if l == m and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                count[i] += 1
                count[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (count[i], root(i)) for i in count}


def vectors():
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(60)]
    for i in range(60, 160):
        base = np.array(rows[i % 7][1])
        rows.append((i, (base * (1 + i % 3) + rng.normal(size=16) * 0.05).tolist(), rows[i % 7][2]))
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(5)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None, 1.0], 0), (304, rows[0][1], None), (305, [1.0, 2.0], 0), (306, [], 0), (307, [float("inf")] + [0.0] * 15, 1)]
    return rows


@pytest.mark.parametrize("blocks", [(1024, 4096), (8, 16)])
def test_embedding_links(spark, monkeypatch, blocks):
    monkeypatch.setattr(embedding_dedup, "OWN_BLOCK", blocks[0])
    monkeypatch.setattr(embedding_dedup, "PROBE_BLOCK", blocks[1])
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("x")).withColumn("list", F.lit(3))
    found = embedding_dedup.links(frame, 0.98, lists=6, margin=10.0).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute_links(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_embedding_recall_and_empty(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_links(rows, 0.98)
    found = {r.vec_id: r.n_links for r in embedding_dedup.links(frame, 0.98).collect()}
    assert all(found[i] <= want[i][0] for i in found)
    assert sum(found.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert embedding_dedup.links(frame.where("vec_id < 0"), 0.98).collect() == []
    assert [r.n_links for r in embedding_dedup.links(frame.where("vec_id = 300"), 0.98).collect()] == [0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 501), (501, 500)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(1, 41)) and all(found[100 + i] == 100 for i in range(30)) and found[501] == 500
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, rows, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns, name
        rows = kept.checkpoint() if spark.sparkContext.getCheckpointDir() else P.stored(kept, name)
    after = {r.doc_id: r for r in rows.collect()}
    assert len(after) > 0.7 * len(before) and all(r.n_chars == len(r.text) for r in after.values())
    assert {r.doc_id for r in P.run(spark, "/root/testdata/sf0.001").collect()} == set(after)


def test_pipeline_stages_on_hard_rows(spark, docs, none, clashing):
    import corpus_pipeline as P

    for name, stage in P.STAGES[:-1]:
        for rows, least in ((docs, 1), (none, 0), (clashing, 1)):
            found = stage(spark, rows, "/root/testdata/sf0.001")
            assert found.columns == rows.columns and found.count() >= least, name
    assert P.STAGES[-1][1](spark, none, "/root/testdata/sf0.001").collect() == []


def test_pipeline_removes_what_a_stage_stored(spark, docs):
    import os

    import corpus_pipeline as P
    from faultlines.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    P._release(spark)
    before = set(os.listdir(folder))
    kept = P.stored(P.near_duplicate_stage(spark, docs, ""), "kept")
    assert len(set(os.listdir(folder)) - before) > 3
    P.secret_stage(spark, kept, "").count()
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"kept"}
