import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import ann


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(e) for e in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")


def truth(x, k):
    x = x.astype(np.float32).astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    return np.argsort(-sim, axis=1, kind="stable")[:, :k]


def recall(rows, want):
    got = {}
    for i, n in rows:
        got.setdefault(i, set()).add(n)
    return np.mean([len(got[i] & set(w)) / len(w) for i, w in enumerate(want)])


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(0).normal(size=(1200, 24))


def test_descent_recall(spark, points, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    rows = ann.nearest(table(spark, points), k=10).collect()
    assert len(rows) == 12000 and {r.rank for r in rows} == set(range(1, 11))
    assert recall([(r.id, r.neighbour) for r in rows], truth(points, 10)) >= 0.95
    unit = points.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert all(abs(r.cosine - unit[r.id] @ unit[r.neighbour]) < 1e-6 for r in rows)


def test_recall_in_tight_clusters(spark, points, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    centres = np.random.default_rng(4).normal(size=(2, 24))
    tight = np.repeat(centres, 600, axis=0) + points * 0.05
    assert np.median(ann.unpack_codes(ann.pack_codes(tight[:600])) @ ann.unpack_codes(ann.pack_codes(tight[:1])).T) > 0.99
    rows = ann.nearest(table(spark, tight), k=10).collect()
    assert recall([(r.id, r.neighbour) for r in rows], truth(tight, 10)) >= 0.95


def test_small_tables_are_exact(spark, points):
    rows = ann.nearest(table(spark, points[:200]), k=10).collect()
    assert recall([(r.id, r.neighbour) for r in rows], truth(points[:200], 10)) == 1


def test_greedy_search_recall(spark, points, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    queries = np.random.default_rng(1).normal(size=(40, 24))
    rows = ann.answer(table(spark, queries), table(spark, points), k=10).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    want = np.argsort(-(queries @ unit.T), axis=1)[:, :10]
    assert recall([(r.id, r.neighbour) for r in rows], want) >= 0.9


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (7, [0.0, 0.0]), (8, [1.0, 0.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as id", "2 as node", "3 as code")
    got = {(r.id, r.rank): (r.neighbour, round(r.cosine, 4)) for r in ann.nearest(df, k=2).collect()}
    assert set(got) == {(i, k) for i in (1, 2, 7, 8) for k in (1, 2)}
    assert got[1, 1] == (8, 1.0) and got[1, 2][0] == 2
    assert got[7, 1] == (1, 0.0) and got[7, 2] == (2, 0.0)
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 1")).count() == 0


def test_best_drops_repeats_and_orders_ties():
    q, n, s = np.array([1, 1, 1, 1, 2]), np.array([9, 5, 5, 7, 5]), np.array([0.5, 0.5, 0.9, 0.5, 0.1])
    keep = ann.best(q, n, s, 3)
    assert [(q[i], n[i], s[i]) for i in keep] == [(1, 5, 0.9), (1, 7, 0.5), (1, 9, 0.5), (2, 5, 0.1)]


def test_ties_go_to_lesser_ids(spark):
    x = np.tile([0.5, 0.25, -1.0], (300, 1))
    got = {}
    for r in ann.nearest(table(spark, x), k=4).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert got == {i: [(k + 1, n) for k, n in enumerate([n for n in range(6) if n != i][:4])] for i in range(300)}


def test_hot_cells_and_hubs(spark, points, monkeypatch):
    """A third of all vectors equal, in cells of many parts, and one that is near to all others."""
    monkeypatch.setattr(ann, "CELL", 100)
    monkeypatch.setattr(ann, "CUT", 150)
    x = np.concatenate((np.repeat(points[:1], 400, axis=0), points[1:800], points.mean(axis=0, keepdims=True)))
    rows = ann.nearest(table(spark, x), k=10, which=F.col("vec_id") % 25 == 0).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r)
    assert set(got) == set(range(0, 1200, 25)) and all(len(v) == 10 for v in got.values())
    assert all(r.neighbour < 400 and abs(r.cosine - 1) < 1e-9 for i, v in got.items() if i < 400 for r in v)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -9)
    edge = np.sort(sim, axis=1)[:, -10]
    assert np.mean([r.cosine >= edge[i] - 1e-6 for i, v in got.items() for r in v]) >= 0.95


def test_picked_rows_search_all(spark, points):
    rows = ann.nearest(table(spark, points[:600]), k=10, which=F.col("vec_id") % 100 == 0).collect()
    assert {r.id for r in rows} == set(range(0, 600, 100))
    want = truth(points[:600], 10)
    assert np.mean([r.neighbour in want[r.id] for r in rows]) >= 0.95
