import random

import numpy as np
import pyarrow as pa
import pytest

from vexel.llm import classifier as c
from vexel.llm.blocks import blocks

WANTED = {"quality": 1, "toxic": 0}


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(2000)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 150))]
        junk, toxic = rng.random() < 0.2, rng.random() < 0.15
        if junk:
            text = [w + "###" if rng.random() < 0.3 else w for w in text] + ["buy", "now"]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["moron", "fool", "dolt"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500, 1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    model = c.fit(df, spark.createDataFrame(labels[:1000], "doc_id bigint, quality int, toxic int"), WANTED, fit_rows=600)
    got = {r.doc_id: r for r in c.score(df, model).collect()}
    assert len(got) == 1500
    for name, k in (("quality", 1), ("toxic", 2)):
        right = [(got[d[0]][f"{name}_score"] >= 0) == (d[k] == 1) for d in labels[1000:]]
        assert np.mean(right) > 0.97
    assert all(r.keep == (r.quality_score >= 0 and r.toxic_score < 0) for r in got.values())


def test_ratios_and_margins_equal_naive_ones(spark):
    """Counts, log ratios and margins, document by document from the word sequences themselves."""
    docs, labels = corpus(120, 5)
    buckets = 1 << 12
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    model = c.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), WANTED, fit_rows=10**9, buckets=buckets)
    grams = {d: {*(w := t.lower().split()), *map(" ".join, zip(w, w[1:]))} for d, t in docs}
    names = sorted(set().union(*grams.values()))
    (block,) = blocks(pa.array(names))
    of = {n: set() for n in names}
    for row, bucket in zip(*(x.tolist() for x in c.features(block, buckets))):
        of[names[row]].add(bucket)
    own = {d: sorted(set().union(*(of[g] for g in s))) for d, s in grams.items()}
    got = {r.doc_id: r for r in c.score(df, model).collect()}
    for k, name in enumerate(WANTED):
        share = []
        for side in (0, 1):
            count = np.ones(buckets)
            for label in labels:
                if label[k + 1] == side:
                    count[own[label[0]]] += 1
            share.append(count / count.sum())
        ratio = np.log(share[1]) - np.log(share[0])
        head = model.heads[k]
        assert np.allclose(head.ratio, ratio, atol=1e-5)
        for d, s in own.items():
            margin = ratio[s] @ head.weight[s] / np.linalg.norm(ratio[s]) + head.bias
            assert abs(got[d][f"{name}_score"] - margin) < 1e-4


def test_features_are_distinct_indicators():
    for block in blocks(pa.array(["a b A b", "", None, "a"])):
        row, bucket = c.features(block)
        assert np.bincount(row, minlength=4).tolist() == [4, 0, 0, 1]  # a, b, "a b", "b a"
        assert bucket[row == 3][0] in bucket[row == 0]


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    n, d = 60, 5
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=n) > 0, 1.0, -1.0)
    w, b = c.descend(np.arange(n + 1) * d, np.tile(np.arange(d), n), x.ravel(), y, d, epochs=3000)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * n

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + (weight * np.maximum(0, 1 - y * (x @ w + b))).sum()

    best = loss(w, b)
    for _ in range(2000):
        assert loss(w + rng.normal(size=d) * 0.02, b + rng.normal() * 0.02) > best - 1e-2


def test_edges(spark):
    docs = [(1, "good words here"), (2, "bad words here"), (3, None), (4, ""), (None, "good"), (1, "good words here")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = c.fit(df, labels, WANTED, buckets=1 << 12)
    got = c.score(df.selectExpr("doc_id", "text", "7 as keep", "8 as quality_score"), model).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.quality_score, r.toxic_score, r.keep))
    assert len(by[1]) == 1 and next(iter(by[1]))[2]
    assert not next(iter(by[2]))[2]
    assert by[3] == by[4]
    assert all(r.toxic_score == -1 for r in got)  # one class only
    assert c.score(df.limit(0), model).count() == 0
    none = c.fit(df, labels.limit(0), WANTED, buckets=1 << 12)
    assert all(r.keep and r.quality_score == 0 for r in c.score(df, none).collect())


@pytest.mark.parametrize("fit_rows", [0, 10**9])
def test_fit_rows_bounds_the_sample(spark, fit_rows):
    docs, labels = corpus(100, 2)
    model = c.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), WANTED, fit_rows=fit_rows, buckets=1 << 12)
    assert model.heads[0].weight.any() == (fit_rows > 0)
