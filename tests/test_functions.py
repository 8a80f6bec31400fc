import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vexel import functions as V
from vexel.functions import Metric

NAN = float("nan")
PAIRS = [
    ([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]),
    ([0.0, 0.0], [1.0, 2.0]),
    ([-1.0, 2.0], [3.0, -4.0]),
    ([1.0, 2.0], [1.0, 2.0, 3.0]),
    ([], []),
    ([1.0, 1.0], [1.0, 0.0]),
    ([1.0, 0.0], [-1.0, 0.0]),
    ([1.0, 2.0], [1.0001, 1.9999]),
    ([NAN, 1.0], [2.0, 1.0]),
    (None, [1.0]),
    ([5.0], [5.0]),
]


def expected(a, b):
    """All functions in plain Python."""
    if a is None:
        return dict.fromkeys(("dot", "cosine", "cosine_distance", "euclidean", "manhattan", "add", "sub", "equal", "eps"))
    same = len(a) == len(b)
    dot = sum(x * y for x, y in zip(a, b)) if same else 0.0
    length = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) if same else 0.0
    cosine = dot / length if length else 0.0
    return {
        "dot": dot,
        "cosine": cosine,
        "cosine_distance": 1 - cosine,
        "euclidean": math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))) if same else 0.0,
        "manhattan": sum(abs(x - y) for x, y in zip(a, b)) if same else 0.0,
        "add": [x + y for x, y in zip(a, b)] if same else None,
        "sub": [x - y for x, y in zip(a, b)] if same else None,
        "equal": same and not any(abs(x - y) > 1e-6 for x, y in zip(a, b)),
        "eps": same and not any(abs(x - y) > 1e-3 for x, y in zip(a, b)),
    }


def agree(got, want):
    if isinstance(want, list):
        return got is not None and len(got) == len(want) and all(map(agree, got, want))
    if isinstance(want, float):
        return math.isnan(got) if math.isnan(want) else got == pytest.approx(want, abs=1e-12)
    return got == want


def test_pairs(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, a array<double>, b array<double>")
    cols = [V.dot("a", "b").alias("dot"), V.cosine("a", "b").alias("cosine"), V.cosine_distance("a", "b").alias("cosine_distance"), V.euclidean("a", "b").alias("euclidean"), V.manhattan("a", "b").alias("manhattan"), V.add("a", "b").alias("add"), V.sub("a", "b").alias("sub"), V.equal("a", "b").alias("equal"), V.equal_eps("a", "b", 1e-3).alias("eps")]
    for r in df.select("i", *cols).collect():
        for name, want in expected(*PAIRS[r.i]).items():
            assert agree(r[name], want), (PAIRS[r.i], name, r[name], want)


def test_single_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([],), ([1.0, 2.0, 3.0],)]
    got = spark.createDataFrame(rows, "v array<float>").select(V.dims("v").alias("n"), V.norm("v").alias("norm"), V.normalize("v").alias("unit"), V.scale("v", 2).alias("twice"), V.scale("v", 0).alias("none"), V.clone("v").alias("same")).collect()
    assert [r.n for r in got] == [2, 2, 0, 3]
    assert [r.norm for r in got] == pytest.approx([5, 0, 0, math.sqrt(14)])
    assert got[0].unit == pytest.approx([0.6, 0.8]) and got[1].unit is None and got[2].unit is None
    assert got[3].twice == [2, 4, 6] and got[3].none == [0, 0, 0] and got[2].twice == []
    assert [r.same for r in got] == [r[0] for r in rows]


def test_dispatch_and_direction(spark):
    df = spark.createDataFrame([(m,) for m in range(-1, 5)], "m int").select("m", F.array(F.lit(1.0), F.lit(0.0)).alias("a"), F.array(F.lit(0.0), F.lit(1.0)).alias("b"))
    want = {-1: 0, 0: 1, 1: math.sqrt(2), 2: 2, 3: 0, 4: 0}
    assert {r.m: r.d for r in df.select("m", V.distance("a", "b", F.col("m")).alias("d")).collect()} == pytest.approx(want)
    for m, value in want.items():
        assert df.select(V.distance("a", "b", m).alias("d")).first().d == pytest.approx(value)
    assert [m.ascending for m in Metric] == [True, True, True, False]
    assert [int(m) for m in (Metric.COSINE, Metric.EUCLIDEAN, Metric.MANHATTAN, Metric.DOT_PRODUCT)] == [0, 1, 2, 3]


def test_sql_functions_agree_with_columns(spark):
    V.register(spark)
    spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, a array<double>, b array<double>").createOrReplaceTempView("pairs")
    rows = spark.sql("select i, vec_dot(a, b) dot, vec_cosine(a, b) cosine, vec_cosine_distance(a, b) cosine_distance, vec_euclidean(a, b) euclidean, vec_manhattan(a, b) manhattan, vec_add(a, b) `add`, vec_sub(a, b) sub, vec_equal(a, b) equal, vec_equal_eps(a, b, 1e-3) eps from pairs").collect()
    for r in rows:
        if PAIRS[r.i][0] is not None:
            for name, want in expected(*PAIRS[r.i]).items():
                assert agree(r[name], want), (PAIRS[r.i], name)
    one = spark.sql("select vec_dims(array(1D, 2D)) d, vec_norm(array(3D, 4D)) n, vec_normalize(array(0D)) u, vec_scale(array(1D), 3D) s, vec_distance(array(1D), array(3D), 1) e, vec_distance(array(1D), array(3D), 9) x, text_tokens('Ab c é') t").first()
    assert (one.d, one.n, one.u, one.s, one.e, one.x, one.t) == (2, 5, None, [3], 2, 0, ["ab", "é"])


def test_tokens(spark):
    cases = {"Hello, World! This is a TEST.": ["hello", "world", "this", "is", "test"], "a b c x y z": [], "é a": ["é"], "İΣ ΟΔΟΣ": ["iσ", "οδοσ"], "x1 22 _ab_": ["x1", "22", "ab"], "": []}
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", V.tokenize("t").alias("w"))
    assert {r.t: r.w for r in df.collect()} == {**cases, None: None}


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_properties(spark, seed):
    rng = random.Random(seed)
    rows = [([rng.uniform(-5, 5) for _ in range(6)], [rng.uniform(-5, 5) for _ in range(6)]) for _ in range(20)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for m in (Metric.COSINE, Metric.EUCLIDEAN, Metric.MANHATTAN):
        for r in df.select(m.score("a", "b").alias("x"), m.score("b", "a").alias("y"), m.score("a", "a").alias("z")).collect():
            assert r.x == pytest.approx(r.y) and r.z == pytest.approx(0, abs=1e-12)
    assert all(r.n == pytest.approx(1) for r in df.select(V.norm(V.normalize("a")).alias("n")).collect())
