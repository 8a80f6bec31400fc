import json
import math
import random

import pytest

from vexel.functions import Metric
from vexel.operators import VectorStore, knn

NAN = float("nan")


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_worst_first_order_of_insertion(spark):
    store = VectorStore(spark, Metric.EUCLIDEAN).add([("5", [5.0]), ("3", [3.0]), ("4", [4.0]), ("1", [1.0])])
    assert ids(store.search([0.0], 2)) == ["1", "3"]


@pytest.mark.parametrize("metric", list(Metric))
def test_search_and_ties(spark, metric):
    rng = random.Random(int(metric))
    rows = [(f"v{i % 30}", [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(80)]
    store = VectorStore(spark, metric).add(rows)
    query = [1.0, -2.0, 0.5]

    def score(v):
        dot = sum(x * y for x, y in zip(query, v))
        length = math.sqrt(sum(x * x for x in query) * sum(x * x for x in v))
        return (1 - (dot / length if length else 0), math.dist(query, v), sum(abs(x - y) for x, y in zip(query, v)), -dot)[metric]

    want = sorted(range(80), key=lambda i: (round(score(rows[i][1]), 12), i))[:15]
    assert ids(store.search(query, 15)) == [rows[i][0] for i in want]


def test_k_and_empty(spark):
    store = VectorStore(spark).add([("a", [1.0, 0.0]), ("b", [0.0, 1.0])])
    assert ids(store.search([1.0, 0.1], 10)) == ["a", "b"]
    assert ids(store.search([1.0, 0.1], 0)) == ids(store.search([1.0, 0.1], -3)) == []
    assert ids(VectorStore(spark).search([1.0], 5)) == [] and len(VectorStore(spark)) == 0
    with pytest.raises(ValueError):
        VectorStore(spark, 7)


def test_mixed_lengths_and_nan(spark):
    rows = [("long", [1.0, 2.0, 3.0]), ("nan", [NAN, 1.0]), ("near", [1.0, 1.0]), ("nil", None)]
    euclid = VectorStore(spark, Metric.EUCLIDEAN).add(rows)
    assert [(r.id, r.distance) for r in euclid.search([1.0, 2.0], 9).orderBy("rank").collect()][:3] == [("long", 0), ("nil", 0), ("near", 1)]
    for metric in Metric:
        assert ids(VectorStore(spark, metric).add(rows).search([1.0, 2.0], 4))[-1] == "nan"
    with pytest.raises(ValueError):
        euclid.validate_dims()
    assert VectorStore(spark).add(rows[1:3]).validate_dims()


def test_add_get_remove(spark):
    store = VectorStore(spark).add([("a", [1.0]), ("b", [2.0])]).add([("a", [3.0]), ("c", [4.0])])
    assert [(r.seq, r.id) for r in store.rows.orderBy("seq").collect()] == [(0, "a"), (1, "b"), (2, "a"), (3, "c")]
    assert store.get("a").first().vector == [1.0] and store.get("x").first() is None
    less, found = store.remove("a")
    assert found and [(r.seq, r.id) for r in less.rows.orderBy("seq").collect()] == [(0, "c"), (1, "b"), (2, "a")]
    assert less.get("a").first().vector == [3.0]
    last, found = less.remove("a")
    assert found and [r.id for r in last.rows.orderBy("seq").collect()] == ["c", "b"]
    same, found = last.remove("a")
    assert not found and len(same) == 2 and len(store) == 4


@pytest.mark.parametrize("metric", list(Metric))
def test_blocks_equal_the_plain_form(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 7)
    rng = random.Random(int(metric) + 10)

    def vector():
        kind = rng.random()
        if kind < 0.05:
            return [NAN, 1.0, 0.0]
        if kind < 0.1:
            return [float("inf"), 1.0, 0.0]
        return [float(rng.randrange(-2, 3)) * rng.choice([1, 0.1, 1e6]) for _ in range(rng.choice([0, 2, 3, 3, 3, 3]))] if kind > 0.12 else None

    store = spark.createDataFrame([(i, vector()) for i in range(60)], "seq bigint, vector array<double>")
    queries = spark.createDataFrame([(i, vector() or []) for i in range(15)], "query_id bigint, query array<double>")
    store = store.selectExpr("seq", "coalesce(vector, array()) vector")

    def rows(df):
        return sorted((r.query_id, r.rank, r.seq, str(r.distance + 0.0)) for r in df.collect())

    for k in (0, 1, 5, 100):
        assert rows(knn.search_each(queries, store, k, metric)) == rows(knn.search_each_plain(queries, store, k, metric))


def test_search_each_names_ids(spark):
    store = VectorStore(spark, Metric.EUCLIDEAN).add([("a", [0.0]), ("b", [2.0])])
    queries = spark.createDataFrame([(1, [0.5]), (2, [3.0])], "query_id bigint, query array<double>")
    assert sorted((r.query_id, r.id, r.distance) for r in store.search_each(queries, 1).collect()) == [(1, "a", 0.5), (2, "b", 1.0)]


def test_files(spark, tmp_path):
    rows = [("vec", [float(i), float(i + 1), float(i + 2)]) for i in range(100)]
    store = VectorStore(spark, Metric.MANHATTAN).add(rows)
    query = [50.0, 51.0, 52.0]
    for path, save, load in ((f"{tmp_path}/s", "save", "load"), (f"{tmp_path}/s.json", "save_json", "load_json")):
        getattr(store, save)(path)
        again = getattr(VectorStore, load)(spark, path)
        assert again.metric is Metric.MANHATTAN and len(again) == 100
        key = lambda s: [(r.rank, r.distance, r.vector) for r in s.search(query, 5).orderBy("rank").collect()]
        assert key(again) == key(store)
    again = VectorStore.load(spark, f"{tmp_path}/s")
    again.remove("vec")[0].save(f"{tmp_path}/s")  # over its own source
    assert len(VectorStore.load(spark, f"{tmp_path}/s")) == 99
    VectorStore(spark, Metric.DOT_PRODUCT).save_json(f"{tmp_path}/e.json")
    empty = VectorStore.load_json(spark, f"{tmp_path}/e.json")
    assert empty.metric is Metric.DOT_PRODUCT and len(empty) == 0


def test_json_form_and_bad_files(spark, tmp_path):
    VectorStore(spark, 3).add([("x", [0.5, 0.25]), ("y", [1.0])]).save_json(f"{tmp_path}/s.json")
    text = (tmp_path / "s.json").read_text()
    assert json.loads(text) == {"Vectors": [[0.5, 0.25], [1.0]], "IDs": ["x", "y"], "Metric": 3} and text.startswith('{\n  "Vectors"')
    (tmp_path / "bad.json").write_text('{"Vectors": [[1]], "IDs": ["a", "b"], "Metric": 0}')
    with pytest.raises(ValueError):
        VectorStore.load_json(spark, f"{tmp_path}/bad.json")
    with pytest.raises(ValueError):
        VectorStore(spark).add([("n", [NAN])]).save_json(f"{tmp_path}/n.json")
    with pytest.raises(Exception):
        VectorStore.load(spark, f"{tmp_path}/missing")


def test_stream(spark, tmp_path):
    from vexel.streaming.search import search_stream

    store = VectorStore(spark, Metric.EUCLIDEAN).add([("a", [0.0]), ("b", [2.0])])
    spark.createDataFrame([(1, [0.5]), (2, [3.0])], "query_id bigint, query array<double>").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("query_id bigint, query array<double>").parquet(f"{tmp_path}/in")
    got = []
    search_stream(stream, store, 1, lambda df, _: got.extend((r.query_id, r.id) for r in df.collect()), f"{tmp_path}/check").awaitTermination()
    assert sorted(got) == [(1, "a"), (2, "b")]


def test_tasks_keep_the_best_of_all_their_blocks(spark, monkeypatch):
    from vexel.operators import knn

    monkeypatch.setattr(knn, "BLOCK", 7)
    monkeypatch.setattr(knn, "HELD", 40)
    rows = spark.createDataFrame([(i, [float(i * i % 31), float(i % 5), 1.0]) for i in range(90)], "seq BIGINT, vector ARRAY<DOUBLE>").repartition(3)
    queries = rows.selectExpr("seq as query_id", "vector as query").where("seq < 30")
    for metric in Metric:
        want = knn.search_each_plain(queries, rows, 4, metric)
        assert sorted(map(str, knn.search_each(queries, rows, 4, metric).collect())) == sorted(map(str, want.collect()))


def test_a_store_that_has_no_json_form_leaves_the_old_file(spark, tmp_path):
    path = f"{tmp_path}/s.json"
    VectorStore(spark).add([("a", [1.0, 2.0])]).save_json(path)
    with pytest.raises(ValueError):
        VectorStore(spark).add([("a", [1.0]), ("b", [float("nan")])]).save_json(path)
    assert VectorStore.load_json(spark, path).rows.count() == 1
    VectorStore(spark).save_json(path)
    assert VectorStore.load_json(spark, path).rows.count() == 0


@pytest.mark.parametrize("metric", list(Metric))
def test_stored_vectors_stream_past_their_queries(spark, metric, capsys):
    """No pair of blocks is a row, rough scores in float32 and in bytes lose no neighbour, and ties stay in order."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(int(metric))
    v = rng.normal(size=(300, 9)) * 1e-2 + 40
    v[100:140] = v[:40]
    v[5], v[6, 0], v[7] = 0, NAN, v[7] * 1e200
    q = v[:60]

    def rows(kind, x):
        return pa.RecordBatch.from_arrays([pa.array([0] * len(x), pa.int32()), pa.array([kind] * len(x), pa.int32()), pa.array(range(len(x))), pa.array(list(x), pa.list_(pa.float64()))], ["cell", "kind", "id", "v"])

    met = list(knn._closest(4, metric, 64, 500)([rows(0, q), rows(1, v)]))
    got = knn._ranked(*(np.concatenate([b.column(c).to_numpy() for b in met]) for c in range(3)), 4, metric)
    with np.errstate(all="ignore"):
        score = knn._exact(np.repeat(q, 300, axis=0), np.tile(v, (60, 1)), metric)
    want = knn._ranked(np.repeat(np.arange(60), 300), np.tile(np.arange(300), 60), score, 4, metric)
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(got, want))
    rows = spark.createDataFrame([(1, [1.0])], "query_id bigint, query array<double>")
    knn.search_each(rows, rows.toDF("seq", "vector"), 1, metric).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_json_is_read_by_many_tasks(spark, tmp_path):
    """A file as it is saved is split; ids with quotes and vectors of any length come back in order, and other layouts are read whole."""
    path = f"{tmp_path}/s.json"
    rows = [(f'i,"{i}",\n é],', [float(i), 0.1] * (i % 3)) for i in range(500)]
    VectorStore(spark, Metric.MANHATTAN).add(rows).save_json(path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        again = VectorStore.load_json(spark, path)
        got = [(r.seq, r.id, r.vector) for r in again.rows.orderBy("seq").collect()]
        tasks = spark.read.text(path).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert again.metric is Metric.MANHATTAN and tasks > 3
    assert [(n, i) for n, i, _ in got] == [(n, i) for n, (i, _) in enumerate(rows)]
    assert all(v == pytest.approx(w) for (_, _, v), (_, w) in zip(got, rows))
    assert "Generate" not in again.rows._jdf.queryExecution().toString()  # not one row of the whole file
    for text in ('{"Vectors": [[1.0],[2.0]], "IDs": ["a","b"], "Metric": 1}', json.dumps({"Vectors": [[1.0], [2.0]], "IDs": ["a", "b"], "Metric": 1}, indent=2)):
        (tmp_path / "o.json").write_text(text)
        other = VectorStore.load_json(spark, f"{tmp_path}/o.json")
        assert [(r.id, r.vector) for r in other.rows.orderBy("seq").collect()] == [("a", [1.0]), ("b", [2.0])]
