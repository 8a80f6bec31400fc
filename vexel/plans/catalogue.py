"""Registered queries over the vector and text operators, with their DuckDB SQL.

Vectors are compared as (row, dim, value); scores are rounded to six places on both sides.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vexel import functions as V
from vexel.functions.metric import Metric
from vexel.operators import HTTPEmbedder, OnnxEmbedder, RandomProjection, VectorStore, WordPiece, knn
from vexel.sources import scratch

Query = Callable[[SparkSession, str], DataFrame]
K, DIMS, QUERY_ID = 10, 24, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one of the next id."""
    own = _embeddings(spark, sf_dir)
    return own.join(own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


def _store(spark: SparkSession, sf_dir: str, metric: Metric = Metric.COSINE) -> VectorStore:
    return VectorStore.of(table(spark, sf_dir, "embeddings"), metric, "vec_id", "vec_id", "embedding")


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).select("embedding").first()
    return list(row.embedding) if row else []


def _r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


_FLAT = "vec_id", "dim", "value"


def _flat(rows: DataFrame, vector: Column) -> DataFrame:
    return rows.select("vec_id", F.posexplode(vector).alias("dim", "value")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), _r6(F.col("value")).alias("value"))


_E = "e as (select vec_id, embedding::double[] a from embeddings)"
_P = f"with {_E}, p as (select x.vec_id, x.a, y.a b from e x join e y on y.vec_id = x.vec_id + 1)"
_UNROLL = "select vec_id, cast(i - 1 as bigint) dim, round(v[i], 6) + 0.0 as value from (select vec_id, v, unnest(range(1, len(v) + 1)) i from v)"
_DIST = {
    Metric.COSINE: "list_cosine_distance({a}, {b})",
    Metric.EUCLIDEAN: "list_distance({a}, {b})",
    Metric.MANHATTAN: "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
    Metric.DOT_PRODUCT: "list_dot_product({a}, {b})",
}
_TOKENS = r"list_filter(string_split_regex(lower(translate(text, 'İΣ', 'iσ')), '[^\p{L}\p{Nd}]+'), lambda t: strlen(t) >= 2)"
_WORDS = f"w as (select doc_id, unnest({_TOKENS}) token from documents)"
_DRAW = f"""{_WORDS}, d as (select distinct token from w), m as (select token, dim, case r when 0 then -1 else 1 end s from
 (select token, dim, ('0x' || substr(sha256('42:' || token || ':' || dim // 16), 1 + 4 * (dim % 16), 4))::bigint % 6 r from d, range({DIMS}) t(dim)) where r < 2),
 n as (select doc_id, dim, sum(s) n from w join m using (token) group by all having sum(s) <> 0),
 c as (select doc_id, dim, n / sqrt(sum(n * n) over (partition by doc_id)) x from n)"""


def _pair_query(of: Callable[..., Column]) -> Query:
    return lambda spark, sf_dir: _pairs(spark, sf_dir).select("vec_id", _r6(of("a", "b")).alias("value"))


def _pair_vector(of: Callable[..., Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _pairs(spark, sf_dir)
        return _flat(rows, of("a", "b"))

    return run


def _own_vector(of: Callable[..., Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(_embeddings(spark, sf_dir), of("a"))

    return run


def _knn(metric: Metric, k: int = K) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _store(spark, sf_dir, metric).search(_query(spark, sf_dir), k).select("rank", "id", _r6(F.col("distance")).alias("distance"))

    order = "asc" if metric.ascending else "desc"
    sql = f"""with {_E}, q as (select a b from e where vec_id = {QUERY_ID}), s as (select vec_id, {_DIST[metric].format(a="a", b="b")} d from e, q),
 r as (select vec_id, d, row_number() over (order by d {order}, vec_id) n from s)
select cast(n as integer) as rank, vec_id::varchar as id, round(d, 6) + 0.0 as distance from r where n <= {k}"""
    return run, sql


def _knn_batch(metric: Metric) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _store(spark, sf_dir, metric)
        queries = store.rows.select(F.col("seq").alias("query_id"), F.col("vector").alias("query"))
        return knn.search_each(queries, store.rows, K, metric).select("query_id", "rank", "seq", _r6(F.col("distance")).alias("distance"))

    order = "asc" if metric.ascending else "desc"
    sql = f"""with {_E}, s as (select q.vec_id query_id, e.vec_id seq, {_DIST[metric].format(a="e.a", b="q.a")} d from e, e q),
 r as (select *, row_number() over (partition by query_id order by d {order}, seq) n from s)
select query_id, cast(n as integer) as rank, seq, round(d, 6) + 0.0 as distance from r where n <= {K}"""
    return run, sql


def _dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in range(5)])))
    return rows.select("vec_id", "metric", _r6(V.distance("a", "b", F.col("metric"))).alias("value"))


def _mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("b", F.slice("b", 1, 10))
    return rows.select("vec_id", *[_r6(f("a", "b")).alias(n) for n, f in (("dot", V.dot), ("cosine", V.cosine), ("euclidean", V.euclidean), ("manhattan", V.manhattan))], V.equal("a", "b").alias("equal"), V.add("a", "b").isNull().alias("no_sum"))


def _zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.transform("a", lambda x: x * 0.0)
    rows = _embeddings(spark, sf_dir).withColumn("z", zero)
    return rows.select("vec_id", _r6(V.cosine("a", "z")).alias("cosine"), _r6(V.cosine_distance("a", "z")).alias("cosine_distance"), _r6(V.dot("a", "z")).alias("dot"), V.normalize("z").isNull().alias("no_unit"))


#: SQL functions over a pair of vectors, by name of the result; DuckDB's words for them.
_IN_SQL = {
    "dot": ("vec_dot(a, b)", _DIST[Metric.DOT_PRODUCT]),
    "cosine": ("vec_cosine(a, b)", "list_cosine_similarity({a}, {b})"),
    "cosine_distance": ("vec_cosine_distance(a, b)", _DIST[Metric.COSINE]),
    "euclidean": ("vec_euclidean(a, b)", _DIST[Metric.EUCLIDEAN]),
    "manhattan": ("vec_manhattan(a, b)", _DIST[Metric.MANHATTAN]),
    "distance": ("vec_distance(a, b, 2)", _DIST[Metric.MANHATTAN]),
    "norm": ("vec_norm(a)", "sqrt(list_dot_product({a}, {a}))"),
    "unit_dot": ("vec_dot(vec_normalize(a), b)", "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}))"),
    "sum_norm": ("vec_norm(vec_add(a, b))", "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] + z[2]) * (z[1] + z[2]))))"),
    "gap_norm": ("vec_norm(vec_sub(a, b))", _DIST[Metric.EUCLIDEAN]),
    "scaled_dot": ("vec_dot(vec_scale(a, 2.5D), b)", "2.5 * list_dot_product({a}, {b})"),
}


def _sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    V.register(spark)
    _pairs(spark, sf_dir).createOrReplaceTempView("vexel_pairs")
    numbers = ", ".join(f"round({call}, 6) + 0D {name}" for name, (call, _) in _IN_SQL.items())
    return spark.sql(f"select vec_id, cast(vec_dims(a) as bigint) dims, vec_equal(a, b) equal, vec_equal_eps(a, b, 0.6D) equal_eps, cast(size(text_tokens(concat('Vector ', vec_id, ' x é'))) as bigint) words, {numbers} from vexel_pairs")


def _sql_functions_sql() -> str:
    near = "len(list_filter(list_zip(a, b), lambda z: abs(z[1] - z[2]) > {})) = 0"
    numbers = ", ".join(f"round({sql.format(a='a', b='b')}, 6) + 0.0 as {name}" for name, (_, sql) in _IN_SQL.items())
    return f"""{_P} select vec_id, len(a) dims, {near.format("1e-6")} "equal", {near.format("0.6")} equal_eps, case when vec_id < 10 then 2 else 3 end::bigint words, {numbers} from p"""


def _store_rows(store: VectorStore) -> DataFrame:
    return store.rows.select("seq", "id", _r6(V.norm("vector")).alias("norm"))


def _store_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    return _store_rows(store.add(store.rows))


def _store_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store_rows(_store(spark, sf_dir).remove("7")[0])


def _store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store_rows(VectorStore(spark, rows=_store(spark, sf_dir).get("7")))


def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "store")
    _store(spark, sf_dir, Metric.MANHATTAN).save(path)
    store = VectorStore.load(spark, path)
    return _store_rows(store).withColumn("metric", F.lit(int(store.metric)))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "store") + ".json"
    _store(spark, sf_dir, Metric.DOT_PRODUCT).save_json(path)
    store = VectorStore.load_json(spark, path)
    return _store_rows(store).withColumn("metric", F.lit(int(store.metric)))


_ROWS = "select vec_id seq, vec_id::varchar id, round(sqrt(list_dot_product(a, a)), 6) + 0.0 as norm from e"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(V.tokenize("text")).alias("token"))


def _tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def _projection(spark: SparkSession, sf_dir: str) -> RandomProjection:
    return RandomProjection(DIMS).fit(table(spark, sf_dir, "documents"), order_col="doc_id")


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projection(spark, sf_dir).vocabulary.select("tok_idx", "token")


def _rp_embed(spark: SparkSession, sf_dir: str, projection: RandomProjection | None = None) -> DataFrame:
    cells = (projection or _projection(spark, sf_dir)).cells(table(spark, sf_dir, "documents"))
    return cells.select(F.col("id").alias("doc_id"), F.col("dim").cast("bigint").alias("dim"), _r6(F.col("value")).alias("value"))


def _rp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "projection")
    _projection(spark, sf_dir).save(path)
    return _rp_embed(spark, sf_dir, RandomProjection.load(spark, path))


def _rp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents nearest each benchmark item, by rounded cosine distance and then by id."""
    projection = _projection(spark, sf_dir)
    docs = projection.embed(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("seq"), F.col("embedding").alias("vector"))
    items = projection.embed(table(spark, sf_dir, "benchmark")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    # Some more than ten, as rounding makes ties that the distances themselves don't have.
    near = knn.search_each(items, docs, 5 * K, Metric.COSINE).select("query_id", "seq", _r6(F.col("distance")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "seq"))
    return near.withColumn("rank", rank).where(F.col("rank") <= K).select("query_id", "rank", "seq", "distance")


#: A vocabulary by letters: whatever the text, words come apart into known pieces or [UNK].
LETTERS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "of", "and", "##tion", "##er", *string.ascii_lowercase, *(f"##{c}" for c in string.ascii_lowercase), ".", ",", "#"]


def _wordpiece(max_len: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ids = WordPiece(LETTERS).encode_table(table(spark, sf_dir, "documents"), max_len=max_len)
        return ids.select("doc_id", F.posexplode("ids").alias("pos", "token_id"))

    return run


class Counting:
    """A stand-in for a model: a token's vector is its id modulo 7 and 5, and 1."""

    @staticmethod
    def get_inputs() -> list:
        return [SimpleNamespace(name=n) for n in ("input_ids", "attention_mask")]

    @staticmethod
    def get_outputs() -> list:
        return [SimpleNamespace(name="last_hidden_state")]

    @staticmethod
    def run(names: list[str], feed: dict[str, np.ndarray]) -> list[np.ndarray]:
        ids = feed["input_ids"]
        return [np.stack((ids % 7, ids % 5, np.ones_like(ids)), axis=2).astype(np.float64)]


def _onnx(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = OnnxEmbedder("counting", WordPiece(LETTERS), open=lambda name: Counting).probe()
    rows = model.embed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select("doc_id", F.col("dim").cast("bigint").alias("dim"), _r6(F.col("value").cast("double")).alias("value"))


def _wordpiece_sql(max_len: int) -> str:
    """f: doc_id and ids of each document, by the letters' vocabulary."""
    at = "cast(list_position([" + ", ".join(f"'{t}'" for t in LETTERS) + "], {}) - 1 as bigint)"
    blank = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    alone = r"([!-/:-@\[-`{-~\p{P}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])"
    bare = f"regexp_replace(regexp_replace(strip_accents(lower(translate(text, 'İΣ', 'iσ'))), '{blank}', ' ', 'g'), '[\\p{{Cc}}\\p{{Cf}}\\x{{FFFD}}]', '', 'g')"
    head = "regexp_extract(w, '^(the|of|and|[a-z])')"
    tail = f"regexp_extract_all(w[len({head}) + 1:], 'tion|er|[a-z]')"
    return f"""with l as (select doc_id, list_filter(string_split(regexp_replace({bare}, '{alone}', ' \\1 ', 'g'), ' '), lambda x: x <> '') ws from documents where text is not null),
 w as (select doc_id, unnest(ws) w, unnest(range(len(ws))) n from l),
 d as (select w, case when len(w) <= 100 and regexp_full_match(w, '[a-z]+') then list_concat([{at.format(head)}], list_transform({tail}, lambda p: {at.format("'##' || p")})) when w in ('.', ',', '#') then [{at.format("w")}] else [1::bigint] end p from (select distinct w from w)),
 g as (select doc_id, flatten(list(p order by n)) ids from w join d using (w) group by doc_id),
 f as (select l.doc_id, list_concat([2::bigint], coalesce(g.ids, []::bigint[])[1:{max_len - 2}], [3::bigint]) ids from l left join g using (doc_id))"""


def _measure(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    """A service that answers, out of order, with each text's length and a constant."""
    texts = json.loads(body)["input"]
    return 200, json.dumps({"data": [{"index": k, "embedding": [len(t), 1]} for k, t in reversed(list(enumerate(texts)))]}).encode()


def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = HTTPEmbedder("http://service.invalid/v1/", "length", dims=2, transport=_measure)
    rows = client.embed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select("doc_id", F.col("dim").cast("bigint").alias("dim"), F.col("value").cast("double").alias("value"))


def _entries() -> dict[str, tuple[Query, str | None]]:
    p = lambda of, sql: (_pair_query(of), f"{_P} select vec_id, round({sql}, 6) + 0.0 as value from p")
    near = "len(list_filter(list_zip(a, b), lambda z: abs(z[1] - z[2]) > {})) = 0"
    flag = lambda of, eps: (lambda spark, sf_dir: _pairs(spark, sf_dir).select("vec_id", of("a", "b").alias("value")), f"{_P} select vec_id, {near.format(eps)} as value from p")
    own = lambda of, sql: (_own_vector(of), f"with {_E}, v as (select vec_id, {sql} v from e) {_UNROLL}")
    two = lambda of, op: (_pair_vector(of), f"{_P}, v as (select vec_id, list_transform(list_zip(a, b), lambda z: z[1] {op} z[2]) v from p) {_UNROLL}")
    rp = f"with {_DRAW} select doc_id, cast(dim as bigint) dim, round(x, 6) + 0.0 as value from c"
    best = f"""with {_DRAW.replace("w as (select doc_id, unnest", "w as materialized (select doc_id, unnest")}, bw as (select item_id, unnest({_TOKENS}) token from benchmark),
 bn as (select item_id, dim, sum(s) n from bw join m using (token) group by all having sum(s) <> 0),
 s as (select item_id, doc_id, sum(bn.n * n.n) x from bn join n using (dim) group by all),
 bl as (select item_id, sum(n * n) q from bn group by item_id), dl as (select doc_id, sum(n * n) q from n group by doc_id),
 a as (select item_id, doc_id, round(1 - coalesce(s.x / sqrt(bl.q::double * dl.q), 0), 6) + 0.0 d from (select item_id from benchmark) cross join (select doc_id from documents) left join s using (item_id, doc_id) left join bl using (item_id) left join dl using (doc_id)),
 r as (select *, row_number() over (partition by item_id order by d, doc_id) n from a)
select item_id query_id, n::integer as rank, doc_id seq, d as distance from r where n <= {K}"""
    out: dict[str, tuple[Query, str | None]] = {
        "vec_dims": (lambda s, d: _embeddings(s, d).select("vec_id", V.dims("a").cast("bigint").alias("value")), f"with {_E} select vec_id, len(a) as value from e"),
        "vec_dot": p(V.dot, "list_dot_product(a, b)"),
        "vec_norm": (lambda s, d: _embeddings(s, d).select("vec_id", _r6(V.norm("a")).alias("value")), f"with {_E} select vec_id, round(sqrt(list_dot_product(a, a)), 6) + 0.0 as value from e"),
        "vec_normalize": own(V.normalize, "list_transform(a, lambda x: x / sqrt(list_dot_product(a, a)))"),
        "vec_add": two(V.add, "+"),
        "vec_sub": two(V.sub, "-"),
        "vec_scale": own(lambda a: V.scale(a, 2.5), "list_transform(a, lambda x: x * 2.5)"),
        "vec_equal": flag(V.equal, "1e-6"),
        "vec_equal_eps": flag(lambda a, b: V.equal_eps(a, b, 0.6), "0.6"),
        "vec_clone": own(V.clone, "a"),
        "cosine_sim": p(V.cosine, "list_cosine_similarity(a, b)"),
        "cosine_dist": p(V.cosine_distance, _DIST[Metric.COSINE].format(a="a", b="b")),
        "euclidean": p(V.euclidean, _DIST[Metric.EUCLIDEAN].format(a="a", b="b")),
        "manhattan": p(V.manhattan, _DIST[Metric.MANHATTAN].format(a="a", b="b")),
        "distance_dispatch": (_dispatch, _P + " select vec_id, m as metric, round(case m " + " ".join(f"when {int(m)} then {s.format(a='a', b='b')}" for m, s in _DIST.items()) + " else 0 end, 6) + 0.0 as value from p, (select unnest([0, 1, 2, 3, 4]) m)"),
        "mismatch_scores": (_mismatch, f'{_P} select vec_id, 0.0::double dot, 0.0::double cosine, 0.0::double euclidean, 0.0::double manhattan, false "equal", true no_sum from p'),
        "zero_vector_scores": (_zeros, f"with {_E} select vec_id, 0.0::double cosine, 1.0::double cosine_distance, 0.0::double dot, true no_unit from e"),
        "sql_functions": (_sql_functions, _sql_functions_sql()),
        "knn_cosine": _knn(Metric.COSINE),
        "knn_euclidean": _knn(Metric.EUCLIDEAN),
        "knn_manhattan": _knn(Metric.MANHATTAN),
        "knn_dot": _knn(Metric.DOT_PRODUCT),
        "knn_k_zero": _knn(Metric.COSINE, 0),
        "knn_k_exceeds": _knn(Metric.COSINE, 10**6),
        "knn_batch": _knn_batch(Metric.COSINE),
        "knn_batch_euclidean": _knn_batch(Metric.EUCLIDEAN),
        "knn_batch_manhattan": _knn_batch(Metric.MANHATTAN),
        "knn_batch_dot": _knn_batch(Metric.DOT_PRODUCT),
        "store_add": (_store_add, f"with {_E}, r as ({_ROWS}), t as (select (select max(seq) from r) + 1 + seq - (select min(seq) from r) seq, id, norm from r) select * from r union all select * from t"),
        "store_len": (lambda s, d: _store(s, d).rows.agg(F.count("*").alias("n")), "select count(*) n from embeddings"),
        "store_get": (_store_get, f"with {_E} {_ROWS} where vec_id = 7"),
        "store_remove": (_store_remove, f"with {_E}, r as ({_ROWS}) select case when seq = (select max(seq) from r) then 7 else seq end seq, id, norm from r where seq <> 7"),
        "store_parquet_roundtrip": (_parquet, f"with {_E} select *, 2 as metric from ({_ROWS})"),
        "store_json_roundtrip": (_json, f"with {_E} select *, 3 as metric from ({_ROWS})"),
        "tokenize": (_tokenize, f"with {_WORDS} select doc_id, token, count(*) n from w group by all"),
        "vocab": (_vocab, f"with l as (select doc_id, {_TOKENS} t from documents), w as (select doc_id, unnest(t) token, unnest(range(len(t))) pos from l), f as (select token, min((doc_id, pos)) p from w group by token) select row_number() over (order by p) - 1 tok_idx, token from f"),
        "vocab_size": (lambda s, d: _projection(s, d).vocabulary.agg(F.count("*").alias("n")), f"with {_WORDS} select count(distinct token) n from w"),
        "rp_embed": (_rp_embed, rp),
        "rp_roundtrip": (_rp_roundtrip, rp),
        "rp_search": (_rp_search, best),
        "wordpiece_encode": (_wordpiece(256), f"{_wordpiece_sql(256)} select doc_id, unnest(range(len(ids)))::integer as pos, unnest(ids) as token_id from f"),
        "wordpiece_truncate": (_wordpiece(5), f"{_wordpiece_sql(5)} select doc_id, unnest(range(len(ids)))::integer as pos, unnest(ids) as token_id from f"),
        "onnx_embed": (_onnx, f"""{_wordpiece_sql(256)}, m as (select doc_id, list_avg(list_transform(ids, lambda i: i % 7)) x, list_avg(list_transform(ids, lambda i: i % 5)) y from f)
 select doc_id, unnest([0, 1, 2])::bigint dim, round((unnest([x, y, 1]) / sqrt(x * x + y * y + 1))::float::double, 6) + 0.0 as value from m"""),
        "http_embed": (_http, "select doc_id, unnest([0, 1])::bigint dim, unnest([length(text), 1])::double as value from documents"),
    }
    return out


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
