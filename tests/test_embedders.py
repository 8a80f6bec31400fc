import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from vexel.operators import Embedder, EmbeddingError, HTTPEmbedder, OnnxEmbedder, RandomProjection, WordPiece
from vexel.operators.onnx_embedder import pick_output, pool, run_batch

CORPUS = ["The cat sat on the mat", "a dog sat by the cat", "é x1 unrelated words here", "", None]
VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "the", "ca", "##t", "run", "##ning", "##s", ".", "é", "e", "日", "cat"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(CORPUS)), "n bigint, text string").repartition(2)


def test_projection(spark, corpus, tmp_path):
    model = RandomProjection(32).fit(corpus, order_col="n")
    assert isinstance(model, Embedder) and model.dims == 32
    words = [r.token for r in model.vocabulary.orderBy("tok_idx").collect()]
    assert words == ["the", "cat", "sat", "on", "mat", "dog", "by", "é", "x1", "unrelated", "words", "here"]
    assert model.vocab_size() == 12
    rows = {r.text: r.embedding for r in model.embed(corpus).collect()}
    for text in CORPUS[:3]:
        assert len(rows[text]) == 32 and math.dist(rows[text], [0] * 32) == pytest.approx(1)
    assert rows[""] == rows[None] == [0] * 32
    assert model.embed(spark.createDataFrame([("zzz qqq",)], "text string")).first().embedding == [0] * 32
    model.save(f"{tmp_path}/m")
    again = RandomProjection.load(spark, f"{tmp_path}/m")
    assert again.dims == 32 and {r.text: r.embedding for r in again.embed(corpus).collect()} == rows
    cells = [e.val for r in model.vocabulary.collect() for e in r.entries]
    assert {round(abs(v), 5) for v in cells} == {round(math.sqrt(3 / 32), 5)} and 0.2 < len(cells) / (12 * 32) < 0.45
    assert model.fit(corpus.limit(0), order_col="n").vocab_size() == 0
    unordered = RandomProjection(32).fit(corpus)
    assert {r.text: r.embedding for r in unordered.embed(corpus).collect()} == rows
    with pytest.raises(ValueError):
        RandomProjection(0)
    with pytest.raises(ValueError):
        RandomProjection(3).embed(corpus)


@pytest.mark.parametrize(
    "text, ids",
    [("the cat", [4, 14]), ("The CAT.", [4, 14, 10]), ("running", [7, 8]), ("cats", [14, 9]), ("catx", [1]), ("", []), (" \t\n", []), ("É", [12]), ("日日", [13, 13]), ("the­cat the‍re", [1, 1]), ("c­at", [14]), ("x" * 101, [1]), ("the\x1cthe", [1])],
)
def test_wordpiece(text, ids):
    assert WordPiece(VOCAB).encode(text) == [2, *ids, 3]


def test_wordpiece_limits_and_case():
    w = WordPiece(VOCAB)
    assert w.encode("the cats run", 5) == [2, 4, 14, 9, 3] and w.encode("running run", 3) == [2, 7, 3]
    assert WordPiece(VOCAB, lower=False).encode("The é") == [2, 1, 11, 3]
    assert WordPiece(["[PAD]", "[PAD]", "[UNK]", "[CLS]", "[SEP]"]).ids == {"[PAD]": 0, "[UNK]": 2, "[CLS]": 3, "[SEP]": 4}
    with pytest.raises(ValueError, match=r"\[SEP\]"):
        WordPiece(["[PAD]", "[UNK]", "[CLS]"])


def test_wordpiece_against_the_public_tokenizer(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    (tmp_path / "v.txt").write_text("\n".join(VOCAB) + "\n")
    public = tokenizers.BertWordPieceTokenizer(str(tmp_path / "v.txt"), lowercase=True)
    rng = random.Random(1)
    texts = ["".join(rng.choice("the cat running.s é日,!​­") for _ in range(rng.randrange(40))) for _ in range(300)]
    mine = WordPiece.read(spark, str(tmp_path / "v.txt"))
    df = mine.encode_table(spark.createDataFrame([*enumerate(texts), (300, None)], "i int, text string"), max_len=10**6)
    got = {r.i: r.ids for r in df.collect()}
    assert got.pop(300) is None
    assert [got[i] for i in range(300)] == [public.encode(t).ids for t in texts]


class Service(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((self.path, body, dict(self.headers)))
        data = [{"index": k, "embedding": [3.0, 4.0, float(len(t))][: 2 if body["model"] == "two" else 3]} for k, t in reversed(list(enumerate(body["input"])))]
        reply = json.dumps({"data": data}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(reply)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/"
    server.shutdown()


def test_http_over_a_real_socket(spark, corpus, url):
    client = HTTPEmbedder(url, "two", batch=2).with_api_key("k").with_header("X-Own", "y").with_normalize().probe()
    assert client.dims == 2 and isinstance(client, Embedder) and "k" not in repr(client).replace("http_", "").split("HTTPEmbedder")[1].split("model")[1]
    got = {r.text: r.embedding for r in client.embed(corpus).collect()}
    assert all(got[t] == pytest.approx([0.6, 0.8]) for t in CORPUS if t is not None) and got[None] is None
    path, body, headers = Service.seen[0]
    assert path == "/v1/embeddings" and body == {"model": "two", "input": ["dimension"]}
    assert headers["Authorization"] == "Bearer k" and headers["X-Own"] == "y" and headers["Content-Type"] == "application/json"
    assert HTTPEmbedder(url, "three").embed_batch(["a", "bbb"]) == [[3, 4, 1], [3, 4, 3]]
    asked = len(Service.seen)
    assert HTTPEmbedder(url, "three").embed_batch([]) == [] and len(Service.seen) == asked
    with pytest.raises(EmbeddingError, match="no answer"):
        HTTPEmbedder("http://127.0.0.1:9", "m", timeout=1).embed_text("x")


def item(*pairs):
    return json.dumps({"data": [{"index": i, "embedding": e} for i, e in pairs]})


@pytest.mark.parametrize(
    "status, body, message",
    [
        (200, item((0, [1]), (0, [2])), "indices"), (200, item((0, [1]), (2, [2])), "indices"), (200, item((-1, [1]), (0, [2])), "indices"),
        (200, item((0, [1])), "1 embeddings for 2"), (200, item((0, []), (1, [])), "empty"), (200, item((0, [1]), (1, [1, 2])), "different lengths"),
        (401, '{"error": {"message": "bad key"}}', "bad key"), (200, '{"error": {"message": "quota"}}', "quota"), (502, "<html>", "status 502"),
        (200, "{", "can't be read"), (201, item((0, [1]), (1, [2])), "status 201"), (200, item((0, [1]), (1, [2])), "not 3"),
    ],
)
def test_http_answers_that_are_refused(status, body, message):
    client = HTTPEmbedder("http://x", "m", dims=3 if message == "not 3" else 0).with_transport(lambda *_: (status, body.encode()))
    with pytest.raises(EmbeddingError, match=message):
        client.embed_batch(["a", "b"])


def test_http_settings():
    client = HTTPEmbedder("http://x//", "m", dims=-4)
    assert client.base_url == "http://x" and client.dims == 0 and client.with_transport(None) is client
    zero = client.with_normalize().with_transport(lambda *_: (200, item((0, [0, 0])).encode()))
    assert zero.embed_text("a") == [0, 0]


class FakeModel:
    """Hidden states: each id, and its square, at each position."""

    class Named:
        def __init__(self, name):
            self.name = name

    def __init__(self, inputs=("input_ids", "attention_mask", "token_type_ids"), outputs=("pooler", "last_hidden_state")):
        self.inputs, self.outputs = inputs, outputs

    def get_inputs(self):
        return [self.Named(n) for n in self.inputs]

    def get_outputs(self):
        return [self.Named(n) for n in self.outputs]

    def run(self, names, feed):
        assert names == ["last_hidden_state"] and set(feed) == set(self.inputs)
        ids = feed["input_ids"].astype(np.float32)
        return [np.stack((ids, ids * ids), axis=2)]


def test_onnx_pooling_and_batches(spark, corpus):
    model = OnnxEmbedder("none", WordPiece(VOCAB), open=lambda _: FakeModel(), batch=2)
    a, b = model.embed_batch(["the", "the cat running"])
    mean = np.array([(2 + 4 + 3) / 3, (4 + 16 + 9) / 3])
    assert a == pytest.approx(mean / np.linalg.norm(mean)) and np.linalg.norm(b) == pytest.approx(1)
    assert model.embed_batch([]) == [] and model.probe().dims == 2
    assert model.with_max_length(2).max_length == 256 and model.with_max_length(3).max_length == 3
    got = {r.text: r.embedding for r in model.embed(corpus).collect()}
    assert got[None] is None and got[CORPUS[0]] == pytest.approx(model.embed_batch([CORPUS[0]])[0], abs=1e-6)


def test_onnx_guards():
    with pytest.raises(ValueError, match="asks for"):
        run_batch(FakeModel(inputs=("input_ids", "attention_mask", "position_ids")), WordPiece(VOCAB), ["a"], 9)
    assert pick_output(["x", "last_hidden_state", "sentence_embedding"]) == "sentence_embedding" and pick_output(["x", "y"]) == "x"
    mask = np.array([[1, 0], [1, 1]])
    assert pool(np.array([[3.0, 4.0], [0.0, 0.0]]), mask).tolist() == [[0.6, 0.8], [0, 0]]
    for shape in ((2,), (3, 2), (2, 5, 3), (2, 2, 2, 2)):
        with pytest.raises(ValueError, match="shape"):
            pool(np.ones(shape), mask)


def test_projection_by_join_equals_that_by_copy(spark, monkeypatch):
    from vexel.operators import random_projection as rp

    texts = [(1, "red green blue red"), (2, None), (3, ""), (4, "unseen words only"), (5, "blue " * 500), (5, "red green blue red"), (None, "green é日本 red")]
    df = spark.createDataFrame(texts, "n BIGINT, text STRING").selectExpr("n", "text", "1 as tokens", "2 as ROW", "3 as words", "4 as token").repartition(3)
    model = RandomProjection(40).fit(spark.createDataFrame([(1, "red green"), (2, "blue é日本 red")], "n BIGINT, text STRING"), order_col="n")
    assert [r.token for r in model.vocabulary.orderBy("tok_idx").collect()] == ["red", "green", "blue", "é日本"]
    monkeypatch.setattr(rp, "CELLS", 90)
    copied = model.embed(df)
    assert copied.columns == [*df.columns, "embedding"]
    monkeypatch.setattr(rp, "COPIED", 0)
    assert sorted(map(str, copied.collect())) == sorted(map(str, model.embed(df).collect()))
    by = {(r.n, r.text): r.embedding for r in copied.collect()}
    assert not any(by[2, None]) and not any(by[3, ""]) and not any(by[4, "unseen words only"])
    one = rp.signs(["red", "green", "blue"], 40, 42).astype(int)
    total = 2 * one[0] + one[1] + one[2]
    assert by[1, "red green blue red"] == pytest.approx((total / (total @ total) ** 0.5).tolist())
    cells = {(r.tok_idx, e.dim): e.val for r in model.vocabulary.collect() for e in r.entries}
    assert {k for k in cells if k[0] == 0} == {(0, d) for d in one[0].nonzero()[0]} and all(abs(v) == pytest.approx(model.scale) for v in cells.values())


def test_signs_are_drawn_in_their_shares():
    from vexel.operators import random_projection as rp

    drawn = rp.signs([f"w{i}" for i in range(400)], 100, 7)
    assert abs((drawn == 1).mean() - 1 / 6) < 0.01 and abs((drawn == -1).mean() - 1 / 6) < 0.01


def test_lengths_are_locked_before_tasks_ask(spark):
    """A service that answers with other lengths later fails instead of mixing them."""

    def growing(url, body, headers, timeout):
        n = len(json.loads(body)["input"])
        size = 2 if json.loads(body)["input"] == ["dimension"] else 3
        return 200, json.dumps({"data": [{"index": k, "embedding": [1.0] * size} for k in range(n)]}).encode()

    client = HTTPEmbedder("http://x.invalid", "m", transport=growing)
    with pytest.raises(Exception, match="3 dimensions, not 2"):
        client.embed(spark.createDataFrame([("a",)], "text STRING")).collect()


def test_tour_of_a_local_model(spark, capsys):
    from vexel.__main__ import show_alike
    from vexel.operators import OnnxEmbedder
    from vexel.plans.catalogue import LETTERS, Counting

    show_alike(spark, OnnxEmbedder("counting", WordPiece(LETTERS), open=lambda name: Counting))
    out = capsys.readouterr().out
    assert "3 dimensions" in out and out.count("|") > 40


def test_large_vocabulary_needs_no_join_of_words(spark, monkeypatch, capsys):
    """Workers are told the texts' unknown words; a text's own words aren't shuffled, and vectors are those of the copy and the join."""
    from vexel.operators import random_projection as rp

    df = spark.createDataFrame([(1, "red green blue red"), (2, None), (3, ""), (4, "unseen red words only"), (5, "blue " * 500)], "n BIGINT, text STRING").repartition(3)
    model = RandomProjection(40).fit(df.where("n <> 4"), order_col="n")
    assert [r.token for r in model.vocabulary.orderBy("tok_idx").collect()] == ["red", "green", "blue"]
    rows = lambda: sorted(map(str, model.embed(df).collect()))
    copied = rows()
    monkeypatch.setattr(rp, "SMALL", 0)
    assert rows() == copied
    capsys.readouterr()
    model.embed(df.coalesce(1)).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "hashpartitioning" not in plan
    monkeypatch.setattr(rp, "COPIED", 0)
    assert rows() == copied


@pytest.mark.parametrize("big", [0, 1 << 40])
def test_words_are_numbered_by_hash_aggregates_where_order_fits_a_number(spark, big):
    texts = [(3 + big, "c a b"), (-2, "z a"), (3 + big, "q c"), (1, "b b y")]
    df = spark.createDataFrame(texts, "n BIGINT, text STRING").selectExpr("n", "concat(replace(text, ' ', 'x '), 'x') text").repartition(3)
    place = RandomProjection._place(df, "n")
    assert ("struct" in str(place)) is bool(big)
    words = [r.token for r in RandomProjection(4).fit(df, order_col="n").vocabulary.orderBy("tok_idx").collect()]
    assert words[:4] == ["zx", "ax", "bx", "yx"] and set(words[4:]) == {"cx", "qx"} and len(words) == 6


def test_wordpiece_holds_little_of_a_batch():
    """Long texts are split piece by piece, only as far as ids are asked for; words remembered are few and short; ids stay the same."""
    import tracemalloc

    import pyarrow as pa

    from vexel.operators import wordpiece

    class Seen(WordPiece):
        longest = 0

        def split(self, text):
            Seen.longest = max(Seen.longest, len(text))
            return super().split(text)

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("thecatrun.s É日İΣ́") for _ in range(rng.randrange(1, 60))) for _ in range(rng.choice([0, 3, 900]))) for _ in range(60)]
    w = Seen(VOCAB)
    for max_len in (5, 256, 10**6):
        got = w.encode_array(pa.array([*texts, None]), max_len).to_pylist()
        for text, ids in zip(texts, got):
            whole = [i for word in WordPiece(VOCAB).split(text) if word for i in w.pieces(word)]
            assert ids == [2, *whole[: max_len - 2], 3]
        assert got[-1] is None and len(got) == 61
    assert Seen.longest < 2 * wordpiece.PIECE
    assert len(w._known) <= wordpiece.REMEMBERED and max(map(len, w._known)) <= wordpiece.SHORT
    batch = pa.array(["the cat " * 10_000] * 400)  # 32 MB
    tracemalloc.start()
    w.encode_array(batch, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
