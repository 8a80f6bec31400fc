import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from vexel.llm import near_dedup as nd
from vexel.llm.blocks import blocks
from vexel.llm.tables import components


def brute(rows, threshold=nd.THRESHOLD):
    """Components of all pairs whose signatures agree in enough slots."""
    rows = sorted({(d, t or "") for d, t in rows if d is not None and (t or "").strip()})
    block = next(blocks(pa.array([t for _, t in rows]), 1 << 30))
    element, row = nd.shingles(block)
    sig = nd.signatures(element, row, len(rows))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        agree = (sig[i + 1 :] == sig[i]).sum(axis=1) >= threshold * nd.SLOTS
        for j in np.flatnonzero(agree):
            a, b = find(rows[i][0]), find(rows[i + 1 + j][0])
            root[max(a, b)] = min(a, b)
    return {(d, find(d)) for d in root if sum(find(x) == find(d) for x in root) > 1}


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 40, 300]))]
        for _ in range(rng.randrange(1, 5)):
            rows.append((n, " ".join(w if rng.random() > 0.03 else rng.choice(words) for w in base)))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1].upper()), (n + 2, ""), (n + 3, None), (n + 4, " \n"), (None, rows[0][1]), rows[2], (n + 5, "long " * 3000)]
    return rows


@pytest.mark.parametrize("part", [nd.PART, 3])
def test_groups_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(nd, "PART", part)
    for seed in range(2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        got = nd.group(df).collect()
        assert {(r.doc_id, r.group_id) for r in got} == brute(rows)
        assert all(r.keep == (r.doc_id == r.group_id) for r in got)


def test_pairs_are_verified_by_their_elements(spark):
    # Lone pairs of Jaccard index 40/76 and 37/79, on which signatures often err.
    rows, want = [], set()
    for i in range(160):
        same = 42 if i % 2 else 39
        head = [f"p{i}w{k}" for k in range(60)]
        rows += [(2 * i, " ".join(head)), (2 * i + 1, " ".join(head[:same] + [f"q{i}w{k}" for k in range(60 - same)]))]
        want |= {2 * i} if same == 42 else {2 * i, 2 * i + 1}
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "").collect()
    assert {r.doc_id for r in kept} == want


def test_estimates_are_close_and_less_varied():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
        sig = nd.signatures(np.concatenate((base[:30], base[10:])), np.repeat([0, 1], 30), 2)
        errors.append((sig[0] == sig[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < (0.25 / nd.SLOTS) ** 0.5


def test_signature_ignores_order_and_repeats():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 50, dtype=np.uint64)
    again = np.concatenate((base[::-1], base[:20]))
    sig = nd.signatures(np.concatenate((base, again)), np.repeat([0, 1], [50, 70]), 2)
    assert (sig[0] == sig[1]).all()
    assert (sig[0] != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_forest_connects_like_all_pairs():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 3, (60, 16)).astype(np.uint16)
    for need in (6, 8, 10):
        label = list(range(60))
        for i in range(60):
            for j in range(i):
                if (sig[i] == sig[j]).sum() >= need and label[i] != label[j]:
                    a, b = label[i], label[j]
                    label = [a if x == b else x for x in label]
        mine = list(range(60))
        for a, b in nd.forest(sig, need):
            x, y = mine[a], mine[b]
            mine = [x if z == y else z for z in mine]
        assert len({*zip(label, mine)}) == len({*label}) == len({*mine})


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 45), (45, 50), (60, 60), (70, 71), (70, 71), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 45: 40, 50: 40, 70: 70, 71: 70}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keep_one_keeps_columns_and_empties(spark):
    rows = [(1, "a b c d e", "x"), (2, "a b c d e", "y"), (3, "", "z"), (4, None, "z"), (None, "a b c d e", "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rep string")
    out = nd.keep_one(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted((r for r in df.collect() if r.doc_id != 2), key=str)
    assert nd.keep_one(df.limit(0)).count() == 0


def jaccard_groups(rows, threshold=nd.THRESHOLD):
    """Components of all pairs whose own elements reach the threshold."""
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[d] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return {(d, r) for d, r in root.items() if sum(x == r for x in root.values()) > 1}


@pytest.mark.parametrize("part", [nd.PART, 8])
def test_hot_buckets_lose_no_link(spark, monkeypatch, part):
    """Chains of near copies, with neighbours alike and ends unlike, and unlike texts around one passage, all in hot buckets."""
    monkeypatch.setattr(nd, "PART", part)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows, text = [], [rng.choice(words) for _ in range(120)]
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[rng.randrange(120)] = f"n{i}"
        text[rng.randrange(120)] = f"m{i}"
    notice = " ".join(rng.choice(words) for _ in range(60))
    rows += [(100 + i, notice + " " + " ".join(f"u{i}x{k}" for k in range(90))) for i in range(60)]
    rows += [(200 + i, rows[60 + i][1] + " end") for i in range(0, 60, 7)]
    rng.shuffle(rows)
    got = nd.group(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), exact=True).collect()
    assert {(r.doc_id, r.group_id) for r in got} == jaccard_groups(rows)
    sizes = [sum(o.class_id == r.class_id for o in got) for r in got]
    assert all(r.n_links > 0 or n > 1 for r, n in zip(got, sizes))
    assert all(o.group_id == r.group_id for r in got for o in got if o.class_id == r.class_id)


def test_parts_cover_a_bucket(monkeypatch):
    rng = np.random.default_rng(5)
    keys = np.sort(rng.choice([1, 2, 3, 4, 5, 6], 200, p=[0.5, 0.3, 0.1, 0.05, 0.045, 0.005]))
    reps = np.arange(200)
    for step in (1, 7, 64, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + step]), pa.array(reps[a : a + step])], ["key", "rep"]) for a in range(0, 200, step)]
        seen = {}
        for out in nd._buckets(10)(batches):
            for key, part, hot, members in zip(*(c.to_pylist() for c in out.columns)):
                assert 0 < len(members) <= 10 and hot == ((keys == key).sum() > 10)
                seen.setdefault(key, []).append((part, members))
        assert {k: [x for _, m in v for x in m] for k, v in seen.items()} == {k: reps[keys == k].tolist() for k in np.unique(keys).tolist() if (keys == k).sum() > 1}
        assert all([p for p, _ in v] == list(range(len(v))) for v in seen.values())


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(6)
    for text in ("a b", "x" * 5000, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 900) for _ in range(300)), " \n" * 3000 + "end", "one two  three" + " " * 4000, " ".join(f"v{i}" for i in range(3000)) + "\t"):
        (block,) = blocks(pa.array([text]))
        for n in (1, 3):
            whole = set(nd.shingles(block, n)[0].tolist())
            parts = [set(p.tolist()) for p in nd.pieces(block, n, 700)]
            assert set().union(*parts) == whole
    element, row = nd.shingles(block)
    monkeypatch.setattr(nd, "DRAWN", 100)
    small = nd.signatures(element, row, 1)
    monkeypatch.undo()
    assert (small == nd.signatures(element, row, 1)).all()


def test_a_long_text_takes_little_memory():
    import tracemalloc

    text = " ".join(f"word{i % 50021}" for i in range(2_500_000))
    (block,) = blocks(pa.array([text]))
    tracemalloc.start()
    sig = np.full((1, nd.SLOTS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for element in nd.pieces(block, 3, nd.PIECE):
        nd._draw(sig, element[: nd.DRAWN], np.zeros(len(element[: nd.DRAWN]), np.int64))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_shared_ids_and_clashing_names(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "q r s t u v"), (3, "q r s t u v"), (4, "q r s t u v w"), (5, "only one here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as rep", "2 as gone", "3 as root", "4 as group_id")
    assert {(r.doc_id, r.group_id) for r in nd.group(df, exact=True).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    out = nd.keep_one(df, exact=True)
    assert out.schema == df.schema and sorted(r.doc_id for r in out.collect()) == [1, 5]
    assert nd.group(df.limit(0), exact=True).count() == 0
