import random

import numpy as np
import pyarrow as pa

from vexel.llm import substring_dedup as sd
from vexel.llm.blocks import blocks, mix


def brute(rows, length):
    """Every later window of equal words, as stretches (doc, start, end)."""
    first, hit = {}, {}
    for doc, text in sorted({(d, t or "") for d, t in rows if d is not None}):
        words = text.split()
        for at in range(len(words) - length + 1):
            key = tuple(words[at : at + length])
            if first.setdefault(key, (doc, at)) != (doc, at):
                hit.setdefault(doc, []).append(at)
    out = set()
    for doc, starts in hit.items():
        begin, end = starts[0], starts[0] + length
        for at in starts[1:]:
            if at > end:
                out.add((doc, begin, end))
                begin = at
            end = at + length
        out.add((doc, begin, end))
    return out


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["the", "of", "é"] * 60
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([20, 49, 50, 51, 80, 200]))] for _ in range(12)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
            words += rng.choice(passages)
        rows.append((i, " ".join(words)))
    rows += [(docs, rows[3][1]), (docs + 1, rows[3][1]), (docs + 2, "a " * 130), (docs + 3, "x " + "a " * 90 + "y"), (docs + 4, "b c " * 70), (docs + 5, None), (docs + 6, ""), (None, rows[3][1]), rows[5]]
    rng.shuffle(rows)
    return rows


def test_spans_equal_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        got = {(r.doc_id, r.start, r.end) for r in sd.spans(df).collect()}
        assert got == brute(rows, 50)


def test_names_are_the_same_in_every_block(spark):
    words = ["w%d" % i for i in range(90)]
    texts = [" ".join(words), "one " * 7 + " ".join(words) + " tail" * 30]
    names = []
    for text, at in zip(texts, (0, 7)):
        w = sd.words(next(blocks(pa.array([text]))))
        names.append([x.tolist() for x in sd._names(w, at + np.arange(41), at + np.arange(41) + 50)])
    assert names[0] == names[1]
    # Adaptive execution would bring such a small table into one block.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for seed in (11, 12):
            rows = corpus(seed)
            df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
            found = sd.spans(df)
            assert {(r.doc_id, r.start, r.end) for r in found.collect()} == brute(rows, 50)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_first_places_hold_the_same_words(spark):
    rows = corpus(7)
    text = {d: (t or "").split() for d, t in rows if d is not None}
    for r in sd.spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert text[r.doc_id][r.start : r.start + 50] == text[r.first_doc_id][r.first_start : r.first_start + 50]
        assert (r.first_doc_id, r.first_start) < (r.doc_id, r.start)


def test_equal_passages_share_symbols():
    rng = np.random.default_rng(3)
    for _ in range(200):
        passage = rng.integers(0, 300, 50).astype(np.uint64)
        names = []
        for _ in range(2):
            token = mix(np.concatenate((rng.integers(0, 300, 40).astype(np.uint64), passage, rng.integers(0, 300, 40).astype(np.uint64))))
            name, start, size, _ = sd.symbols(token, np.zeros(len(token), np.int64))
            inside = (start >= 40) & (start + size <= 90) & (size >= sd.GRAIN)
            names.append(set(name[inside].tolist()))
        assert names[0] & names[1]


def test_remove_cuts_words_and_keeps_columns(spark):
    rows = [(1, "p " + " ".join(f"w{i}" for i in range(60)) + "\ntail é", 7), (2, "head\n" + " ".join(f"w{i}" for i in range(60)) + " end", 8), (3, None, 9), (None, "x", 1), (4, " ".join(f"w{i}" for i in range(60)), 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int").withColumnRenamed("start", "end")
    out = sd.remove(df, sd.spans(df))
    assert out.schema == df.schema
    got = {r.doc_id: (r.text, r.end) for r in out.collect()}
    assert got == {1: (rows[0][1], 7), 2: ("head\nend", 8), 3: (None, 9), None: ("x", 1)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sd.spans(df).count() == 0
    assert sd.remove(df, sd.spans(df)).count() == 0


def test_cut_of_all_and_nothing():
    block = next(blocks(pa.array(["a b c", "", " x  y "])))
    assert sd.cut(block, np.array([0, 2]), np.array([0, 0]), np.array([9, 1])) == [b"", b"", b" y "]


def test_rows_that_share_an_id_lose_their_own_words_only(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"q{i}" for i in range(100))
    rows = [(1, passage), (2, "two " + passage), (2, other), (2, other), (3, "x " + other)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as __of", "2 as of", "3 as spans", "4 as text_key").repartition(3)
    out = sd.remove(df, sd.spans(df))
    assert out.schema == df.schema
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, passage), (2, other), (2, other), (2, "two "), (3, "x ")]


def test_passages_meet_across_blocks_and_tasks(spark):
    """Blocks of a few documents each, tasks of a few blocks, and texts longer than a block."""
    rows = corpus(21) + [(200, " ".join(f"z{i % 700}" for i in range(3000))), (201, "head " + " ".join(f"z{i % 700}" for i in range(900)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r.doc_id, r.start, r.end) for r in sd.spans(df).collect()} == brute(rows, 50)
        column = pa.array([t for _, t in rows], pa.string())
        names = [np.concatenate([sd.row_names(sd.words(b)) for b in blocks(column, size)]) for size in (1 << 21, 4000)]
        assert (names[0] == names[1]).all()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
