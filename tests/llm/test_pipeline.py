import random

import corpus_pipeline as cp
import pytest

from vexel.llm import secret_scan
from vexel.llm import queries as llm

SECRET = "AKIA" + "Z" * 16


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows = [(i, text(rng.randrange(80, 300))) for i in range(30)]
    rows += [(100, rows[0][1]), (101, rows[1][1] + " more"), (102, text(60) + " " + passage), (103, text(60) + " " + passage + " end"), (104, f"{text(50)} {SECRET} {text(5)}"), (105, "spam spam spam " * 40), (106, ""), (107, None), (None, text(90))]
    return spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint"), dict(rows), passage


def test_stages_one_by_one(spark, corpus):
    docs, texts, passage = corpus
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "secret_scan", "packing"]
    steps = [docs]
    for name, stage in cp.STAGES:
        steps.append(cp.kept(stage(spark, steps[-1], ""), name))
    assert all(s.columns == docs.columns for s in steps[1:-1])
    kept = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert set(texts) - set(kept[1]) == {105, 106, 107}
    assert set(kept[1]) - set(kept[2]) == {100, 101}
    assert kept[3].keys() == kept[2].keys() and passage in kept[3][102].text and passage not in kept[3][103].text
    assert {d for d in kept[3] if kept[3][d].text != texts[d]} == {103}
    assert {d for d in kept[4] if kept[4][d].text != kept[3][d].text} == {104}
    assert SECRET not in kept[4][104].text and secret_scan.MASK in kept[4][104].text
    assert all(r.n_chars == len(r.text) for r in kept[4].values())
    packed = steps[5].collect()
    assert {r.doc_id for r in packed} == set(kept[4]) and all(r.offset + r.n_tokens <= 2048 for r in packed)


def test_run_is_the_stages_in_turn(spark, corpus, tmp_path):
    docs, _, _ = corpus
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path))
    want = docs
    for name, stage in cp.STAGES:
        want = cp.kept(stage(spark, want, ""), name)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_table_runs_through(spark, corpus):
    docs = corpus[0].limit(0)
    for name, stage in cp.STAGES:
        docs = cp.kept(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_every_operator_has_its_query():
    names = [*llm.queries()]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(llm.oracle_sql()) <= set(names)
