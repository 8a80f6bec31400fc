import re

import duckdb
import pytest

from vexel.llm import secret_scan as ss

KEY = "AKIA" + "ABCDEFGH01234567"
TOKEN = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff'
ROWS = [
    (1, f"é a {KEY} b {KEY}{KEY}"),
    (2, f"é a {KEY} b {KEY}{KEY}"),
    (3, f'x {TOKEN}" y password=b7db7aa4a5fcc78305 z'),
    (4, "clean token = short, password="),
    (5, None),
    (6, ""),
    (8, 'TOKEN = "9233A8EC24be64439e3e49cf", Api_Key=0123456789abcdef0'),
    (None, f"nul {KEY}"),
    (7, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36 + " 'xoxb-1234567890-ab' " + "x" * 50000 + KEY),
    (7, f"another text of seven {KEY}"),
    (3, f'x {TOKEN}" y password=b7db7aa4a5fcc78305 z'),
]


def brute(rows, rules=ss.RULES):
    return sorted(((d, rule, m.start(), m.group()) for d, t in rows for rule, p in rules.items() for m in re.finditer(p, t or "")), key=str)


def found(df):
    return sorted(((r.doc_id, r.rule, r["at"], r["match"]) for r in df.collect()), key=str)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)


def test_findings_equal_brute_force(spark, docs):
    assert found(ss.scan(docs, ss.Ledger(spark))) == brute(ROWS)


def test_only_unseen_blobs_and_rules_are_scanned(spark, docs):
    ledger = ss.Ledger(spark)
    ss.scan(docs.where("doc_id < 4"), ledger)
    assert ledger.scanned().count() == 2
    # A finding put into the ledger by hand comes back only if its blob isn't scanned again.
    assert found(ss.scan(docs, ledger)) == brute(ROWS)
    assert ledger.scanned().count() == len({t for _, t in ROWS if t is not None})
    before = ledger.found().count()
    assert found(ss.scan(docs, ledger)) == brute(ROWS)
    assert ledger.found().count() == before
    other = {"word": "clean"}
    assert found(ss.scan(docs, ledger, rules=other)) == brute(ROWS, other)
    assert ledger.scanned().count() == 2 * len({t for _, t in ROWS if t is not None})


def test_batch_without_its_marker_is_not_read(spark, docs):
    ledger = ss.Ledger(spark)
    spark.createDataFrame([("b", "v")], "blob string, rules_version string").write.parquet(f"{ledger.folder}/scanned/half")
    assert ledger.scanned().count() == 0
    assert found(ss.scan(docs, ledger)) == brute(ROWS)


def test_mask(spark, docs):
    wide = docs.selectExpr("doc_id", "text", "1 as blob", "'z' as rule", "2 as __hit", "3 as hit", "4 as HIT_")
    out = ss.mask(wide, ss.Ledger(spark))
    assert out.columns == wide.columns

    def masked(text):
        for p in ss.RULES.values():
            text = text and re.sub(p, ss.MASK, text)
        return text

    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((d, masked(t)) for d, t in ROWS), key=str)


def test_empty(spark, docs):
    assert ss.scan(docs.limit(0), ss.Ledger(spark)).count() == 0
    assert ss.mask(docs.limit(0), ss.Ledger(spark)).count() == 0


def test_sql_agrees(tmp_path, spark):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", ROWS)
    got = con.sql(f'select doc_id, rule, "at", "match" from ({ss.oracle()})').fetchall()
    assert sorted(got, key=str) == brute(ROWS)
