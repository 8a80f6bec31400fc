import random
from collections import Counter

import pyarrow as pa
import pytest

from vexel.llm import quality_rules as q


def brute(text):
    """The measures from their definitions, with words and lines as strings."""
    text = text or ""
    words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ").split(" ") if w]
    lines = [x for x in text.split("\n") if x]
    out, seen, again = {"n_words": len(words)}, set(), []
    for line in lines:
        again.append(line in seen)
        seen.add(line)
    out["dup_line_frac"] = sum(again) / len(lines) if lines else 0
    size = sum(map(len, lines))
    out["dup_line_char_frac"] = sum(len(x) for x, a in zip(lines, again) if a) / size if size else 0
    total = sum(map(len, words))
    for n in (*q.TOP, *q.DUP):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        if n in q.TOP:
            best = max((c * sum(map(len, g)) for g, c in count.items() if c > 1), default=0)
            out[f"top_{n}"] = min(1, best / total) if total else 0
        else:
            inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}
            out[f"dup_{n}"] = sum(len(words[i]) for i in inside) / total if total else 0
    return out


def texts(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(30)] + ["é", "日本", "the"]
    out = ["", None, " \n\t ", "one", "a b a b a b", "x\nx\nx", "\n\n\n", "long " * 4000, "aé " * 50]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(rng.randrange(120))))
    line = " ".join(rng.choice(words) for _ in range(15))
    return [*out, f"{line}\n{line}\nother words", *out[:12]]


@pytest.mark.parametrize("seed", range(3))
def test_measures_equal_brute_force(seed):
    rows = texts(seed)
    got = q._measured(pa.array(rows, pa.string()))
    for i, text in enumerate(rows):
        for name, want in brute(text).items():
            assert got[name][i] == pytest.approx(want, abs=1e-9), (text, name)


def test_queries(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts(9))] + [(None, "some fine and different words", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, keep int").repartition(3)
    measured = q.measure(df).collect()
    assert len(measured) == len(rows)
    want = {}
    for i, t, _ in rows:
        b = brute(t)
        want[i] = b["n_words"] > 0 and all(b[k] <= limit for k, limit in q.LIMITS.items())
    assert {r.doc_id: r.keep for r in measured} == want
    kept = q.keep_good(df)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, k in want.items() if k}
    assert q.measure(df.limit(0)).count() == q.keep_good(df.limit(0)).count() == 0
