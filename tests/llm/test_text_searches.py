"""op5, op7 and op10 against brute force on made cases."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from sextant.llm import decontaminate, line_dedup, topk

DOCS = "doc_id long, text string, lang string, n_words string, items string"
BENCH = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def toks(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_leaks(docs, bench):
    out = []
    for d, t in docs:
        w, hit, items = toks(t), set(), set()
        for i, x in bench:
            b = toks(x)
            for s in range(max(1, len(b) - 9) if b else 0):
                k = b[s : s + 10]
                for at in range(len(w) - len(k) + 1):
                    if w[at : at + len(k)] == k:
                        hit.update(range(at, at + len(k)))
                        items.add("null" if i is None else str(i))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_cases():
    r = random.Random(5)
    v = ["a", "b", "c", "É", "x1", "the", "Of", "9"]
    bench = [(i, " ".join(r.choices(v, k=r.choice([0, 1, 3, 10, 14])))) for i in range(12)] + [(3, "the of the of, a b c a b c a"), (None, "zz yy"), (20, None), (21, ""), (10, "zz yy")]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choices(v, k=r.choice([0, 1, 5, 40])))) for i in range(60)]
    docs += [(7, docs[7][1]), (None, "Zz-yy"), (99, None), (100, "The " * 3000), (101, "q " + (bench[12][1] + " ") * 3), (102, "zz  yyé")]
    return docs, bench


def test_leaks(spark, monkeypatch):
    docs, bench = leak_cases()
    df, b = spark.createDataFrame([(*d, "x", "y", None) for d in docs], DOCS), spark.createDataFrame(bench, BENCH)
    want = brute_leaks(docs, bench)
    for block in (8 << 20, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        assert sorted((tuple(r) for r in decontaminate.digest(df, b).collect()), key=str) == want
    assert decontaminate.clean(df, b).columns == df.columns
    empty = spark.createDataFrame([], BENCH)
    assert not any(r.contaminated for r in decontaminate.digest(df, empty).collect())
    assert decontaminate.digest(df.limit(0), b).collect() == []


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a x x b c", "", "", ""), (2, "c a b", "", "", ""), (3, "a x x x x x b c", "", "", ""), (4, None, "", "", "")], DOCS)
    assert {r.doc_id: r.start for r in decontaminate.proximity(df, ["a", "B", "c"], 5).collect()} == {1: 0, 2: 0}


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(k := key(x)) < 40 or len(seen[k] - {None}) < 5 or d == max(seen[k] - {None})]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [500_000, 0])
def test_lines(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "MOST_KEYS", most)
    r = random.Random(7)
    pool = ["é" * 40, "é" * 39, "L" * 40, "l" * 40, "x" * 20 + "\t" + "y" * 30, "\t " + "l" * 40 + "\r", "z" * 5000, "", "\x85" + "k" * 39, "q" * 40 + "\xa0"]
    rows = [(i, "\n".join(r.choices(pool, k=r.choice([1, 2, 9])))) for i in range(25)]
    rows += [(3, "L" * 40), (None, "l" * 40 + "\n\n"), (None, None), (90, None), (91, ""), (92, "only one line that is quite long and stands once here")]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], DOCS)
    assert sorted((tuple(x) for x in line_dedup.digest(df).collect()), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(df).columns == [*df.columns, "n_lines", "n_dropped"]
    assert line_dedup.digest(df.limit(0)).collect() == []
    clashing = df.selectExpr("*", "lang as rid", "lang as _rid", "lang as rid_", "lang as goes", "lang as keep", "lang as _goes")
    out = line_dedup.dedup_lines(clashing)
    assert out.columns == [*clashing.columns, "n_lines", "n_dropped"] and {r.rid for r in out.collect()} == {"a"}
    assert sorted((r.doc_id, r.text or "") for r in out.collect() if r.doc_id is not None) == sorted((r.doc_id, r.text or "") for r in line_dedup.dedup_lines(df).collect() if r.doc_id is not None)


def test_only_marked_rows_move(spark, monkeypatch):
    """Past MOST_KEYS and with a filter that lets everything through, results stay and only rows that lose lines are shuffled with their texts."""
    monkeypatch.setattr(line_dedup, "MOST_KEYS", 0)
    rows = [(i, f"line {i} is a line of its own that stands nowhere else at all\n" + ("common line that many documents hold, " * 2 if i % 10 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], DOCS)
    for bits in (1 << 28, 1 << 10):
        monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
        monkeypatch.setattr(line_dedup, "LEAST_BITS", min(bits, 1 << 16))
        assert sorted((tuple(x) for x in line_dedup.digest(df).collect()), key=str) == brute_lines(rows)
    monkeypatch.setattr(line_dedup, "MOST_BITS", 1 << 28)
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 1 << 16)
    out = line_dedup.dedup_lines(df)
    out.collect()
    assert re.search("LeftOuter", out._jdf.queryExecution().toString())


def test_filter_merges_tasks(spark):
    df = spark.createDataFrame([(i, "w" * 50, "", "", "") for i in range(5)], DOCS).repartition(5)
    assert sum(x.n_dropped for x in line_dedup.digest(df).collect()) == 4


def brute_top(rows, k=5):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, x in ok:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -v) for n, (v, i) in enumerate(s)]
    return sorted(out)


def test_bounds_prune():
    """On vectors in clusters the bounds leave few pairs to score; on any, the best are the same."""
    r = np.random.default_rng(4)
    centres = r.normal(0, 40, (20, 64))
    x = np.floor(centres[np.arange(3000) % 20] + r.normal(0, 4, (3000, 64)))
    ids = np.arange(3000)
    best = topk.Best(ids[::50], x[::50], 5)
    for a in range(0, 3000, 300):
        best.add(ids[a : a + 300], x[a : a + 300])
    scores = x[::50] @ x.T
    scores[np.arange(60), ids[::50]] = -np.inf
    want = {(q, i) for q in range(60) for i in np.lexsort((ids, -scores[q]))[:5].tolist()}
    assert set(zip(best.row.tolist(), best.id.tolist(), strict=True)) == want
    assert best.survived < 0.15 * best.seen


@pytest.mark.parametrize("block", [4096, 2])
def test_top(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(17)]) for i in range(220)]
    rows += [(i, list(rows[100][1])) for i in range(220, 250)] + [(250, [0.0] * 17), (300, [1e6] * 17), (301, [-1e6] * 16 + [3.0])]
    rows += [(400, None), (401, [None] * 17), (402, [float("nan")] * 17), (403, [float("inf")] + [0.0] * 16), (None, [1.0] * 17), (450, [1.0, 2.0]), (451, [2.0, -1.0]), (500, []), (501, []), (7, rows[7][1])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("score", T.StringType())])
    got = topk.digest(spark.createDataFrame([(*x, "") for x in rows], schema).repartition(3)).collect()
    assert sorted(tuple(x) for x in got) == brute_top(rows)
    assert topk.digest(spark.createDataFrame([], schema)).collect() == []
