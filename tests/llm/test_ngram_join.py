"""op1 against brute force."""

import random

import numpy as np
import pytest

from sextant.llm import ngram_join

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None, links[i]))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdé", k=r.randint(1, 6))) for _ in range(300)]
    rows, words = [], []
    for i in range(160):
        if words and r.random() < 0.65:
            w = list(r.choice(words[-25:]))
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                if w:
                    at = r.randrange(len(w))
                    w[at : at + r.choice([0, 1])] = r.choices(vocabulary, k=r.choice([0, 1]))
        else:
            w = r.choices(vocabulary, k=r.choice([1, 2, 3, 10, 11, 12, 40, 90, 200])) + vocabulary[:20] * r.choice([0, 0, 1])
        words.append(w)
        rows.append((r.randrange(10**6), r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.1 else " ".join(w)))
    return rows + [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE "), (None, "one two"), (None, rows[0][1]), (rows[3][0], rows[3][1]), (4, "É a"), (3, "é a"), (2, "long text here " * 20000)]


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 3, 90), (2, 5, 80)])
def test_brute(spark, seed, n, num):
    rows = made(seed)
    df = spark.createDataFrame([(*x, "c") for x in rows], SCHEMA).repartition(3)
    got = ngram_join.similar_components(df, n, num, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, n, num, 100)


def test_empty_and_one_each(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.digest(empty).collect() == []
    assert ngram_join.first_of_each(empty).collect() == []
    text = "a b c d e f g h i j k l m n o p"
    df = spark.createDataFrame([(3, text, "x"), (2, text, "y"), (2, text, "y"), (9, "other words are here now and then", None), (10, None, None), (11, "", None)], SCHEMA)
    out = ngram_join.first_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 9, 10, 11]


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (1, 2), (1, 1)])
def test_product(monkeypatch, num, den):
    """Blocks of columns give the same links as whole sets."""
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    r = random.Random(num)
    sets = [np.unique(np.array(r.sample(range(60), r.choice([1, 5, 30, 50])), np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[1:], np.array([99], np.uint64)])) for s in sets]
    want = [[den * len(set(a) & set(b)) >= num * len(set(a) | set(b)) for b in sets[20:]] for a in sets]
    assert ngram_join.linked(sets, sets[20:], num, den).tolist() == want


@pytest.mark.parametrize("name", ["HOT", "BLOCK_ROWS", "BLOCK_GRAMS"])
def test_small_parts(spark, monkeypatch, name):
    """With tiny parts and blocks every common column and component is dealt out in several; the result is the same."""
    monkeypatch.setattr(ngram_join, name, 1 if name == "HOT" else 3)
    rows = made(3)
    df = spark.createDataFrame([(*x, "c") for x in rows], SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in ngram_join.similar_components(df).collect()), key=str) == brute(rows, 3, 90, 100)


def test_one_each_by_row(spark):
    """Null and repeated ids are decided by row; names of the stage's own columns clash with nothing."""
    a, b = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z aa bb cc dd ee"
    rows = [(5, a, 0), (None, a, 1), (None, b, 2), (7, "one two three four five six seven eight nine", 3), (7, a + " ", 4), (8, b + " extra", 5), (8, b + " extra", 6), (9, None, 7), (9, "", 8), (9, b, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id_ long").toDF("doc_id", "text", "id_")
    for c in ("_id", "_k", "_stays", "key_", "id", "key", "many_", "stays"):
        df = df.withColumn(c, df["id_"])
    out = ngram_join.first_of_each(df.repartition(2))
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(5, a), (8, b + " extra"), (7, rows[3][1]), (9, None), (9, "")], key=str)
