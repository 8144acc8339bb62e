"""Queries that take part with all rows and whole texts, held against plain Python."""

import math
import os
from collections import defaultdict

import pytest

from sextant.operators import vector
from sextant.queries import QUERIES
from sextant.queries.base import files, table

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # on the smaller, no range is apart
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


def test_chunk_text_is_whole(spark):
    texts = {r.path: r.text for r in files(spark, SF).collect()}
    got = QUERIES["x36_whole_chunk_text"](spark, SF).collect()
    assert len(got) == len(texts) and max(map(len, texts.values())) > 400
    assert all(r.chunk_text.startswith("file: ") and r.chunk_text.split("\n", 1)[1] == texts[r.path] for r in got)


def test_ranges_are_whole(spark):
    texts = {r.path: r.text.replace("\r\n", "\n").split("\n") for r in files(spark, SF).collect()}
    got = {(r.path, r.s): (r.e, r.snippet) for r in QUERIES["x46_whole_ranges"](spark, SF).collect()}
    want = {(p, s): (min(e, len(t)), "\n".join(t[s - 1 : e])) for p, t in texts.items() for s, e in ((1, 14), (2, 4), (15, 10**9)) if s <= len(t)}
    assert got == want and max(len(x) for _, x in got.values()) > 1200


def test_every_line_is_a_hit(spark):
    texts = {r.path: r.text.replace("\r\n", "\n").split("\n") for r in files(spark, SF).collect()}
    scores = {p: [(len(x) % 7 + 1) / 4 for x in t] for p, t in texts.items()}
    near = {}
    for p, s in scores.items():
        for i, x in enumerate(s):
            for j in range(max(0, i - 40), min(len(s), i + 41)):
                d = abs(i - j)
                x += 0 if not d else s[j] * (1 - d / 16) * 0.7 if d <= 12 else s[j] * 0.12
            near[p, i + 1] = x
    got = {(r.path, r.ln): r.near for r in QUERIES["j14_all_line_bands"](spark, SF).collect()}
    assert got.keys() == near.keys() and all(abs(got[k] - near[k]) < 1e-6 for k in near)
    taken = defaultdict(set)
    for p, t in texts.items():
        for ln in sorted(range(1, len(t) + 1), key=lambda ln: (-round(near[p, ln], 9), ln)):
            s, e = max(1, ln - 20), min(len(t), ln + 40)
            if len(taken[p]) < 6 and all(s > b or e < a for a, b in taken[p]):
                taken[p].add((s, e))
    windows = defaultdict(set)
    for r in QUERIES["l8_greedy_windows"](spark, SF).collect():
        windows[r.path].add((r.s, r.e))
    assert windows == taken


def test_ranges_of_all_suppliers(spark):
    own, others = defaultdict(list), defaultdict(list)
    for r in table(spark, MORE, "lineitem").collect():
        (own if r.l_returnflag == "R" else others)[r.l_suppkey].append((r.l_orderkey, r.l_orderkey + r.l_linenumber))
    want = sorted((k, s, e) for k, v in own.items() for s, e in v if not any(s <= e2 + 12 and s2 <= e + 12 for s2, e2 in others[k]))
    got = sorted(map(tuple, QUERIES["j13_flags_apart"](spark, MORE).collect()))
    assert got == want and len({k for k, _, _ in got}) > 50


def test_query_batch_grows(spark):
    rows = {r.vec_id: r.embedding for r in table(spark, SF, "embeddings").collect()}
    asked = {i for i in rows if i % 50 == 0}
    got = {(r.qid, r.vec_id): r.score for r in QUERIES["x40_dot_products"](spark, SF).collect()}
    assert got.keys() == {(a, b) for a in asked for b in rows} and len(asked) > 1
    assert all(abs(v - math.sumprod(map(float, rows[a]), map(float, rows[b]))) < 2e-6 for (a, b), v in got.items())
    hits = QUERIES["l2_vector_topk_batch"](spark, SF).collect()
    assert {r.qid for r in hits} == asked
    for q in asked:
        best = sorted((-v, b) for (a, b), v in got.items() if a == q and v >= 0.25)[:32]
        assert [(r.id, r.rank) for r in sorted(hits, key=lambda r: r.rank) if r.qid == q] == [(b, i) for i, (_, b) in enumerate(best, 1)]


def test_blocks_hold_every_query_once(spark):
    asked = spark.range(1000).withColumnRenamed("id", "qid")
    assert sorted(r.qid for r in vector.in_blocks(asked, lambda q: q, most=90).collect()) == list(range(1000))
