"""What SQL can't judge: sequential rules, streams, table swaps, properties of pages and syncs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.functions import parse, paths, text
from sextant.operators import graph, output, ranges, vector
from sextant.plans.search import Options
from sextant.queries.policy_queries import hits
from sextant.sources import tree
from sextant.streaming import sync

SF = "/root/testdata/sf0.001"


@given(st.lists(st.sampled_from("ab*?/."), max_size=8).map("".join), st.lists(st.sampled_from("ab/."), max_size=8).map("".join))
@settings(max_examples=300, deadline=None)
def test_globs(glob, path):
    def match(g, p):
        if not g:
            return not p
        if g.startswith("**/"):
            return match(g[3:], p) or any(match(g[3:], p[i + 1 :]) for i, c in enumerate(p) if c == "/")
        if g.startswith("**"):
            return any(match(g[2:], p[i:]) for i in range(len(p) + 1))
        if g[0] == "*":
            return any(match(g[1:], p[i:]) for i in range(len(p) + 1) if "/" not in p[:i])
        return bool(p) and (p[0] == g[0] or g[0] == "?" and p[0] != "/") and match(g[1:], p[1:])

    assert bool(re.match(text.glob_pattern(glob), path)) == match(glob, path)


def test_tool_calls():
    assert parse.tool_call('[TOOL_CALLS]f[ARGS]{"a": "}\\"{", "b": [1,],}')[1] == '{"a":"}\\"{","b":[1]}'
    assert parse.tool_call(None) is None and parse.tool_call('[TOOL_CALLS]f[ARGS]{"a": ') is None


def test_block_end():
    assert graph.block_end("a {\n b {\n }\n}\nc", 1) == 4
    assert graph.block_end("int x;\n{", 1) == 1
    assert graph.block_end("\n" * 50, 5) == 25
    assert graph.block_end("{" + "\n" * 200, 1) == 121


def test_greedy_windows(spark):
    h = hits(spark, SF)
    near = ranges.near_scores(h, ["path"]).withColumn("near", F.round("near", 6)).join(h.select("path", "ln", "n_lines"), ["path", "ln"])
    want = set()
    per = {}
    for r in near.collect():
        per.setdefault(r.path, []).append((-r.near, r.ln, r.n_lines))
    for p, rows in per.items():
        taken = []
        for _, ln, n in sorted(rows):
            s, e = max(1, ln - 20), min(n, ln + 40)
            if len(taken) < 6 and all(e < a or s > b for a, b in taken):
                taken.append((s, e))
        want |= {(p, *t) for t in taken}
    assert {tuple(r) for r in ranges.greedy_windows(near, ["path"]).collect()} == want


def test_embedding(spark):
    vocabulary = {"[UNK]": 0, "un": 1, "##able": 2, "able": 3}
    assert vector.word_pieces("unable", vocabulary, 0) == [1, 2]
    assert vector.word_pieces("x", vocabulary, 0) == [0] and vector.word_pieces("u" * 101, vocabulary, 0) == [0]
    matrix = np.eye(4)
    embed = vector.embedder(spark, vocabulary, matrix)
    got = spark.createDataFrame([(["unable", "x"],), ([],)], "w array<string>").select(embed("w").alias("e")).collect()
    assert np.allclose(got[0].e, np.array([1, 1, 1, 0]) / 3**0.5) and got[1].e == [0.0] * 4


def test_units(spark):
    r = random.Random(1)
    rows = [(i, "\n".join("x" * r.choice([0, 5, 900, 9000]) for _ in range(r.randint(0, 150)))) for i in range(20)] + [(99, None)]
    got = {}
    for u in sorted(vector.split_units(spark.createDataFrame(rows, "key long, text string")).collect()):
        assert u.body.count("\n") < 60 and len(u.body) <= 4000
        got.setdefault(u.key, []).append(u.body)
    for k, t in rows:
        assert "".join(got[k]).replace("\n", "") == (t or "").replace("\n", "")


def test_pages_make_the_whole(spark):
    df = spark.range(57).select(F.lit(1).alias("g"), "id")
    seen = [r.id for o in range(0, 60, 10) for r in sorted(output.page(df, ["g"], ["id"], o, 10).collect(), key=lambda r: r.place)]
    assert seen == list(range(57))


def test_incremental_equals_rebuild(spark):
    r = random.Random(2)
    old = {f"p{i}": (r.randint(1, 9), 1.0, f"h{r.randint(0, 3)}") for i in range(60)}
    new = {k: v if r.random() < 0.5 else (r.randint(1, 9), 2.0, f"h{r.randint(0, 3)}") for k, v in old.items() if r.random() < 0.8}
    new |= {f"q{i}": (1, 1.0, "h9") for i in range(7)}
    schema = "path string, size long, mtime_ms double, hash string"
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], schema)
    todo = sync.actions(frame(new), frame(old))
    rows = lambda d: spark.createDataFrame([(k, v[2]) for k, v in d.items()], "path string, hash string")
    got = {x.path: x.hash for x in sync.upsert(rows(old), rows(new), todo).collect()}
    stale = {k for k, v in new.items() if k in old and old[k][:2] == v[:2] and old[k][2] != v[2]}
    assert {k: v for k, v in got.items() if k not in stale} == {k: v[2] for k, v in new.items() if k not in stale}


def test_swap(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    for n in (3, 5):
        sync.replace_table(spark.range(n).toDF("x"), path)
        assert sync.read_table(spark, path).count() == n
    assert spark.read.parquet(path + ".bak").count() == 3


def test_watch_and_space(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for i in range(3):
        (tmp_path / "src" / f"{i}.md").write_text(f"text {i}")
    stream = sync.watch(spark, str(tmp_path / "src"), "*.md").select(F.lit("a").alias("project"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("end"))
    q = sync.spaced(stream).writeStream.format("memory").queryName("spaced_syncs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    times = sorted(r.run_at for r in spark.table("spaced_syncs").collect())
    assert [(b - a).total_seconds() for a, b in zip(times, times[1:])] == [5.0, 5.0]


def test_watchers(spark, tmp_path):
    held = sync.Watchers(most=1)
    start = lambda n: lambda: spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / n)).start()
    a = held.get("a", start("a"))
    assert held.get("a", start("x")) is a
    held.get("b", start("b"))
    assert not a.isActive and [p for p, *_ in held.status()] == ["b"]
    held.stop()


def test_read_tree(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.ts").write_text("let a = 1;\n")
    (tmp_path / "src" / "b.bin").write_text("x")
    (tmp_path / "src" / "node_modules" / "c.js").write_text("x")
    got = tree.scan(tree.read(spark, str(tmp_path))).collect()
    assert [(r.path, r.size, r.rn) for r in got] == [("src/a.ts", 11, 1)]
    assert tree.coverage(tree.read(spark, str(tmp_path)).select("path", "text")).head().sources == 2


def test_options():
    with pytest.raises(ValueError, match="24 lines"):
        Options(chunk_lines=3)
    with pytest.raises(ValueError, match="unknown"):
        Options(mode="x")
    assert paths.inside("p").startswith("(not")
