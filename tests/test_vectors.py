"""Products and searches of vectors: matrix products in blocks, with the sums and the rounding of SQL."""

import math

import duckdb
import numpy as np

from sextant.operators import vector

SCHEMA = "id long, path string, embedding array<float>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, rows, asked):
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(asked, "qid long, qv array<float>")


def test_pairs_are_multiplied_in_blocks(spark):
    v, q = tables(spark, [(1, "a", [1.0, 0.0])], [(1, [0.5, 0.5])])
    assert "NestedLoop" not in plan(vector.products(v, q)) + plan(vector.search(v, q))


def test_products_are_those_of_sql(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"g{i % 3}", (rng.integers(-9, 9, 6) / 2.0 ** rng.integers(1, 12)).tolist()) for i in range(400)]
    for i, x in enumerate([0.09343749999999999, 0.0934375, 1.0000005, -2.5e-6, -1e-9, 5e-7]):  # halves and what lies beside them, as sums of floats
        parts = []
        for _ in range(6):
            parts.append(float(np.float32(x - sum(parts))))
        rows.append((1000 + i, "half", parts))
    asked = [(r[0], r[2]) for r in rows if r[0] % 50 == 0] + [(9999, [1.0] * 6)]
    v, q = tables(spark, rows, asked)
    con = duckdb.connect()
    con.execute("create table v (id bigint, path varchar, e float[])")
    con.executemany("insert into v values (?, ?, ?)", rows)
    con.execute("create table q (qid bigint, e float[])")
    con.executemany("insert into q values (?, ?)", asked)
    want = con.execute("select qid, id, round(list_inner_product(v.e::double[], q.e::double[]), 6) from v, q order by all").fetchall()
    assert sorted(map(tuple, vector.products(v.drop("path"), q).collect())) == want
    hits = con.execute("select * from (select qid, id, path, round(list_inner_product(v.e::double[], q.e::double[]), 6) as s, row_number() over (partition by qid order by s desc, id) as rank from v, q where s >= 0.25) where rank <= 5 order by all").fetchall()
    assert sorted(map(tuple, vector.search(v, q, most=5).collect())) == hits and len({h[0] for h in hits}) > 3


def test_odd_vectors(spark):
    """Nulls, vectors that hold one, other lengths and empty ones have no score; NaN is the highest; copies tie by id, null ids last."""
    rows = [(1, "a", None), (2, "a", [1.0, None]), (3, "a", [1.0]), (4, "a", []), (None, "a", [1.0, 1.0]), (5, "b", [float("nan"), 1.0]), *((i, None, [1.0, 1.0]) for i in range(40, 10, -1))]
    v, q = tables(spark, rows, [(50, [1.0, 0.5]), (100, None)])
    got = {(r.qid, r.id): r.score for r in vector.products(v.drop("path"), q).collect()}
    assert len(got) == 2 * len(rows) and all(got[100, i] is None for _, i in got) and all(got[50, i] is None for i in (1, 2, 3, 4))
    assert got[50, None] == 1.5 and math.isnan(got[50, 5])
    best = sorted(vector.search(v, q, most=40).collect(), key=lambda r: r.rank)
    assert [r.id for r in best] == [5, *range(11, 41), None] and {r.qid for r in best} == {50}
    assert [r.id for r in sorted(vector.search(v, q, most=3).collect(), key=lambda r: r.rank)] == [5, 11, 12]
    empty = q.limit(0)
    assert vector.products(v.drop("path"), empty).count() == vector.search(v, empty).count() == vector.search(v.limit(0), q).count() == 0


def test_best_are_kept_along_the_way(spark, monkeypatch):
    """More hits than a task holds: what is dropped on the way isn't among the best."""
    monkeypatch.setattr(vector, "OUT_ROWS", 64)
    monkeypatch.setattr(vector, "ROWS", 16)
    rows = [(i, "p", [((i * 37) % 101) / 128, 1.0]) for i in range(500)]
    asked = [(i, [i / 50, 0.5]) for i in (50, 100)]
    q = spark.createDataFrame(asked, "qid long, qv array<double>")
    v = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = {a: sorted((-round(x[0] * y[0] + x[1] * y[1], 6), i) for i, _, x in rows)[:7] for a, y in asked}
    got = {a: sorted((-r.score, r.id) for r in vector.search(v, q, most=7).collect() if r.qid == a) for a, _ in asked}
    assert got == want
