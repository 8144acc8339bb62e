"""Merged ranges are those of SQL where sums aren't whole numbers, and don't depend on the order of equal ranges."""

import random

import duckdb
import pytest

from sextant.queries import ORACLES, QUERIES

SCHEMA = "l_suppkey long, l_partkey long, l_quantity double"


@pytest.mark.parametrize("name", ["w11_range_merge", "w11_range_merge_capped"])
def test_sums_round_as_in_sql(spark, tmp_path, name):
    rows = [(1, 1, 2.5), (1, 9, 3.5), (1, 19, 0.5), (1, 26, 1.0), (2, 1, 0.7), (2, 8, 1.2), (2, 14, 1.6), (2, 22, 0.5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == sorted(found.fetchall())


def test_equal_ranges_are_one(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, rng.randrange(1, 300), float(rng.randrange(1, 9))) for k in range(5) for _ in range(30)]
    want: dict[tuple[int, int], int] = {}
    for k in range(5):
        first = end = None
        for s, e in sorted((s, s + int(n)) for k2, s, n in rows if k2 == k):
            first, end = (s, e) if end is None or s > end + 5 else (first, max(end, e))
            want[k, first] = end
    many = rows * 200
    rng.shuffle(many)
    spark.createDataFrame(many, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.k, r.s): r.e for r in QUERIES["w11_range_merge"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 20
