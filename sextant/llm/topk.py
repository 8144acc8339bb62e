"""Exact top-k inner products by segment statistics, coarse to fine.

Each vector is cut into segments; of each, the mean and the deviation (root of the sum of squares about the mean)
are kept. Over a segment of length l, x.y = l mean(x) mean(y) + (x - mean).(y - mean) <= l mean mean + dev dev, so
sums of those bound a score from above, as |x|^2 + |y|^2 less twice that bounds the squared distance from below. A block of
candidates is bounded with few segments, what may still be among the best with more, and only
survivors' scores are computed, in whole numbers. Where a block of candidates is bounded, those with the highest bounds go first, so that
the k-th best scores, which the others must reach, rise early. How much that leaves depends on the vectors: `Best.seen` and `Best.survived` count it.

Queries are broadcast in blocks of BLOCK_QUERIES; each block is one pass over the candidates, and where there are several, a block's
best are written and its broadcast is freed before the next. No task keeps more than its k best for
each query of the block, and the bests of the tasks are ranked by query. Copies of one vector in a third
of the rows change only how many candidates tie with the k-th best, which are ranked by id.

Null vectors, and those with null or non-finite components, take no part, nor do rows with a null id. Only vectors
of one length are compared. Empty vectors score 0. Components are taken as floor(256 x); a score beyond 64 bits
raises an error. Repeated ids are rows like any other, but a query meets no row of its own id. Empty tables give no rows. Extra columns
aren't looked at, whatever their names. Long vectors are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK_QUERIES, BLOCK_ROWS, LEVELS, PAIRS = 4096, 512, (2, 8, 32), 1 << 15


def scaled(column) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a list column: rows that take part, their lengths, and the values floor(256 x) of each as doubles."""
    rows, lengths, values = [], [], []
    flat = column.flatten() if not column.null_count else None
    if flat is not None and not flat.null_count and len(column) and (n := len(flat) // len(column)) * len(column) == len(flat) and n and set(np.diff(column.offsets.to_numpy()).tolist()) == {n}:
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        good = np.flatnonzero(np.isfinite(x).all(axis=1))
        return good, np.full(len(good), n), list(np.floor(256 * x[good]))
    for i, v in enumerate(column.to_pylist()):
        if v is None or any(c is None for c in v):
            continue
        x = np.array(v, np.float64)
        if np.isfinite(x).all():
            rows.append(i)
            lengths.append(len(x))
            values.append(np.floor(256 * x))
    return np.array(rows, np.int64), np.array(lengths, np.int64), values


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(l) mean and deviation by segment: their inner products bound those of the vectors."""
    cuts = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1, keepdims=True) if b > a else np.zeros((len(x), 1))
        out += [mean * np.sqrt(b - a), np.sqrt(((part - mean) ** 2).sum(axis=1, keepdims=True))]
    return np.concatenate(out, axis=1)


def whole(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether doubles hold all partial sums of the inner products exactly."""
    return not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, pair by pair, as 64-bit whole numbers."""
    if whole(q, c):
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True)], dtype=np.int64)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, vectors, k
        self.levels = [statistics(vectors, s) for s in LEVELS]
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(ids), -np.inf)
        self.slack = 1e-9 * (1 + np.abs(vectors).sum(axis=1))
        self.seen = self.survived = 0

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Bounds a block of candidates coarse to fine, then scores what is left of it."""
        slack = self.slack[:, None] * (1 + np.abs(c).max(axis=1, initial=0))[None, :]
        alive = self.ids[:, None] != ids[None, :]
        self.seen += alive.size
        bound = None
        for level, segments in zip(self.levels, LEVELS, strict=True):
            rows, own = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(rows):
                return
            bound = np.full(alive.shape, -np.inf)
            bound[np.ix_(rows, own)] = level[rows] @ statistics(c[own], segments).T
            bound += slack
            alive &= bound >= self.least[:, None]
        q, at = np.nonzero(alive)
        order = np.argsort(-bound[q, at], kind="stable")
        self.score_pairs(q[order], at[order], bound[q, at][order], ids, c)

    def score_pairs(self, q: np.ndarray, at: np.ndarray, bound: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        """Exact scores of pairs, the highest bounds first; pairs that the scores so far rule out are left."""
        for a in range(0, len(q), PAIRS):
            own = slice(a, a + PAIRS)
            good = bound[own] >= self.least[q[own]]
            i, j = q[own][good], at[own][good]
            self.survived += len(i)
            self.keep(i, exact(self.x[i], c[j]), ids[j])

    def keep(self, row: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        good = score >= self.least[row]
        if not good.any():
            return
        row, score, found = np.concatenate([self.row, row[good]]), np.concatenate([self.score, score[good]]), np.concatenate([self.id, found[good]])
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.row, self.score, self.id = row[best], score[best], found[best]
        last = place[best] == self.k - 1
        self.least[self.row[last]] = self.score[last]


def _vectors(ids, column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of the vectors that take part, by length."""
    rows, lengths, values = scaled(column)
    known = ids[rows] if len(rows) else []
    for n in np.unique(lengths).tolist():
        own = [i for i, m in enumerate(lengths.tolist()) if m == n and known[i] is not None]
        if own:
            yield n, np.array([known[i] for i in own], np.int64), np.array([values[i] for i in own], np.float64).reshape(len(own), n)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query's row the k highest scores of other ids' vectors."""
    spark = vectors.sparkSession
    narrow = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    blocks, best = -(-asked.count() // BLOCK_QUERIES) or 1, []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        table = part.toArrow().combine_chunks()
        held = spark.sparkContext.broadcast(list(_vectors(np.array(table.column("id").to_pylist(), object), table.column("v").combine_chunks())) if len(table) else [])
        del table

        def run(batches, held=held):
            best = {m: Best(ids, x, k) for m, ids, x in held.value}
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    x = batch.slice(at, BLOCK_ROWS)
                    for m, ids, c in _vectors(np.array(x.column(0).to_pylist(), object), x.column(1)):
                        if m in best:
                            best[m].add(ids, c)
            for m, y in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(y.ids[y.row]), pa.array(np.full(len(y.row), m)), pa.array(y.row), pa.array(y.id), pa.array(y.score)], names=["query_id", "length", "row", "vec_id", "score"])

        found = narrow.mapInArrow(run, "query_id long, length long, row long, vec_id long, score long")
        order = Window.partitionBy("query_id", "length", "row").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            ranked = staged(ranked, "topk-block")
            held.unpersist()
        best.append(ranked)
    return reduce(DataFrame.union, best)


def digest(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
