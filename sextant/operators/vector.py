"""The vector ranker over stored embeddings, and embedding itself from a token table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

E = F.expr


#: Vectors that are multiplied at once, rows that are handed on at once, and digits of a score.
ROWS, OUT_ROWS, DIGITS = 256, 1 << 17, 6


def matrices(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
    """(length, rows, matrix) of a list column's vectors by length; nulls and vectors that hold one are at -1, without a matrix."""
    n = len(column)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    if flat.null_count:
        owner = np.repeat(np.arange(n), np.maximum(lengths, 0))
        bad = np.unique(owner[np.asarray(flat.is_null())])
        flat = pc.take(flat, pa.array(np.flatnonzero(~np.isin(owner, bad))))
        lengths[bad] = -1
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    out: list[tuple[int, np.ndarray, np.ndarray | None]] = []
    for m in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == m)
        out.append((m, rows, values[starts[rows][:, None] + np.arange(m)] if m >= 0 else None))
    return out


def rounded(products: np.ndarray, doubt: np.ndarray | float, again: Callable[..., np.ndarray]) -> np.ndarray:
    """Products rounded as the oracles' engine does it: half away from zero of the scaled double. A sum that lies so near a half that the order
    of adding could tell (`doubt`) is added again in order, by `again` of its places."""
    scaled = products * 10.0**DIGITS
    whole = np.trunc(scaled)
    rest = np.abs(scaled - whole)
    with np.errstate(invalid="ignore"):
        near = np.nonzero(np.abs(rest - 0.5) <= doubt * 10.0**DIGITS + 4.0 * np.spacing(np.abs(scaled)))
    if len(near[0]):
        scaled[near] = again(*near) * 10.0**DIGITS
        whole[near] = np.trunc(scaled[near])
        rest[near] = np.abs(scaled[near] - whole[near])
    return (whole + np.copysign(rest >= 0.5, scaled)) / 10.0**DIGITS


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component on."""
    return np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def error(x: np.ndarray) -> np.ndarray:
    """By row, a share of the bound on what the order of adding changes: the product of two rows' shares is the bound."""
    return np.sqrt(4.0 * np.finfo(np.float64).eps * (x.shape[1] + 1) * (x * x).sum(axis=1))


class Asked:
    """A block of queries (qid, qv) as tasks get it: bounded, see `in_blocks`."""

    def __init__(self, queries: DataFrame):
        table = queries.select("qid", "qv").toArrow().combine_chunks()
        self.kind = queries.schema["qid"].dataType.simpleString()
        self.n = len(table)
        self.ids = table.column("qid").combine_chunks() if self.n else pa.array([], table.schema.field("qid").type)
        self.by_length = {m: (rows, x) for m, rows, x in matrices(table.column("qv").combine_chunks())} if self.n else {}


def products(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, vectors' columns, score) of all pairs of vectors (..., embedding) and a block of queries (qid, qv); without a score if either is
    null or holds one, or their lengths differ. The pairs are the result, so it grows with both; a task holds some thousands at a time."""
    rest = [c for c in vectors.columns if c != "embedding"]
    asked = Asked(queries)
    held = vectors.sparkSession.sparkContext.broadcast(asked)
    schema = ", ".join([f"qid {asked.kind}", *(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in rest), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        for batch in batches:
            step = max(1, min(ROWS, OUT_ROWS // max(1, q.n)))
            for at in range(0, batch.num_rows if q.n else 0, step):
                part = batch.slice(at, step)
                score, known = np.zeros((part.num_rows, q.n)), np.zeros((part.num_rows, q.n), bool)
                for m, rows, x in matrices(part.column(part.num_columns - 1)):
                    if m >= 0 and m in q.by_length:
                        own, y = q.by_length[m]
                        score[np.ix_(rows, own)] = rounded(x @ y.T, error(x)[:, None] * error(y)[None, :], lambda i, j, x=x, y=y: in_order(x[i], y[j]))
                        known[np.ix_(rows, own)] = True
                i, j = pa.array(np.repeat(np.arange(part.num_rows), q.n)), pa.array(np.tile(np.arange(q.n), part.num_rows))
                yield pa.RecordBatch.from_arrays([q.ids.take(j), *(c.take(i) for c in part.columns[:-1]), pa.array(score.ravel(), mask=None if known.all() else ~known.ravel())], names=["qid", *rest, "score"])

    return vectors.select(*rest, "embedding").mapInArrow(run, schema)


def search(vectors: DataFrame, queries: DataFrame, floor: float = 0.25, most: int | None = 32) -> DataFrame:
    """(qid, id, path, score, rank) of vectors (id, path, embedding) for queries (qid, qv): scores of floor or more, best first. Queries
    are a batch of a bounded number; each task keeps its own best before they are ranked."""
    asked = Asked(queries)
    held = vectors.sparkSession.sparkContext.broadcast(asked)
    schema = f"place int, id {vectors.schema['id'].dataType.simpleString()}, path {vectors.schema['path'].dataType.simpleString()}, score double"

    def best(found: list[pa.Table]) -> pa.Table:
        """The best of each place so far; NaN is the highest score, as it is to Spark and to SQL."""
        table = pa.concat_tables(found).combine_chunks()
        nan = pc.cast(pc.is_nan(table.column("score")), pa.int8())
        order = pc.sort_indices(table.append_column("nan", nan), [("place", "ascending"), ("nan", "descending"), ("score", "descending"), ("id", "ascending")])
        table = table.take(order)
        place = table.column("place").to_numpy()
        return table.filter(pa.array(np.arange(len(place)) - np.searchsorted(place, place) < most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        found, size, least = [], 0, np.full(q.n, -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows if q.n else 0, ROWS):
                part = batch.slice(at, ROWS)
                for m, rows, x in matrices(part.column(2)):
                    if m < 0 or m not in q.by_length:
                        continue
                    own, y = q.by_length[m]
                    raw = x @ y.T
                    i, j = np.nonzero(~(raw < np.maximum(floor, least[own])[None, :] - 2 * 10.0**-DIGITS))  # some that rounding lifts are in, too
                    score = rounded(raw[i, j], error(x)[i] * error(y)[j], lambda k, x=x, y=y, i=i, j=j: in_order(x[i[k]], y[j[k]]))
                    good = ~(score < floor)
                    i, j, score = i[good], j[good], score[good]
                    at_rows = pa.array(rows[i])
                    hits = pa.table({"place": pa.array(own[j], pa.int32()), "id": part.column(0).take(at_rows), "path": part.column(1).take(at_rows), "score": score})
                    found.append(hits)
                    size += len(hits)
                    if most is None:
                        yield from found.pop().to_batches()
                    elif size > OUT_ROWS + 2 * most * q.n:
                        found = [best(found)]
                        size = len(found[0])
                        place, score = found[0].column("place").to_numpy(), found[0].column("score").to_numpy()
                        last = np.flatnonzero(np.arange(size) - np.searchsorted(place, place) == most - 1)
                        least[place[last]] = np.nan_to_num(score[last], nan=np.inf)
        if most is not None and found:
            yield from best(found).to_batches()

    hit = vectors.select("id", "path", "embedding").mapInArrow(run, schema)
    places = vectors.sparkSession.createDataFrame([(i, v) for i, v in enumerate(asked.ids.to_pylist())], f"place int, qid {asked.kind}")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    out = hit.join(F.broadcast(places), "place").select("qid", "id", "path", "score").withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most) if most else out


def in_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame], most: int = 4096) -> DataFrame:
    """A search of any number of queries (qid, ...), of about `most` at a time, as each block is broadcast."""
    n = -(-queries.count() // most) or 1
    return reduce(DataFrame.unionByName, [search(queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i)) for i in range(n)])


def collapse(hits: DataFrame) -> DataFrame:
    """(qid, path, score, hits, ids): the best chunk's score, .04 more for each further hit up to three."""
    order = F.array_sort(F.collect_list(F.struct("rank", "id")))
    out = hits.groupBy("qid", "path").agg(F.max("score").alias("best"), F.count("*").alias("hits"), order.alias("o"))
    return out.select("qid", "path", E("least(1.0D, best + 0.04D * least(3, hits - 1))").alias("score"), "hits", E("transform(slice(o, 1, 3), x -> x.id)").alias("ids"))


def word_pieces(word: str, vocabulary: dict[str, int], unknown: int) -> list[int]:
    """Greedy longest match, ## for what continues a word; one unknown for a word that has no pieces or over 100 letters."""
    out: list[int] = []
    at = 0
    if len(word) > 100:
        return [unknown]
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(vocabulary[piece])
                at = end
                break
        else:
            return [unknown]
    return out


def embedder(spark, vocabulary: dict[str, int], matrix: np.ndarray, unknown: int = 0):
    """A pandas UDF from arrays of words to mean-pooled vectors of length one; vocabulary and matrix (a model of fixed size) are broadcast."""
    held = spark.sparkContext.broadcast((vocabulary, matrix.astype(np.float32)))

    @pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary, matrix = held.value
        for words in batches:
            rows = []
            for ws in words:
                ids = [i for w in (ws if ws is not None else ()) for i in word_pieces(w, vocabulary, unknown)]
                v = matrix[ids].mean(axis=0) if ids else np.zeros(matrix.shape[1], np.float32)
                n = float(np.linalg.norm(v))
                rows.append((v / (n or 1.0)).astype(np.float32))
            yield pd.Series(rows)

    return embed


def split_units(df: DataFrame, most_lines: int = 60, most_chars: int = 4000) -> DataFrame:
    """(key, unit, body): texts cut into units of at most so many lines and characters; a longer line is cut inside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, body in zip(pdf["key"], pdf["text"], strict=True):
                units: list[list[str]] = [[]]
                size = 0
                for line in (body or "").split("\n"):
                    for part in [line[i : i + most_chars] for i in range(0, max(1, len(line)), most_chars)]:
                        if units[-1] and (len(units[-1]) >= most_lines or size + len(part) + 1 > most_chars):
                            units.append([])
                            size = 0
                        units[-1].append(part)
                        size += len(part) + 1
                rows += [(key, i, "\n".join(u)) for i, u in enumerate(units)]
            yield pd.DataFrame(rows, columns=["key", "unit", "body"])

    kind = df.schema["key"].dataType.simpleString()
    return df.select("key", "text").mapInPandas(run, f"key {kind}, unit int, body string")
