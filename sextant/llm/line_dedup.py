"""Line dedup by two Bloom filters: slots seen once and slots seen twice.

First pass: each task notes, for the keys of its lines, which slots of a bit array it sees once and which in two
documents or more, and hands on those bit arrays in compressed pieces. They are merged piece by piece: a slot that two
tasks saw is seen twice. A repeated key has all its slots in the twice filter; the reverse may be wrong. Second
pass: only keys whose slots are all seen twice shuffle, as 128-bit fingerprints with the document, for the exact
count and the choice of the document that keeps the line. Third: the lines go.

The filter has BITS_A_ROW bits a document, MOST_BITS at most (32 MB, the size of what is broadcast): a fuller filter only lets
more keys shuffle, 16 bytes each, and their count is still exact. The list of repeated keys is broadcast up to MOST_KEYS rows (12 MB). Beyond that,
the lines that go are joined to their documents; only documents that a filter of those with such lines holds are shuffled, the rest pass where they are read.

Null and empty texts are one empty line, and stay what they are; an empty table gives no rows; texts and lines of any length are whole. A null doc_id doesn't count as a
document and holds no line. Rows with the same doc_id are one document: it counts once, and its lines stay or go in all its rows; so do rows
without a doc_id that have the same text. No two documents tie for a line. Extra columns pass through, whatever their names, but
n_lines and n_dropped give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bit_filter, fresh, held_by, pieces, seen_twice, staged

BITS_A_ROW, MOST_BITS, LEAST_BITS = 160, 1 << 28, 1 << 16
MOST_KEYS = 500_000
SPACE = b" \t\n\x0b\x0c\r"


def fingerprint(line: bytes, least: int) -> bytes | None:
    """Of the line's key; None if it has fewer than `least` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def prints_of(text: bytes, least: int) -> list[bytes]:
    """Fingerprints of the distinct keys of a text's lines."""
    return list({p for line in text.split(b"\n") if (p := fingerprint(line, least))})


def first_halves(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.int64)[::2]


def row_key(id_col: str, text_col: str):
    """The document a row belongs to; rows without an id are told apart by their text (128 bits)."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("n"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def key_hashes(batches):
    """64-bit hashes of a string column's values, for a filter."""
    for x in batches:
        yield np.array([xxhash.xxh3_64_intdigest(v) for v in as_bytes(x.column(0))], np.uint64).view(np.int64)


def repeated_keys(docs: DataFrame, least: int, in_docs: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, keep): fingerprints found in at least in_docs documents, with the largest id; and the suspects (h1, h2, id)."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("rid"))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(max(1, docs.count() * BITS_A_ROW) - 1).bit_length()))

    def hashes(batches):
        for x in pieces(batches, 1):
            held = [first_halves(own) for t in as_bytes(x.column(1)) if (own := prints_of(t, least))]
            if held:
                yield np.concatenate(held)

    seen = spark.sparkContext.broadcast(seen_twice(narrow, hashes, bits))

    def suspect(batches):
        flags = np.frombuffer(seen.value, np.uint8)
        for x in pieces(batches, 1):
            prints, rows = [], []
            for row, t in enumerate(as_bytes(x.column(1))):
                own = prints_of(t, least)
                prints += own
                rows += [row] * len(own)
            if not prints:
                continue
            hit = held_by(flags, first_halves(prints))
            h = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)[hit]
            own = pa.array(np.array(rows, np.int64)[hit])
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), x.column(0).take(own), x.column(2).take(own)], names=["h1", "h2", "id", "rid"])

    suspects = narrow.mapInArrow(suspect, "h1 long, h2 long, id long, rid string").distinct()
    keys = suspects.groupBy("h1", "h2").agg(F.count("id").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= in_docs)
    return keys.select("h1", "h2", "keep"), suspects


OUT = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]


def dedup_lines(docs: DataFrame, least: int = 40, in_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut, n_lines (before) and n_dropped; columns of docs with these names give way.
    A line whose key (trimmed, A-Z lower-cased) has `least` code points and is in in_docs documents stays only in the largest id."""
    df = docs.drop("n_lines", "n_dropped")
    keys, suspects = repeated_keys(df, least, in_docs, id_col, text_col)
    keys = staged(keys, "line-keys")
    columns, schema = df.columns, T.StructType([*df.schema.fields, *OUT])
    at, id_at = columns.index(text_col), columns.index(id_col)

    def cut(x, goes):
        texts, n_lines, n_dropped = [], [], []
        for row, t in enumerate(as_bytes(x.column(at))):
            lines = t.split(b"\n")
            stay = [line for line in lines if not goes(row, line)]
            texts.append(b"\n".join(stay))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        arrays = list(x.columns)[: len(columns)]
        arrays[at] = pa.array(texts, pa.binary(), mask=np.asarray(x.column(at).is_null())).cast(arrays[at].type)  # null stays null
        fields = [pa.field(f.name, f.type, True, f.metadata) for f in list(x.schema)[: len(columns)]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema=pa.schema([*fields, pa.field("n_lines", pa.int64()), pa.field("n_dropped", pa.int64())]))

    if keys.count() <= MOST_KEYS:
        rows = keys.toArrow()
        prints = np.stack([rows.column("h1").to_numpy(), rows.column("h2").to_numpy()], axis=1).astype(np.int64).tobytes()
        held = df.sparkSession.sparkContext.broadcast((prints, rows.column("keep").to_numpy()))

        def by_broadcast(batches):
            prints, keep = held.value
            keeper = {prints[16 * i : 16 * i + 16]: k for i, k in enumerate(keep.tolist())}
            for x in pieces(batches, at):
                ids = x.column(id_at).to_pylist()
                yield cut(x, lambda row, line: (p := fingerprint(line, least)) is not None and (k := keeper.get(p)) is not None and k != ids[row])

        return df.mapInArrow(by_broadcast, schema)

    goes = suspects.join(keys, ["h1", "h2"]).where("id is null or id <> keep").groupBy("rid").agg(F.collect_set(F.struct("h1", "h2")).alias("goes"))
    goes = staged(goes, "line-goes")  # a document's lines, so no group is larger than a document
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * goes.count()).bit_length()))
    marked = df.sparkSession.sparkContext.broadcast(bit_filter(goes.select("rid"), bits, key_hashes))
    (rid,) = fresh(df.columns, "rid")
    keyed = df.withColumn(rid, row_key(id_col, text_col))

    def hits(x):
        return held_by(np.frombuffer(marked.value, np.uint8), next(key_hashes([x.select([rid])])))

    def whole(batches):
        for x in pieces(batches, at):
            hit = hits(x)
            if not hit.all():
                yield cut(x.filter(pa.array(~hit)), lambda row, line: False)

    def looked_at(batches):
        for x in pieces(batches, at):
            hit = hits(x)
            if hit.any():
                yield x.filter(pa.array(hit))

    def by_join(batches):
        for x in pieces(batches, at):
            goes = [{np.array([y["h1"], y["h2"]], np.int64).tobytes() for y in v or ()} for v in x.column(len(columns)).to_pylist()]
            yield cut(x, lambda row, line: bool(goes[row]) and fingerprint(line, least) in goes[row])

    wide = keyed.mapInArrow(looked_at, keyed.schema)
    wide = wide.join(goes.toDF("goes_rid", "goes_lines"), wide[rid] == F.col("goes_rid"), "left").select(*[wide[c] for c in columns], F.col("goes_lines").alias(rid))
    return keyed.mapInArrow(whole, schema).union(wide.mapInArrow(by_join, schema))


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
    SELECT doc_id, i, ls[i] AS line,
        translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
r AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (r.k IS NOT NULL AND doc_id <> keep) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.k IS NULL OR doc_id = keep), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.k = r.k GROUP BY doc_id
"""
