"""Benchmark decontamination by a positional inverted index that is partitioned by document.

Each piece of documents (a few MB of text) becomes a segment of the index: for every word that the benchmark knows, the sorted list of
positions where it stands. A phrase is looked up from the word that is rarest in that segment: that word's list,
less its offset, gives the candidate starts, and they are intersected with the lists of the other words, less theirs, from the next rarest to the
commonest. What is left in all lists is an exact occurrence. Lists never leave their segment, so neither a common
word nor a hot source makes a large group, and a lost executor costs only its own pieces. `build_index` stores the segments as a table and
`search_index` reads nothing else: so the benchmark may be searched for again, or by near words (`proximity`), without the texts. Where rows of documents
are wanted with what was found (`decontaminate`, `clean`), segments are built and searched in one pass.

Phrases are broadcast in blocks of at most BLOCK_BYTES of text (an item that is longer makes a block of its own); a larger benchmark takes
a pass a block.

Null, empty and wordless texts: no words, nothing found. Texts of any length are indexed whole. Empty tables give no rows, an empty benchmark finds
nothing. Null item ids are items like any other ("null" in lists). Repeated document rows are answered row by row; repeated item ids are
one item; ties don't arise. Columns of the input other than those named are passed through by `decontaminate` and clash with nothing of its own but its results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, pieces, staged

BLOCK_BYTES = 2 << 20
#: Lower-cases A-Z and turns ASCII that is no letter or digit into spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Phrases:
    """Distinct phrases of a benchmark block as rows of word numbers, by length, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        at = {x: i for i, x in enumerate(self.names)}
        rows: dict[int, list[np.ndarray]] = {}
        for name, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], np.int32)
            if len(ids):
                windows = np.lib.stride_tricks.sliding_window_view(ids, min(n, len(ids)))
                rows.setdefault(windows.shape[1], []).append(np.concatenate([windows, np.full((len(windows), 1), at[name], np.int32)], axis=1))
        self.groups = []
        for _, found in sorted(rows.items()):
            every = np.unique(np.concatenate(found), axis=0)  # by phrase, then item
            new = np.concatenate([[True], (every[1:, :-1] != every[:-1, :-1]).any(axis=1)])
            self.groups.append((every[new, :-1], np.append(np.flatnonzero(new), len(every)), every[:, -1].astype(np.int64)))


class Segment:
    """Positions by word of a run of documents, one place being left free between two of them."""

    def __init__(self, ends: np.ndarray, first: np.ndarray, positions: np.ndarray):
        self.ends, self.first, self.positions = ends, first, positions  # of documents; of each word's list, and the lists
        self.count, self.size = np.diff(first), int(ends[-1]) if len(ends) else 0
        self.keys = np.repeat(np.arange(len(self.count)), self.count) * (self.size + 1) + positions  # all lists, one after another: ascending

    @classmethod
    def of(cls, texts: list[bytes], number: dict[bytes, int]) -> Segment:
        get, ids, ends = number.get, [], []
        for t in texts:
            ids.extend([get(w, -1) for w in words(t)])
            ids.append(-1)
            ends.append(len(ids))
        every = np.array(ids, np.int32)
        known = np.flatnonzero(every >= 0)
        positions = known[np.argsort(every[known], kind="stable")]
        return cls(np.array(ends, np.int64), np.concatenate([[0], np.cumsum(np.bincount(every[known], minlength=len(number)))]), positions)

    @property
    def n_words(self) -> list[int]:
        return (np.diff(self.ends, prepend=0) - 1).tolist()

    def in_list(self, word: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its word."""
        key = word.astype(np.int64) * (self.size + 1) + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def find(self, phrases: np.ndarray, most: int = 1_000_000):
        """(start, phrase) arrays of all exact occurrences, from blocks of at most about `most` candidates."""
        tf = self.count[phrases]
        phrases_at = np.flatnonzero(tf.min(axis=1) > 0)
        if not len(phrases_at):
            return
        order = np.argsort(tf[phrases_at], axis=1, kind="stable")
        rare = order[:, 0]
        word = phrases[phrases_at, rare]
        begin, count = self.first[word], self.count[word]
        total = np.cumsum(count)
        at = 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
            c = count[at:to]
            row = np.repeat(np.arange(at, to), c)
            start = self.positions[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[at:to], c)] - rare[row]
            fits = (start >= 0) & (start + phrases.shape[1] <= self.size)
            row, start = row[fits], start[fits]
            for k in range(1, phrases.shape[1]):
                offset = order[row, k]
                same = self.in_list(phrases[phrases_at[row], offset], start + offset)
                row, start = row[same], start[same]
            yield start, phrases_at[row]
            at = to


def search(index: Segment, phrases: Phrases):
    """By document: its number of words, its hit intervals [(from, to)] in words, names of items found."""
    size = index.size + 1
    depth, found = np.zeros(size, np.int64), [np.zeros(0, np.int64)]
    for rows, first, items in phrases.groups:
        for start, phrase in index.find(rows):
            depth += np.bincount(start, minlength=size) - np.bincount(start + rows.shape[1], minlength=size)
            n = first[phrase + 1] - first[phrase]
            item = items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[phrase], n)]
            found.append(np.unique(np.repeat(np.searchsorted(index.ends, start, side="right"), n) * len(phrases.names) + item))
    hit = np.concatenate([[False], np.cumsum(depth)[:-1] > 0, [False]])
    edges = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
    doc = np.searchsorted(index.ends, edges[:, 0], side="right")
    spans: list[list[tuple[int, int]]] = [[] for _ in index.ends]
    for d, (a, b) in zip(doc.tolist(), edges.tolist(), strict=True):
        base = int(index.ends[d - 1]) if d else 0
        spans[d].append((a - base, b - base))
    names: list[list[str]] = [[] for _ in index.ends]
    for x in np.unique(np.concatenate(found)).tolist():
        names[x // len(phrases.names)].append(phrases.names[x % len(phrases.names)])
    return index.n_words, spans, names


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hits", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
ARROW = [pa.field("n_words", pa.int64()), pa.field("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.field("items", pa.list_(pa.string()))]


def _blocks(benchmark: DataFrame, n: int, item_col: str):
    """The benchmark's phrases, block by block."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null")
    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + len(r.text) > BLOCK_BYTES:
            yield Phrases(held, n)
            held, size = [], 0
        held.append((r.item, bytes(r.text)))
        size += len(r.text)
    yield Phrases(held, n)


def build_index(docs: DataFrame, number: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index, a row a segment: ids and ends of its documents, and for the words that occur their numbers, how many positions
    each has, and the positions, word by word."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(number)
    fields = [("ends", pa.list_(pa.int64())), ("word", pa.list_(pa.int32())), ("count", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))]

    def run(batches):
        for x in pieces(batches, 1):
            found = Segment.of(as_bytes(x.column(1)), held.value)
            word = np.flatnonzero(found.count)
            values = [found.ends, word, found.count[word], found.positions]
            ids = pa.ListArray.from_arrays(pa.array([0, x.num_rows], pa.int32()), x.column(0))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([v], t) for v, (_, t) in zip(values, fields, strict=True))], names=["ids", *(n for n, _ in fields)])

    kind = narrow.schema["id"].dataType.simpleString()
    return staged(narrow.mapInArrow(run, f"ids array<{kind}>, ends array<long>, word array<int>, count array<int>, positions array<int>"), "decontaminate-index")


def search_index(index: DataFrame, phrases: Phrases, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_words, hits, items) of all documents of a stored index whose words the phrases number alike."""
    held = index.sparkSession.sparkContext.broadcast(phrases)
    kind = index.schema["ids"].dataType.elementType

    def run(batches):
        for x in batches:
            for i in range(x.num_rows):
                ids, ends, word, count, positions = (c[i].values for c in x.columns)
                every = np.zeros(len(held.value.number), np.int64)
                every[word.to_numpy()] = count.to_numpy()
                segment = Segment(ends.to_numpy(), np.concatenate([[0], np.cumsum(every)]), positions.to_numpy().astype(np.int64))
                n_words, spans, names = search(segment, held.value)
                hits = [[{"start": s, "end": e} for s, e in y] for y in spans]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, f.type) for v, f in zip((n_words, hits, names), ARROW, strict=True))], names=[id_col, *(f.name for f in ARROW)])

    return index.mapInArrow(run, T.StructType([T.StructField(id_col, kind), *FOUND]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs with n_words, hits (intervals of words that occurrences of the benchmark's n-word windows cover;
    a shorter item is one window) and items (ids as strings, sorted). Columns of docs with these names give way."""
    spark = docs.sparkSession
    df = docs.drop(*[f.name for f in FOUND])
    own = df.columns
    at, more = own.index(text_col), False
    for block in _blocks(benchmark, n, item_col):
        if more:
            df = staged(df, "decontaminate")
        phrases = spark.sparkContext.broadcast(block)

        def run(batches, phrases=phrases, more=more):
            for x in pieces(batches, at):
                n_words, spans, names = search(Segment.of(as_bytes(x.column(at)), phrases.value.number), phrases.value)
                if more:
                    spans = [merged(s, [(y["start"], y["end"]) for y in old]) for s, old in zip(spans, x.column(len(own) + 1).to_pylist(), strict=True)]
                    names = [sorted({*s, *old}) for s, old in zip(names, x.column(len(own) + 2).to_pylist(), strict=True)]
                hits = [[{"start": s, "end": e} for s, e in y] for y in spans]
                arrays = [pa.array(v, f.type) for v, f in zip((n_words, hits, names), ARROW, strict=True)]
                fields = [x.schema.field(i) for i in range(len(own))]
                yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(len(own))), *arrays], schema=pa.schema([*fields, *ARROW]))

        df = df.mapInArrow(run, T.StructType([*docs.select(*own).schema.fields, *FOUND]))
        more = True
    return df


def find_in_index(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id_col, n_words, hits, items), a row a row of docs, by way of a stored index of the benchmark's words. Where the benchmark takes several
    blocks, whose finds must meet by row though ids may repeat, `decontaminate` does it pass by pass."""
    blocks = _blocks(benchmark, n, item_col)
    first = next(blocks)
    if next(blocks, None) is not None:
        return decontaminate(docs.select(F.col(id_col), F.col(text_col)), benchmark, n, text_col, item_col).drop(text_col)
    return search_index(build_index(docs, first.number, id_col, text_col), first, id_col)


def _n_hit() -> str:
    return "aggregate(hits, 0L, (a, h) -> a + h.end - h.start)"


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_in_index(docs, benchmark)
    return found.select(
        "doc_id", "n_words", F.expr(_n_hit()).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any window of the benchmark."""
    return decontaminate(docs, benchmark).where("size(hits) = 0").select(*docs.columns)


def proximity(docs: DataFrame, terms: list[str], within: int, text_col: str = "text") -> DataFrame:
    """docs whose text holds all terms inside some `within` consecutive words, with the first such place's start:
    every place starts at a posting of the list whose offset-adjusted heads lag behind, as in a merge of the lists."""
    number = {w: i for i, w in enumerate(dict.fromkeys(x for t in terms for x in words(t.encode())))}
    at = docs.columns.index(text_col)

    def run(batches):
        for x in pieces(batches, at):
            out = []
            for t in as_bytes(x.column(at)):
                index = Segment.of([t], number)
                lists = [index.positions[index.first[i] : index.first[i + 1]] for i in range(len(number))]
                out.append(nearest(lists, within))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out, pa.int64())], schema=x.schema.append(pa.field("start", pa.int64())))

    return docs.drop("start").mapInArrow(run, T.StructType([*docs.drop("start").schema.fields, T.StructField("start", T.LongType())])).where("start is not null")


def nearest(lists: list[np.ndarray], within: int) -> int | None:
    if not lists or min(map(len, lists)) == 0:
        return None
    starts = np.unique(np.concatenate(lists))
    ends = starts.copy()
    whole = np.ones(len(starts), bool)
    for x in lists:
        at = np.searchsorted(x, starts)
        whole &= at < len(x)
        ends = np.maximum(ends, x[np.minimum(at, len(x) - 1)])
    good = np.flatnonzero(whole & (ends - starts < within))
    return int(starts[good[0]]) if len(good) else None


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS w
    FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
    SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
    FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN win ON dw.w = win.w AND dw.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
