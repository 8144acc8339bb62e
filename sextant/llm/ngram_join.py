"""Near duplicates by exact Jaccard similarity of word n-gram sets: a blocked sparse matrix product.

Rows of the incidence matrix are distinct sets (copies are one row), columns are n-grams. Overlap counts are the
entries of the matrix times its transpose, and only entries that can reach the size-derived bound are computed:

1. A pair with similarity t shares at least t times the larger size. With columns ordered from rare to common, it
   must then share one of the first n - ceil(t n) + 1 columns of each row, so only those columns are multiplied. The order
   comes from a sketch of column counts over all documents; any order is right, a rare-first one is fast.
2. Where the first shared column stands in both rows bounds the overlap from above; pairs below the bound are discarded. So are those
   whose parities (512 bits a row) differ in more places than the sizes allow the sets to differ.
3. For the rest, overlap counts are accumulated over blocks of columns and given up once they cannot reach the bound.

A column that many rows share would make the square of them. So each column first links its rows to one hub (the
row that has the fewest rarer columns); then only pairs from different components are multiplied, and of a
column's rows only those outside its hub's component against the others. Pairs inside a component need no check for that, as
they change nothing: components come out exact. No step gathers a column's rows in one task: counts and hubs are partial
aggregates, and the joins are such as Spark splits by skew.

The number of links then comes from the product inside each component. Its rows are dealt into bands of size (a link spans two
neighbouring bands at most) and, in a band, into blocks of bounded rows and n-grams; a task multiplies two blocks, columns by
columns, discards pairs that fall below their bounds, and gives a number for each row, never the pairs. A link counts the copies of the other text.

Words are runs of non-space after lower-casing A-Z. A document with fewer words than n has its whole sequence as one n-gram; one
without words has an empty set and links with nothing. Null texts count as empty; texts of any length are whole; an empty table gives no rows. Rows that
repeat a doc_id are rows of their own; ties don't matter to components; extra columns aren't looked at. Null ids take part and get the least id
of their component, or null. n-grams are compared by 64-bit hashes, sets by 64-bit
hashes and their sizes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bit_filter, components, dropped, fresh, held_by, merged_by, mixed, pieces, staged

#: Slots of the sketch of column counts (4 bytes each, broadcast), its pieces, and the most bits of a document filter.
SLOTS, CHUNKS, MOST_BITS = 1 << 21, 64, 1 << 27
#: Rows of a column in one task, beyond twice the mean count of the sketch's slots.
HOT = 4096
BLOCKS = 4
#: Rows and n-grams of a block in the product inside a component, and columns that are multiplied at once.
BLOCK_ROWS, BLOCK_GRAMS, COLUMNS = 1024, 1 << 18, 4096
PARITY = 8
PARITY_BITS = 9


BITS = [f"b{i}" for i in range(PARITY)]


def ngrams(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(h))
    m = len(h) - width + 1
    x = h[:m] + np.uint64(width)
    for j in range(1, width):
        x = mixed(x) + h[j : j + m]
    return np.unique(mixed(x))


def parity(grams: np.ndarray) -> np.ndarray:
    """PARITY words of bits, each the parity of the n-grams that fall on it: two sets' bits differ in no more places than the sets do."""
    bits = np.bincount((grams >> np.uint64(64 - PARITY_BITS)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def set_key(grams: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(grams.tobytes())], np.uint64).view(np.int64)[0])


def _measured(docs: DataFrame, n: int) -> DataFrame:
    """Rows (id, n, key) of documents, and rows (chunk, counts) of the tasks' sketches."""
    size = SLOTS // CHUNKS

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), *((b, pa.int64()) for b in BITS), ("chunk", pa.int32()), ("counts", pa.binary())])
        for x in pieces(batches, 1):
            sizes, keys, bits, held = [], [], [], []
            for t in as_bytes(x.column(1)):
                g = ngrams(t, n)
                sizes.append(len(g))
                keys.append(set_key(g) if len(g) else None)
                bits.append(parity(g))
                held.append((g & np.uint64(SLOTS - 1)).astype(np.int64))
            counts += np.bincount(np.concatenate(held), minlength=SLOTS)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *map(pa.array, np.array(bits).T), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        packed = np.minimum(counts, 65535).astype(np.uint16).reshape(CHUNKS, size)
        none = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, *[none] * PARITY, pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in packed], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "id long, n long, key long, " + "".join(f"{b} long, " for b in BITS) + "chunk int, counts binary")


def _sketch(measured: DataFrame) -> np.ndarray:
    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for x in batches:
            for c, counts in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                held.setdefault(c, np.zeros(SLOTS // CHUNKS, np.uint32))[:] += np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint16)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint32)
    for r in merged_by(measured.where("chunk is not null").select("chunk", "counts"), merge, "chunk int, counts binary"):
        out[r.chunk] = np.frombuffer(bytes(r.counts), np.uint32)
    return out.ravel()


def _prefixes(docs: DataFrame, n: int, num: int, den: int, sketch) -> DataFrame:
    """(gram, part, hot, key, n, pos): the first columns of each set, rare ones first; a hot column's rows are in several parts. A
    task gives a set once; several tasks may give the same one."""

    def run(batches):
        counts, seen = sketch.value.astype(np.int64), set()
        allowed = 2 * int(counts.mean())
        for x in pieces(batches, 1):
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for t in as_bytes(x.column(1)):
                g = ngrams(t, n)
                if not len(g) or (key := set_key(g)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                p = len(g) - -(-num * len(g) // den) + 1
                c = counts[(g & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((g, c))[:p]
                parts = 1 + np.maximum(c[order] - allowed, 0) // HOT
                for column, v in zip(columns, (g[order].view(np.int64), key % parts, parts > 1, np.full(p, key), np.full(p, len(g)), np.arange(p)), strict=True):
                    column.append(v)
            if columns[0]:
                a, b, c, d, e, f = map(np.concatenate, columns)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int32)), pa.array(c), pa.array(d), pa.array(e.astype(np.int32)), pa.array(f.astype(np.int32))], names=["gram", "part", "hot", "key", "n", "pos"])

    return docs.mapInArrow(run, "gram long, part int, hot boolean, key long, n int, pos int")


def _columns(prefixes: DataFrame) -> list[DataFrame]:
    """Staged rows (gram, key, n, pos, hub) of the columns that several sets share; hub: the row (pos, n, key) with the fewest rarer columns."""
    row = F.struct("pos", "n", "key")
    ordered = Window.partitionBy("gram", "part").orderBy("pos", "n", "key")
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = prefixes.select("*", F.first(row).over(every).alias("hub"), F.last("key").over(every).alias("_last"), F.lag("key").over(ordered).alias("_before"))
    dealt = staged(dealt.where("not (_before <=> key) and (hot or _last <> hub.key)").select("gram", "key", "n", "pos", "hot", "hub"), "ngram-columns")
    hot = dealt.where("hot").drop("hot", "hub")
    hubs = dealt.where("hot").groupBy("gram").agg(F.count("*").alias("k"), F.min("hub").alias("hub")).where("k > 1").drop("k")
    return [dealt.where("not hot").drop("hot"), staged(hot.join(hubs, "gram"), "ngram-hot")]


def _bounded(num: int, den: int, a: str, b: str):
    """Whether two rows that first meet in this column can still be similar."""
    small = f"least({a}.n, {b}.n)"
    need = f"ceil(cast({num} as double) * ({a}.n + {b}.n) / {num + den} - 1e-9)"
    return F.expr(f"{den}L * {small} >= {num}L * greatest({a}.n, {b}.n) and 1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) - 1 >= {need}")


def _differ_little(num: int, den: int, a: str, b: str):
    """Whether the parities allow as few differing n-grams as a link does."""
    apart = " + ".join(f"bit_count({a}.{x} ^ {b}.{x})" for x in BITS)
    return F.expr(f"{apart} <= floor(cast({den - num} as double) * ({a}.n + {b}.n) / {num + den} + 1e-9)")


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * intersection >= num * union, counted over blocks of columns and given up as soon as it is out of reach."""
    if len(x) > len(y):
        x, y = y, x
    need = -(-num * (len(x) + len(y)) // (num + den))
    got, cuts = 0, np.linspace(0, len(x), BLOCKS + 1).astype(int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if got + len(x) - a < need:
            return False
        at = np.minimum(np.searchsorted(y, x[a:b]), len(y) - 1)
        got += int((y[at] == x[a:b]).sum())
    return got >= need


def linked(x: list[np.ndarray], y: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """A matrix: which sets of x link with which of y. Overlap counts accumulate over blocks of columns; a pair whose count and remaining
    columns don't reach its bound is discarded, and with its last pair a row."""
    sizes = [np.array([len(g) for g in part], np.int64) for part in (x, y)]
    need = -(-num * np.add.outer(*sizes) // (num + den))
    alive = np.minimum.outer(*sizes) >= need
    counts = np.zeros(alive.shape, np.int64)
    columns = np.intersect1d(np.concatenate(x), np.concatenate(y))
    sides = []
    for part, n in zip((x, y), sizes, strict=True):
        grams, row = np.concatenate(part), np.repeat(np.arange(len(part)), n)
        at = np.searchsorted(columns, grams)
        shared = at < len(columns)
        shared[shared] = columns[at[shared]] == grams[shared]
        at, row = at[shared], row[shared]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], row[order], np.bincount(row, minlength=len(part))))
    left = [rest for _, _, rest in sides]
    for start in range(0, len(columns) + 1, COLUMNS):
        alive &= counts + np.minimum.outer(*left) >= need
        rows = [np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))]
        if not len(rows[0]) or start >= len(columns):
            break
        dense = []
        for s, (at, row, _) in enumerate(sides):
            a, b = np.searchsorted(at, [start, start + COLUMNS])
            block = np.zeros((len(left[s]), min(COLUMNS, len(columns) - start)), np.float32)
            block[row[a:b], at[a:b] - start] = 1
            left[s] = left[s] - np.bincount(row[a:b], minlength=len(left[s]))
            dense.append(block[rows[s]])
        counts[np.ix_(*rows)] += np.rint(dense[0] @ dense[1].T).astype(np.int64)
    return alive & (counts >= need)


def _words(asked: DataFrame, docs: DataFrame, measured: DataFrame, n: int) -> DataFrame:
    """Staged (key, words) of the distinct set keys asked for: their words, compressed. Only documents that a filter holds are shuffled."""
    spark = asked.sparkSession
    holders = measured.where("key is not null").join(asked, "key").groupBy("key").agg(F.min(F.coalesce("id", F.lit(0))).alias("id")).select("id")
    holders = staged(holders, "ngram-holders")
    bits = min(MOST_BITS, max(1 << 12, 1 << (int(holders.count()) * 16).bit_length()))
    kept = spark.sparkContext.broadcast(bit_filter(holders, bits))

    def texts(batches):
        """Of documents that may be asked for: set key and words, compressed (smaller than the set)."""
        flags, pack = np.frombuffer(kept.value, np.uint8), zstandard.ZstdCompressor(level=3)
        for x in pieces(batches, 1):
            at = np.flatnonzero(held_by(flags, np.array([i or 0 for i in x.column(0).to_pylist()], np.int64)))
            keys, words = [], []
            for t in as_bytes(x.column(1).take(pa.array(at))):
                g = ngrams(t, n)
                if len(g):
                    keys.append(set_key(g))
                    words.append(pack.compress(b" ".join(t.lower().split())))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.binary())], names=["key", "words"])

    held = docs.mapInArrow(texts, "key long, words binary").join(asked, "key", "left_semi")
    held = staged(held.groupBy("key").agg(F.first("words").alias("words")), "ngram-words")
    dropped(holders)
    return held


def _verified(pairs: DataFrame, docs: DataFrame, measured: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the staged distinct pairs (a, b) of set keys that are similar."""
    held = _words(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, measured, n)
    wide = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def check(batches):
        unpack, cache = zstandard.ZstdDecompressor(), {}

        def grams(key, words):
            if key not in cache:
                if len(cache) > 200:
                    cache.clear()
                cache[key] = ngrams(unpack.decompress(words), n)
            return cache[key]

        for x in pieces(batches, 2):
            a, b = x.column(0).to_pylist(), x.column(1).to_pylist()
            good = [similar(grams(i, v), grams(j, w), num, den) for i, j, v, w in zip(a, b, x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = staged(wide.mapInArrow(check, "a long, b long"), "ngram-links")
    dropped(held)
    return links


def _link_numbers(docs: DataFrame, sets: DataFrame, found: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Staged (key, links) of the sets in found (key, root): how many documents hold another set that links with it."""
    width = max(math.log(den / num), 1e-6) * (1 + 1e-6)  # a little more, as logarithms are rounded
    own = sets.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("n").alias("n"))
    placed = staged(found.join(own, "key").withColumn("band", F.expr(f"cast(floor(ln(n) / {width!r}D) as int)")), "ngram-bands")
    bands = placed.groupBy("root", "band").agg(F.count("*").alias("k"), F.sum("n").alias("grams"))
    bands = bands.withColumn("parts", F.expr(f"cast(ceil(greatest(k / {BLOCK_ROWS}, grams / {BLOCK_GRAMS})) as int)"))
    bands = bands.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("parts", "k")))).alias("bands"))  # some hundred at most
    dealt = placed.join(bands, "root").withColumn("part", F.expr("cast(pmod(xxhash64(key), bands[band].parts) as int)"))
    cell = "named_struct('low', {}, 'i', {}, 'step', {}, 'j', {})"
    same = f"if(bands[band].k > 1, transform(sequence(0, bands[band].parts - 1), j -> {cell.format('band', 'least(part, j)', 0, 'greatest(part, j)')}), array())"
    above = f"if(bands[band + 1] is not null, transform(sequence(0, bands[band + 1].parts - 1), j -> {cell.format('band', 'part', 1, 'j')}), array())"
    below = f"if(bands[band - 1] is not null, transform(sequence(0, bands[band - 1].parts - 1), j -> {cell.format('band - 1', 'j', 1, 'part')}), array())"
    dealt = dealt.withColumn("cells", F.expr(f"concat({same}, {above}, {below})")).where("size(cells) > 0").select("key", "root", "copies", "band", "part", "cells")
    words = _words(found.select("key"), docs, sets, n)
    cells = dealt.join(words, "key").select("key", "root", "copies", "band", "part", F.explode("cells").alias("c"), "words").select("key", "root", "copies", "band", "part", "c.*", "words")

    def count(cell):
        unpack = zstandard.ZstdDecompressor()
        low, i, step, j = (cell.column(name)[0].as_py() for name in ("low", "i", "step", "j"))
        keys, copies, band, part = (cell.column(name).to_numpy() for name in ("key", "copies", "band", "part"))
        grams = [ngrams(unpack.decompress(w), n) for w in cell.column("words").to_pylist()]
        first = band == low if step else part == i
        second = ~first if step or i != j else first
        a, b = np.flatnonzero(first), np.flatnonzero(second)
        links = np.zeros(len(keys), np.int64)
        if len(a) and len(b):
            hit = linked([grams[r] for r in a], [grams[r] for r in b], num, den)
            if a is not b and not np.array_equal(a, b):
                links[b] += hit.T @ copies[a]
            else:
                np.fill_diagonal(hit, False)
            links[a] += hit @ copies[b]
        return pa.table({"key": keys, "links": links}).filter(pa.array(links > 0))

    numbers = cells.groupBy("root", "low", "i", "step", "j").applyInArrow(count, "key long, links long")
    numbers = staged(numbers.groupBy("key").agg(F.sum("links").alias("links")), "ngram-numbers")
    dropped(placed, words)
    return numbers


def _classes(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Staged (id, n, key) of all rows, and (key, root) of the sets that have links: root is the same for all sets of a component."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    measured = staged(_measured(narrow, n), "ngram-sets")
    sets = measured.where("chunk is null").select("id", "n", "key")
    bits = measured.where("key is not null").groupBy("key").agg(*[F.first(b).alias(b) for b in BITS])
    sketch = spark.sparkContext.broadcast(_sketch(measured))

    cold, hot = _columns(_prefixes(narrow, n, num, den, sketch))
    sketch.unpersist()
    rows = cold.union(hot)

    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    pairs = rows.alias("r").where("key <> hub.key").where(_bounded(num, den, "r", "hub")).select(*ordered(F.col("key"), F.col("hub.key"))).distinct()
    pairs = staged(pairs, "ngram-pairs")
    links = _verified(pairs, narrow, sets, n, num, den)
    found = components(links)

    placed = rows.join(found.toDF("key", "root"), "key", "left").select("gram", "key", "n", "pos", F.coalesce("root", "key").alias("comp"), F.col("hub.key").alias("hub"))
    mixed_columns = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("key") == F.col("hub"), F.col("comp"))).alias("main")).where("lo <> hi").select("gram", "main")
    placed = staged(placed.drop("hub").join(mixed_columns, "gram").join(bits, "key"), "ngram-mixed")
    dropped(cold, hot, found)
    few, every = placed.where("comp <> main").alias("f"), placed.alias("e")
    more = few.join(every, F.expr("f.gram = e.gram and f.comp <> e.comp") & _bounded(num, den, "f", "e") & _differ_little(num, den, "f", "e"))
    more = staged(more.select(*ordered(F.col("f.key"), F.col("e.key"))).distinct().join(pairs, ["a", "b"], "left_anti"), "ngram-pairs")
    dropped(placed, pairs)
    others = _verified(more, narrow, sets, n, num, den)
    found = components(links.union(others))
    dropped(more, links, others)
    return sets, found.toDF("key", "root")


def similar_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, n_links): a row a document, with the least id that links of at least num/den reach and the
    number of other documents that it links with, copies included."""
    sets, found = _classes(docs, n, num, den, id_col, text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    numbers = _link_numbers(narrow, sets, found, n, num, den)
    classes = sets.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    members = staged(found.join(classes, "key"), "ngram-linked")
    least = staged(members.groupBy("root").agg(F.min("least").alias("component_id")), "ngram-roots")
    members = members.join(least, "root").join(numbers, "key", "left").select("key", "component_id", "links")
    links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    classes = staged(classes.join(members, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"), links.alias("n_links")), "ngram-classes")
    out = sets.join(classes, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def digest(docs: DataFrame) -> DataFrame:
    return similar_components(docs)


def first_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of its least id, null last; of several rows with that id one of the least set key. Rows without
    words stay. Only rows whose ids a filter of ids to drop (or of repeated or null ones) holds are shuffled; the rest pass where they are read."""
    spark = docs.sparkSession
    sets, found = _classes(docs, n, num, den, id_col, text_col)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    placed = staged(sets.join(found, "key", "left").select("id", "key", F.coalesce("root", "key").alias("root")), "ngram-placed")
    worded = placed.where("key is not null")
    best = staged(worded.groupBy("root").agg(F.min(place).alias("best")).select("best.id", "best.key"), "ngram-best").withColumn("first", F.lit(True))
    placed = placed.join(best, placed["id"].eqNullSafe(best["id"]) & (placed["key"] == best["key"]), "left").select(placed["id"], placed["key"], (F.col("first") | placed["key"].isNull()).alias("stays"))
    ids = placed.groupBy("id").agg(F.count("*").alias("k"), F.bool_or(F.coalesce("stays", F.lit(False))).alias("stays"))
    special = staged(ids.where("k > 1 or id is null or not stays"), "ngram-special")
    bits = min(MOST_BITS, max(1 << 12, 1 << (int(special.count()) * 16).bit_length()))
    kept = spark.sparkContext.broadcast(bit_filter(special.select(F.coalesce("id", F.lit(0))), bits))
    own_id, own_key, many = fresh(docs.columns, "id_", "key_", "many_")
    at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    keyed_schema = T.StructType([*docs.schema.fields, T.StructField(own_id, T.LongType()), T.StructField(own_key, T.LongType())])

    def hits(x):
        flags = np.frombuffer(kept.value, np.uint8)
        ids = x.column(at).cast(pa.int64())
        return held_by(flags, ids.fill_null(0).to_numpy()) | np.asarray(ids.is_null()), ids

    def others(batches):
        for x in batches:
            hit, _ = hits(x)
            if not hit.all():
                yield x.filter(pa.array(~hit))

    def looked_at(batches):
        for x in pieces(batches, text_at):
            hit, ids = hits(x)
            if hit.any():
                x, ids = x.filter(pa.array(hit)), ids.filter(pa.array(hit))
                sets = (ngrams(t, n) for t in as_bytes(x.column(text_at)))
                keys = pa.array([set_key(g) if len(g) else None for g in sets], pa.int64())
                fields = [pa.field(own_id, pa.int64()), pa.field(own_key, pa.int64())]
                yield pa.RecordBatch.from_arrays([*x.columns, ids, keys], schema=pa.schema([*x.schema, *fields]))

    looked = docs.mapInArrow(looked_at, keyed_schema)
    asked = special.select(F.col("id").alias("asked_id"), (F.col("k") > 1).alias("asked_many"), F.col("stays").alias("asked_stays"))
    looked = looked.join(asked, F.col(own_id).eqNullSafe(F.col("asked_id")), "left").where(F.col("asked_stays").isNull() | F.col("asked_stays") | F.col(own_key).isNull())
    looked = looked.select(*docs.columns, own_id, own_key, F.coalesce(F.col("asked_many"), F.lit(False)).alias(many))
    once = looked.where(~F.col(many) | F.col(own_key).isNull()).select(*docs.columns)
    several = looked.where(F.col(many) & F.col(own_key).isNotNull()).join(best.toDF("best_id", "best_key", "best_first"), F.col(own_id).eqNullSafe(F.col("best_id")) & (F.col(own_key) == F.col("best_key")), "left_semi")
    return docs.mapInArrow(others, docs.schema).union(once).union(several.dropDuplicates([own_id, own_key]).select(*docs.columns))
