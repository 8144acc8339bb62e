"""Repeated substrings: which suffixes have a match of LEAST bytes elsewhere, or earlier.

In suffix order, the suffixes that share their first LEAST bytes stand together, and the previous and next smaller
position of one among them say whether an earlier match of that length exists: its longest previous factor reaches
LEAST exactly if it isn't the first of its run. That is all that is asked here, so runs are told by 128 bits of hashes (of those bytes and of
their anchor, see below) in place of the sorted bytes themselves, and the first of a run by its least position. A suffix sort of every position would move
many times the input; instead

1. Every window of LEAST bytes has an anchor: the GRAM bytes in it with the least hash, the leftmost of those. Equal windows have
   equal anchors at equal places. Anchors whose hash occurs once in all documents (most) are dropped by a filter of
   hashes seen twice, a Bloom filter of at most MOST_BITS bits.
2. Consecutive windows with one anchor form a block. Blocks with equal bytes are repeated as a whole: one hash stands
   for all their windows. Each moves once, to its anchor's group, which is read in order with three rows in memory. A run of MEET rows sends
   one of its equal blocks there and deals out the rest, so thousands of copies meet nowhere.
3. Where blocks share an anchor but not all their bytes (at the edges of copies), one block of each kind is cut into parts of at most
   STEP windows, which are compared likewise. Only parts with one core (the bytes that all their windows have) can share a window; of those
   that differ, one of each kind is spelled out window by window. Texts with such blocks are found by a filter; of more than
   MOST_BITS / 32 blocks in several rounds, each over its own rows, so a larger table takes more rounds and not a fuller filter.

`longest_previous_factor` builds the whole arrays for one text by prefix doubling, as a check and for single texts.

Texts are UTF-8 bytes, null is empty, those shorter than LEAST keep all; long ones are read in overlapping runs, whole; an empty table gives no rows.
Matches never cross documents. Rows that repeat id and text are copies of each other; rows that only repeat an id (null is one) are told apart by
64 bits of their text. Of copies with keep_first, the least (id, hash of the text, place) is the first. Extra columns pass through `remove_repeats`
whatever their names, but those of its results give way; `spans` keeps none.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bit_filter, dropped, fresh, held_by, mixed, pieces, seen_twice, staged

LEAST, GRAM, STEP, MOST_BITS, CHUNK, PIECE, MEET = 200, 40, 16, 1 << 28, 1 << 18, 1 << 20, 1 << 17


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of an odd number and of its inverse modulo 2**64."""
    values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    n = 2 * CHUNK
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)]))
    return values, powers, inverse


class Windows:
    """A run of bytes from one or more documents, at most about CHUNK: hashes of all its substrings, and its blocks."""

    def __init__(self, parts: list[bytes], least: int, gram: int):
        data = np.frombuffer(b"".join(parts), np.uint8)
        values, powers, self.inverse = _tables()
        n = len(data)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * powers[:n])])
        self.least = least
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        width = least - gram + 1
        counts = np.maximum(ends - begins - least + 1, 0)
        if not counts.any():
            self.s = self.n = self.part = self.at = self.gram = self.anchor = self.block = np.zeros(0, np.int64)
            return
        grams = mixed((self.sums[gram:] - self.sums[:-gram]) * self.inverse[: n - gram + 1])
        low = np.uint64((1 << 21) - 1)  # places within the run; hashes keep the bits above
        best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        if width > step:
            best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
        good = np.flatnonzero(counts)
        best = np.concatenate([best[b : b + c] for b, c in zip(begins[good].tolist(), counts[good].tolist(), strict=True)])
        offset = np.cumsum(counts[good]) - counts[good]  # of each part's first window among all
        first = np.concatenate([[True], best[1:] != best[:-1]])  # anchors of two parts differ in their place
        i = np.flatnonzero(first)
        self.n = np.diff(np.concatenate([i, [len(best)]]))
        which = np.searchsorted(offset, i, side="right") - 1
        self.part, self.at = good[which], i - offset[which]
        self.s = self.at + begins[self.part]
        self.anchor = (best[i] & low).astype(np.int64)
        self.gram = grams[self.anchor].view(np.int64)
        self.block = self.shaped(self.s, self.n, self.anchor)

    def hashed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def shaped(self, s: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of n windows from s, and of where their anchor stands."""
        shape = (anchor - s).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)
        return mixed(mixed(self.hashed(s, s + n - 1 + self.least)) + shape).view(np.int64)

    def split(self, b: np.ndarray, unit: int) -> dict[str, np.ndarray]:
        """Blocks b cut where the anchor's distance passes a multiple of unit, so that equal parts of different blocks are cut alike. A part's group
        tells its core, the bytes that all windows with an anchor at such a distance have: parts of different cores share no window."""
        n = self.n[b]
        block = np.repeat(b, n)
        p = self.s[block] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        step = (self.anchor[block] - p) // unit
        i = np.flatnonzero(np.concatenate([[True], (step[1:] != step[:-1]) | (block[1:] != block[:-1])])) if len(p) else np.zeros(0, np.int64)
        n, block, p = np.diff(np.concatenate([i, [len(p)]])), block[i], p[i]
        step = step[i]
        core = self.anchor[block] - step * unit
        group = mixed(mixed(self.hashed(core, core + self.least - unit + 1)) + self.gram[block].view(np.uint64) + step.astype(np.uint64)).view(np.int64)
        return {"g": group, "c": self.shaped(p, n, self.anchor[block]), "part": self.part[block], "at": self.at[block] + p - self.s[block], "n": n, "block": block}


def _runs(texts: list[bytes], least: int, gram: int):
    """(Windows, rows of its parts, places of its parts in their texts): texts joined, or cut with an overlap, to about CHUNK bytes."""
    parts, rows, starts, total = [], [], [], 0
    for row, t in enumerate(texts):
        for at in range(0, max(1, len(t) - least + 1), CHUNK):
            part = t[at : at + CHUNK + least - 1]
            if len(part) < least:
                continue
            if total and total + len(part) > CHUNK:
                yield Windows(parts, least, gram), np.array(rows), np.array(starts)
                parts, rows, starts, total = [], [], [], 0
            parts.append(part)
            rows.append(row)
            starts.append(at)
            total += len(part)
    if parts:
        yield Windows(parts, least, gram), np.array(rows), np.array(starts)


def _keys(ids: np.ndarray, texts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of a block's place: id, text's hash, start."""
    x = mixed(ids.view(np.uint64)) + texts.astype(np.int64).view(np.uint64)
    return mixed(mixed(x) + at.astype(np.int64).astype(np.uint64)).view(np.int64)


def spans(docs: DataFrame, least: int = LEAST, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", gram: int | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """(id, x, spans): by row of docs (x: hash of the text) with repeats, an array of (s, n): n windows of `least` bytes from byte s that start
    elsewhere too; with keep_first, that start earlier (by id, then hash of the text, then place). They may overlap. `held` gets the tables
    that may go once the result is staged."""
    own = [] if held is None else held

    def kept(df: DataFrame, name: str) -> DataFrame:
        own.append(staged(df, f"substring-{name}"))
        return own[-1]

    spark = docs.sparkSession
    gram = gram or max(1, min(GRAM, least // 2))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("x"), F.col(text_col).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = min(MOST_BITS, max(1 << 16, 1 << int(16 * size * 2 // (least - gram + 2)).bit_length()))

    def grams(batches):
        for x in pieces(batches, 2, PIECE):
            for w, _, _ in _runs(as_bytes(x.column(2)), least, gram):
                if len(w.gram):
                    yield w.gram

    twice = spark.sparkContext.broadcast(seen_twice(narrow, grams, bits))

    def blocks(batches):
        flags = np.frombuffer(twice.value, np.uint8)
        for x in pieces(batches, 2, PIECE):
            ids, hashes = x.column(0), x.column(1)
            for w, rows, starts in _runs(as_bytes(x.column(2)), least, gram):
                b = np.flatnonzero(held_by(flags, w.gram))
                if len(b):
                    row = pa.array(rows[w.part[b]])
                    yield pa.RecordBatch.from_arrays([pa.array(w.gram[b]), pa.array(w.block[b]), ids.take(row), hashes.take(row), pa.array((w.at[b] + starts[w.part[b]])), pa.array(w.n[b].astype(np.int32))], names=["g", "c", "id", "x", "s", "n"])

    def condensed(batches):
        """Rows by runs of MEET, with `kind`: 0, or of a class that the run has several of, 1 for the one that meets other runs' rows and
        2 for its copies (1 isn't one itself with keep_first). So thousands of copies don't go to one task."""
        held, n = [], 0
        for x in chain(batches, [None]):
            if x is not None:
                held.append(x)
                n += x.num_rows
            if n and (x is None or n >= MEET):
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
                t = t.take(pa.array(_order(t, keep_first)))
                _, new, copy = _met(t, keep_first)
                kind = np.where(copy, np.where(new, 1, 2), 0).astype(np.int32)
                t = pa.RecordBatch.from_arrays([*t.columns, pa.array(kind)], names=[*t.schema.names, "kind"])
                yield t.filter(pa.array(new | copy)) if keep_first else t  # a row's copies are at the first one's place

    def met(batches):
        """Of rows sorted by g and c: the copies, and one row of each class of groups g with several classes. Only the first of the last group, the
        first of the last class and the last row are carried on; what that says twice, it says rightly."""
        carried = None
        for x in batches:
            if not x.num_rows:
                continue
            t = x if carried is None else pa.Table.from_batches([carried, x]).combine_chunks().to_batches()[0]
            group, new, copy = _met(t, keep_first)
            copy = copy | (t.column(6).to_numpy() > (1 if keep_first else 0))
            place = np.arange(t.num_rows)
            begin, later = np.maximum.accumulate(np.where(group, place, 0)), new & ~group
            probe = later.copy()
            probe[begin[later]] = True
            out = pa.RecordBatch.from_arrays([*t.columns[2:6], pa.array(copy), pa.array(probe)], names=["id", "x", "s", "n", "copy", "probe"])
            yield out.filter(pa.array(copy | probe))
            carried = t.take(pa.array(np.unique([begin[-1], np.flatnonzero(new)[-1], place[-1]])))

    def repeated(found: DataFrame, by: str) -> DataFrame:
        """Of condensed rows, which all move once: (id, x, s, n, copy, probe)."""
        dealt = found.repartition(F.when(F.col("kind") == 2, F.xxhash64("id", "x", "s")).otherwise(F.col(by)))
        order = ["g", "c", "id", "x", "s"] if keep_first else ["g", "c"]
        return dealt.sortWithinPartitions(*order).mapInArrow(met, "id long, x long, s long, n int, copy boolean, probe boolean")

    def keys(batches):
        for x in batches:
            ids, hashes = _ids(x.column(0)), x.column(1).to_numpy()
            yield np.concatenate([_keys(ids, hashes, x.column(2).to_numpy()), _keys(ids, hashes, np.int64(-1))])

    def searched(probes: DataFrame, produce, name: str) -> DataFrame:
        """produce(batches, flags) over the rows of docs that probes name; flags: a filter of their places and rows, 32 bits for each
        probe. As many as MOST_BITS bits hold are searched at once, by rows of docs, so a row is read into windows in one of the rounds only."""
        rounds = max(1, -(-32 * probes.count() // MOST_BITS))
        tables = []
        for k in range(rounds):
            some, own_docs = ((df.where(F.pmod(F.xxhash64("id", "x"), F.lit(rounds)) == k) if rounds > 1 else df) for df in (probes, narrow))
            room = min(MOST_BITS, max(1 << 14, 1 << (32 * probes.count() // rounds).bit_length()))
            flags = spark.sparkContext.broadcast(bit_filter(some, room, keys))

            def run(batches, flags=flags):
                return condensed(produce(batches, np.frombuffer(flags.value, np.uint8)))

            tables.append(own_docs.mapInArrow(run, schema))
            if rounds > 1:
                tables[-1] = kept(tables[-1], f"{name}-{k}")
                flags.unpersist()
        return reduce(DataFrame.union, tables)

    def asked(batches, flags):
        """(batch, ids, hashes, Windows, rows, starts) of the rows asked for; what the filter holds beyond that is as real."""
        for x in pieces(batches, 2, PIECE):
            ids, hashes = _ids(x.column(0)), x.column(1).to_numpy()
            chosen = np.flatnonzero(held_by(flags, _keys(ids, hashes, np.int64(-1))))
            texts = as_bytes(x.column(2).take(pa.array(chosen)))
            for w, rows, starts in _runs(texts, least, gram):
                if len(w.s):
                    yield x, ids, hashes, w, chosen[rows], starts

    def batch_of(x, rows, starts, cut):
        own = pa.array(rows[cut["part"]])
        at = cut["at"] + starts[cut["part"]]
        return pa.RecordBatch.from_arrays([pa.array(cut["g"]), pa.array(cut["c"]), x.column(0).take(own), x.column(1).take(own), pa.array(at), pa.array(cut["n"].astype(np.int32))], names=["g", "c", "id", "x", "s", "n"])

    def parts(batches, flags):
        """The blocks asked for, cut."""
        for x, ids, hashes, w, rows, starts in asked(batches, flags):
            row = rows[w.part]
            b = np.flatnonzero(held_by(flags, _keys(ids[row], hashes[row], w.at + starts[w.part])))
            if len(b):
                yield batch_of(x, rows, starts, w.split(b, step))

    def windows(batches, flags):
        """The single windows of the parts asked for."""
        for x, ids, hashes, w, rows, starts in asked(batches, flags):
            cut = w.split(np.arange(len(w.s)), step)
            row = rows[cut["part"]]
            good = np.flatnonzero(held_by(flags, _keys(ids[row], hashes[row], cut["at"] + starts[cut["part"]])))
            if len(good):
                n = cut["n"][good]
                i = np.repeat(good, n)
                at = cut["at"][i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                block = cut["block"][i]
                s = at + (w.s - w.at)[block]
                h = mixed(w.hashed(s, s + least)).view(np.int64)
                yield batch_of(x, rows, starts, {"g": w.gram[block], "c": h, "part": cut["part"][i], "at": at, "n": np.ones(len(i), np.int64)})

    schema = "g long, c long, id long, x long, s long, n int, kind int"
    step = max(1, min(STEP, least // 8))
    whole = kept(repeated(narrow.mapInArrow(lambda batches: condensed(blocks(batches)), schema), "g"), "blocks")
    twice.unpersist()
    cut = kept(repeated(searched(whole.where("probe"), parts, "block-parts"), "g"), "parts")
    single = repeated(searched(cut.where("probe"), windows, "part-windows"), "c")
    every = whole.union(cut).union(single).where("copy")
    return every.groupBy("id", "x").agg(F.collect_set(F.struct("s", "n")).alias("spans"))  # copies of a row have the same spans: a group is one text's


def _order(t: pa.RecordBatch, places: bool) -> np.ndarray:
    """The order of rows (g, c, id, x, s, ...) by g and c, then place."""
    g, c = t.column(0).to_numpy(), t.column(1).to_numpy()
    if not places:
        return np.lexsort((c, g))
    valid = np.asarray(t.column(2).is_valid())
    return np.lexsort((t.column(4).to_numpy(), t.column(3).to_numpy(), _ids(t.column(2)), valid, c, g))


def _met(t: pa.RecordBatch, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (g, c, id, x, s, ...) in order: which begin a group g, which a class (g, c), and which are copies: of another row of their class, or with
    keep_first of its first at another place."""

    def differs(*columns):
        return np.concatenate([[True], np.any([v[1:] != v[:-1] for v in columns], axis=0)])

    g = t.column(0).to_numpy()
    group = differs(g)
    new = differs(g, t.column(1).to_numpy())
    if not keep_first:
        return group, new, ~new | np.concatenate([~new[1:], [False]])
    moved = np.cumsum(~new & differs(np.asarray(t.column(2).is_valid()), _ids(t.column(2)), t.column(3).to_numpy(), t.column(4).to_numpy()))
    return group, new, moved > moved[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]


def _ids(column) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def covered(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of bytes that windows cover; runs that touch are one."""
    if not len(spans):
        return []
    x = np.array(sorted(spans), np.int64)
    begin, end = x[:, 0], np.maximum.accumulate(x[:, 0] + x[:, 1] - 1 + least)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return list(zip(begin[at].tolist(), end[np.concatenate([at[1:] - 1, [len(x) - 1]])].tolist(), strict=True))


FOUND = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def remove_repeats(docs: DataFrame, least: int = LEAST, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", gram: int | None = None, with_text: bool = True) -> DataFrame:
    """docs with `kept` (the remaining bytes; cuts may fall inside a character), n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256.
    Only texts that a filter of the rows with repeats holds are shuffled to meet their spans; the others are finished where they are read."""
    df = docs.drop("kept", *(n for n, _ in FOUND))
    own = df.columns
    held: list[DataFrame] = []
    found = staged(spans(df, least, keep_first, id_col, text_col, gram, held), "substring-spans")
    for table in held:
        dropped(table)
    bits = min(MOST_BITS, max(1 << 14, 1 << (16 * found.count()).bit_length()))
    marked = df.sparkSession.sparkContext.broadcast(bit_filter(found.select("id", "x"), bits, _row_keys))
    at, extra = own.index(text_col), [("kept", pa.binary())] * with_text + FOUND

    def finished(x, marks):
        columns = [[] for _ in FOUND]
        texts = []
        for t, m in zip(as_bytes(x.column(at)), marks, strict=True):
            cuts = covered([(y["s"], y["n"]) for y in m or ()], least)
            edges = [0, *(p for c in cuts for p in c), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            texts.append(kept)
            for c, v in zip(columns, (len(t), len(t) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(v)
        arrays = [pa.array(texts, pa.binary())] * with_text + [pa.array(c, f) for c, (_, f) in zip(columns, FOUND, strict=True)]
        return pa.RecordBatch.from_arrays([*list(x.columns)[: len(own)], *arrays], schema=pa.schema([*list(x.schema)[: len(own)], *(pa.field(*e) for e in extra)]))

    def chosen(batches, want: bool):
        flags = np.frombuffer(marked.value, np.uint8)
        for x in pieces(batches, at, PIECE):
            hit = held_by(flags, _keys(_ids(x.column(len(own))), x.column(len(own) + 1).to_numpy(), np.int64(-1)))
            if (hit == want).any():
                yield x.filter(pa.array(hit == want))

    def plain(batches):
        for x in chosen(batches, False):
            yield finished(x, [None] * x.num_rows)

    def repeated(batches):
        yield from chosen(batches, True)

    def cut(batches):
        for x in pieces(batches, at, PIECE):
            yield finished(x, x.column(len(own)).to_pylist())

    kinds = {"kept": T.BinaryType(), "kept_sha256": T.StringType()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, kinds.get(n, T.LongType())) for n, _ in extra)])
    row_id, row_text, of_id, of_text, row_spans = fresh(own, "row_id", "row_text", "of_id", "of_text", "row_spans")
    keyed = df.withColumn(row_id, F.col(id_col).cast("long")).withColumn(row_text, text_hash(text_col))
    some = keyed.mapInArrow(repeated, keyed.schema)
    wide = some.join(found.toDF(of_id, of_text, row_spans), F.col(row_id).eqNullSafe(F.col(of_id)) & (F.col(row_text) == F.col(of_text)), "left").select(*own, row_spans)
    return keyed.mapInArrow(plain, schema).union(wide.mapInArrow(cut, schema))


def _row_keys(batches):
    for x in batches:
        yield _keys(_ids(x.column(0)), x.column(1).to_numpy(), np.int64(-1))


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"), with_text=False).drop("text")


def longest_previous_factor(text: bytes) -> list[int]:
    """For each place the length of the longest match that starts earlier: the larger of the overlaps with the previous and the next smaller place in suffix order."""
    n = len(text)
    if not n:
        return []
    rank = np.frombuffer(text, np.uint8).astype(np.int64)
    k = 1
    while True:
        second = np.concatenate([rank[k:] + 1, np.zeros(min(k, n), np.int64)])[:n]
        order = np.lexsort((second, rank))
        new = np.concatenate([[0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or k >= n:
            break
        k *= 2

    def common(a: int, b: int) -> int:
        m = 0
        while b + m < n and a + m < n and text[a + m] == text[b + m]:
            m += 1
        return m

    out = [0] * n
    for suffixes in (order.tolist(), order.tolist()[::-1]):
        stack: list[int] = []
        for p in suffixes:
            while stack and stack[-1] > p:
                stack.pop()
            if stack:
                out[p] = max(out[p], common(stack[-1], p))
            stack.append(p)
    return out
