"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

A piece's length is all that packing looks at, and there are at most `size` lengths: so what is packed is the table of
lengths and their counts, whatever the corpus. Best fit in decreasing order runs on that table, whole runs of like
bins at a time; then local search exchanges one item for one, two for one, or moves an item between underfull bins,
all bins of two patterns at once, until no exchange helps. It covers every underfull bin. The result is a list of bin patterns with how often each
occurs. Each piece finds its place by its rank among the pieces of its length: a rank within its task, counted
while tokenising, plus the number in the tasks before. No length's pieces ever meet in one task, so any number of
copies of one document is fine.

A document is its ids and the end id. Only one longer than `size` is cut, its first piece taking the remainder.
Null texts count as empty: the end id alone. Each row is a document, repeated ids included. Extra columns are not kept.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces as cut_batches
from .common import staged

SIZE, END_ID, TOKENIZER = 1024, 2, "byte_bpe_50k.json"


@lru_cache(maxsize=2)
def encoder(path: str):
    """texts -> lists of ids, as tokenizers gives them for this byte-level BPE file with add_special_tokens=False.
    The merging is done by tiktoken on the file's own vocabulary, whose ids are in order of merging, about four times
    as fast; texts that spell out a special token, or that tiktoken refuses, go through tokenizers itself."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for t in texts:
            try:
                ids = None if any(s in t for s in special) else fast.encode_ordinary(t)
            except BaseException as e:  # the library's panics aren't Exceptions
                if isinstance(e, KeyboardInterrupt | SystemExit):
                    raise
                ids = None
            out.append(slow.encode(t, add_special_tokens=False).ids if ids is None else ids)
        return out

    return encode


def tokenised(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, shard and nth (its rank among its shard's pieces of that length), ids if asked for."""
    path = path or public_tokenizers.path(TOKENIZER)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("nth", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches):
        encode, seen, shard = encoder(path), Counter(), TaskContext.get().partitionId()
        for x in cut_batches(batches, 1):
            rows, columns = [], [[] for _ in fields]
            for row, ids in enumerate(encode([t or "" for t in x.column(1).to_pylist()])):
                flat = np.array([*ids, end_id], "<u4")
                first = len(flat) % size or size if len(flat) > size else len(flat)
                for n, (a, b) in enumerate(zip([0, *range(first, len(flat), size)], range(first, len(flat) + 1, size), strict=True)):
                    rows.append(row)
                    part = flat[a:b]
                    values = [n, a, b - a, zlib.crc32(part.tobytes()), shard, seen[b - a], part.astype(np.int32)]
                    seen[b - a] += 1
                    for c, v in zip(columns, values, strict=False):
                        c.append(v)
            if rows:
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(rows)), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], names=["doc_id", *(n for n, _ in fields)])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, shard int, nth long" + ", ids array<int>" * with_ids)


def best_fit(counts: dict[int, int], size: int) -> Counter:
    """Bins by best fit in decreasing order of length: pattern (lengths, longest first) -> how many."""
    by_room: dict[int, Counter] = {}
    rooms: list[int] = []
    done: Counter = Counter()

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = size - sum(pattern)
        if not n:
            return
        if not room:
            done[pattern] += n
            return
        if room not in by_room:
            by_room[room] = Counter()
            insort(rooms, room)
        by_room[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, pattern, n = size, (), -(-left // (size // length))
            else:
                room = rooms[at]
                pattern, n = by_room[room].popitem()
                if not by_room[room]:
                    del by_room[room]
                    del rooms[at]
            each = room // length
            whole = min(n, left // each)
            put(pattern + (length,) * each, whole)
            left -= whole * each
            n -= whole
            if n and left:  # then fewer than a bin's worth are left
                put(pattern + (length,) * left, 1)
                n, left = n - 1, 0
            if pattern:
                put(pattern, n)
    for c in by_room.values():
        done.update(c)
    return done


def local_search(bins: Counter, size: int) -> Counter:
    """Empties the less filled bins into the room of others, all bins of two patterns at once, until as few bins are left as the
    lengths need or no exchange helps. Each step makes fuller bins fuller at less filled ones' cost, so the sum of squared fills
    grows with every step and the search ends."""
    out: Counter = Counter()
    by: dict[tuple[int, int], dict[tuple[int, ...], None]] = {}  # (room, length) -> the underfull patterns that have both
    by_room: dict[int, dict[tuple[int, ...], None]] = {}
    rooms_of = [0] * (size + 1)  # by length, the rooms of the patterns that have it, as bits
    rooms = 0
    seen = 0  # grows with every pair of room and length that wasn't there
    stuck: dict[tuple[int, ...], int] = {}  # pattern -> seen when nothing helped it

    def add(p: tuple[int, ...], n: int) -> None:
        nonlocal rooms, seen
        if not p or not n:
            return
        if out[p]:
            stuck.pop(p, None)  # there may be a pair of it now
        elif room := size - sum(p):
            by_room.setdefault(room, {})[p] = None
            rooms |= 1 << room
            for y in set(p):
                if not by.setdefault((room, y), {}):
                    seen += 1
                    rooms_of[y] |= 1 << room
                by[room, y][p] = None
        out[p] += n

    def take(p: tuple[int, ...], n: int) -> None:
        out[p] -= n
        if not out[p]:
            del out[p]
            hide(p)

    def hide(p: tuple[int, ...]) -> None:
        nonlocal rooms
        room = size - sum(p)
        del by_room[room][p]
        if not by_room[room]:
            rooms ^= 1 << room
        for y in set(p):
            del by[room, y][p]
            if not by[room, y]:
                rooms_of[y] ^= 1 << room

    def partner(a: tuple[int, ...], room: int) -> tuple | None:
        """What helps a most: the other pattern, what a gives and what it gets. The other is at least as full."""
        below = (1 << room + 1) - 1
        own = Counter(a)
        for x in sorted(own, reverse=True):  # move: into the tightest room
            if fits := (rooms & below) >> x:
                return next(iter(by_room[x + (fits & -fits).bit_length() - 1])), (x,), ()
        given = {x + y: (x, y) for x in own for y in own if x < y or x == y and own[x] > 1} | {x: (x,) for x in own}  # two or one for one
        sums = np.array(sorted(given))
        most = np.fromiter(((r & below).bit_length() - 1 if r else -1 for r in rooms_of), np.int64, size + 1)  # by length, the most room
        lengths = np.flatnonzero(most > 0)
        at = np.searchsorted(sums, lengths + most[lengths], side="right") - 1
        gain = np.where(at >= 0, sums[np.maximum(at, 0)] - lengths, 0)
        if not len(gain) or gain.max() <= 0:
            return None
        k = int(gain.argmax())
        y = int(lengths[k])
        return next(iter(by[int(most[y]), y])), given[int(sums[at[k]])], (y,)

    for p, n in sorted(bins.items(), key=lambda x: (sum(x[0]), x[0])):
        add(p, n)
    spare = sum((size - sum(p)) * n for p, n in out.items()) // size  # so many bins may go, no more
    moved = True
    while moved and spare > 0:
        moved = False
        for a in sorted((p for ps in by_room.values() for p in ps), key=lambda p: (sum(p), p)):
            while spare > 0 and out[a] and stuck.get(a) != seen:
                room = size - sum(a)
                if alone := out[a] == 1:
                    hide(a)
                found = partner(a, room)
                if alone:
                    out[a] = 0
                    before = seen
                    add(a, 1)
                    seen = before
                if not found:
                    stuck[a] = seen
                    break
                b, xs, ys = found
                n = out[a] // 2 if a == b else min(out[a], out[b])
                left, right = Counter(a), Counter(b)
                left.subtract(xs)
                left.update(ys)
                right.subtract(ys)
                right.update(xs)
                take(a, n)
                take(b, n)
                less = tuple(sorted(left.elements(), reverse=True))
                add(less, n)
                add(tuple(sorted(right.elements(), reverse=True)), n)
                moved = True
                if not less:
                    spare -= n
                if not out[a]:
                    a = less
    return out


def plan(counts: dict[int, int], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length the runs of its places: first rank, first sequence, offset. Within a run, each next rank takes the next sequence."""
    bins = local_search(best_fit(counts, size), size)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: Counter = Counter()
    sequence = 0
    for pattern in sorted(bins):
        n, offset = bins[pattern], 0
        for length in pattern:
            runs.setdefault(length, []).append((next_rank[length], sequence, offset))
            next_rank[length] += n
            offset += length
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The staged pieces of `tokenised` with sequence_id and offset."""
    spark = pieces.sparkSession
    counted = staged(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "packing-counts")
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    held = spark.sparkContext.broadcast(plan(counts, size))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counted.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")), "packing-bases")
    ranked = pieces.join(bases, ["shard", "length"]).select(*[c for c in pieces.columns if c not in ("shard", "nth")], (F.col("nth") + F.col("_base")).alias("_rank"))
    at, rank_at = ranked.columns.index("length"), len(ranked.columns) - 1

    def run(batches):
        runs = held.value
        for x in batches:
            lengths, ranks = x.column(at).to_numpy(), x.column(rank_at).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(rows):
                    first, base, offsets = runs[int(lengths[rows[0]])]
                    k = np.searchsorted(first, ranks[rows], side="right") - 1
                    sequence[rows], offset[rows] = base[k] + ranks[rows] - first[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*list(x.columns)[:rank_at], pa.array(sequence), pa.array(offset)], schema=pa.schema([*list(x.schema)[:rank_at], pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())]))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[:rank_at])
    return ranked.mapInArrow(run, f"{types}, sequence_id long, offset long").select(*[c for c in pieces.columns if c not in ("shard", "nth")], "sequence_id", "offset")


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset."""
    return place(staged(tokenised(docs, size, end_id, path, with_ids), "packing-pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a packing with ids: what a training job reads. A sequence has at most `size` ids."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
