"""What the operators share: staging tables, table reading and span building."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named and all runs on one machine (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(columns: list[str], *stems: str) -> list[str]:
    """A name for each stem that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends there, and a lost
    executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that no later plan reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked_spans(text: str, pattern: str) -> Column:
    """array<struct<s:int,e:int,m:string>>: the leftmost non-overlapping matches of a Java pattern in the
    column `text`, in code points, end exclusive. Matches are wrapped in U+0001 and the lengths of the
    pieces are added up; the text must hold no U+0001 (see `without_marks`)."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    parts = f"split(regexp_replace({text}, '{quoted}', '\\u0001$0\\u0001'), '\\u0001')"
    return F.expr(
        f"""aggregate({parts},
            named_struct('n', 0, 'hit', false, 'out', cast(array() as array<struct<s:int,e:int,m:string>>)),
            (a, p) -> named_struct('n', a.n + length(p), 'hit', not a.hit,
                'out', if(a.hit, array_append(a.out, named_struct('s', a.n, 'e', a.n + length(p), 'm', p)), a.out)),
            a -> a.out)"""
    )


def without_marks(text: str) -> Column:
    """The text, '' for null, with U+0001 as U+0000: as long as before, and neither is in any pattern."""
    return F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\x01"), F.lit("\x00"))


def pieces(batches, text_at: int, most: int = 4 << 20):
    """Cuts Arrow batches so that the text column of each piece has about `most` bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0)))
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column) -> list:
    """A string column's values as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bit_filter(df: DataFrame, bits: int, produce=None, chunks: int = 64) -> bytes:
    """Packed bits of a Bloom filter with two slots a value, of the arrays of longs that produce(batches) yields; without it, of df's only
    column. `bits` is a power of 2 and bounds what comes to the driver."""
    import zlib

    import numpy as np
    import pyarrow as pa

    size = bits // chunks

    def note(batches):
        held = [np.unique(slots_of(values, bits)) for values in (produce(batches) if produce else (x.column(0).to_numpy() for x in batches))]
        slots = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        rows = []
        for c in np.unique(slots // size).tolist():
            a, b = np.searchsorted(slots, [c * size, (c + 1) * size])
            flags = np.zeros(size, bool)
            flags[slots[a:b] - c * size] = True
            rows.append((c, zlib.compress(np.packbits(flags).tobytes(), 1)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for x in batches:
            for c, b in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                held.setdefault(c, np.zeros(size // 8, np.uint8))[:] |= np.frombuffer(zlib.decompress(b.as_buffer()), np.uint8)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])

    found = bytearray(bits // 8)
    for r in merged_by(df.mapInArrow(note, "chunk int, bits binary"), merge, "chunk int, bits binary"):
        found[r.chunk * (size // 8) : (r.chunk + 1) * (size // 8)] = r.bits
    return bytes(found)


def merged_by(noted: DataFrame, merge, schema: str):
    """Rows of the merged pieces. Pieces are dealt out by chunk and merged one after another as they come, so a task holds one merged
    piece of each of its chunks, however many tasks there were."""
    return noted.repartition("chunk").mapInArrow(merge, schema).collect()


def slots_of(values, bits: int):
    """Two different slots for each long."""
    import numpy as np

    x = mixed(values.astype(np.int64).view(np.uint64))
    a, b = x & np.uint64(bits - 1), (x >> np.uint64(32)) & np.uint64(bits - 1)
    return np.stack([a, b ^ (a == b).astype(np.uint64)], axis=1).astype(np.int64)


def mixed(x):
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def held_by(flags, values):
    """Which values are in the filter (flags: its packed bits as an array of bytes); never false for one that was put in."""
    import numpy as np

    slots = slots_of(values, 8 * len(flags))
    return ((flags[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=1)


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the connected components of staged edges (a, b), root being the least vertex. Each round takes the least label among
    neighbours, hands it to the former root too, and then follows labels twice; every round's labels are staged."""
    arcs = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "arcs")
    labels = staged(arcs.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).select(F.col("a").alias("v"), "l"), "labels")
    while True:
        near = arcs.join(labels, arcs["b"] == labels["v"]).select(F.col("a").alias("v"), "l")
        least = near.union(labels).groupBy("v").agg(F.min("l").alias("m"))
        moved = staged(labels.join(least, "v").select("v", "l", "m"), "moved")
        if not moved.where("m < l").head(1):
            dropped(arcs, moved)
            return labels.withColumnRenamed("l", "root")
        hooked = moved.select("v", F.col("m").alias("l")).union(moved.where("m < l").select(F.col("l").alias("v"), F.col("m").alias("l")))
        jumped = staged(hooked.groupBy("v").agg(F.min("l").alias("l")), "hooked")
        to = jumped.select(F.col("v").alias("w"), F.col("l").alias("next"))
        before, labels = labels, staged(jumped.join(to, F.col("l") == F.col("w"), "left").select("v", F.coalesce("next", "l").alias("l")), "labels")
        dropped(before, moved, jumped)


def seen_twice(df: DataFrame, produce, bits: int, chunks: int = 128, flush: int = 500_000) -> bytes:
    """Packed bits of the slots (two a value) that values of df take at least twice; produce(batches) yields arrays of longs. A value that
    occurs twice has all its slots in the filter. Tasks hand on which slots they saw once and twice, in compressed pieces
    that are merged piece by piece; `bits` bounds what comes to the driver."""
    import zlib

    import numpy as np
    import pyarrow as pa

    size = bits // chunks
    schema = pa.schema([("chunk", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def packed(slots):
        flags = np.zeros(size, bool)
        flags[slots] = True
        return zlib.compress(np.packbits(flags).tobytes(), 1)

    def note(batches):
        held, n = [], 0

        def flushed():
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            twice = slots[counts > 1]
            rows = []
            for c in np.unique(slots // size).tolist():
                (a, b), (d, e) = np.searchsorted(slots, [c * size, (c + 1) * size]), np.searchsorted(twice, [c * size, (c + 1) * size])
                rows.append((c, packed(slots[a:b] - c * size), packed(twice[d:e] - c * size)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for values in produce(batches):
            x = slots_of(values, bits)
            held.append(x.ravel())
            n += x.size
            if n > flush:
                yield flushed()
                n = 0
        if n:
            yield flushed()

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x in batches:
            for c, a, b in zip(x.column(0).to_pylist(), x.column(1), x.column(2), strict=True):
                once, twice = held.setdefault(c, (np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)))
                a = np.frombuffer(zlib.decompress(a.as_buffer()), np.uint8)
                twice |= np.frombuffer(zlib.decompress(b.as_buffer()), np.uint8) | (once & a)
                once |= a
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for _, x in held.values()], pa.binary())], names=["chunk", "twice"])

    out = bytearray(bits // 8)
    for r in merged_by(df.mapInArrow(note, "chunk int, once binary, twice binary"), merge, "chunk int, twice binary"):
        out[r.chunk * (size // 8) : (r.chunk + 1) * (size // 8)] = r.twice
    return bytes(out)
