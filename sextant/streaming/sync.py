"""Keeping an index in step with its files: events, debouncing, spacing and the three-way incremental sync.

The same functions take batch and streaming DataFrames where Spark allows it. State lives in the checkpoint of the streaming
query, so a lost executor costs a replay of its batch.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text

E = F.expr


def watch(spark: SparkSession, root: str, glob: str = "*", per_batch: int = 1000) -> DataFrame:
    """A stream of (path, mtime, text), a row for each new or replaced file below root; the polling source lists it each trigger."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(root)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))


def bursts(events: DataFrame, gap: str = "800 milliseconds", lateness: str | None = None, project: str = "project") -> DataFrame:
    """(project, start, end, n, paths, dirty_all) from (project, ts, path): events less than a gap apart are one burst, that is one sync. Of more
    than 200 dirty paths only the fact is kept, as all is read again then."""
    src = events.withWatermark("ts", lateness) if lateness else events
    out = src.groupBy(project, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.select(project, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", E("if(size(paths) > 200, array(), paths)").alias("paths"), E("size(paths) > 200").alias("dirty_all"))


def spaced(bursts_: DataFrame, least_seconds: float = 5.0, project: str = "project") -> DataFrame:
    """(project, run_at): a sync for each burst, delayed so that two of a project are least_seconds apart. For a stream of (project, end)."""
    kind = bursts_.schema[project].dataType.simpleString()

    def space(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (float("-inf"),)
        out = []
        for end in sorted(t for pdf in batches for t in pdf["end"]):
            last = max(end.timestamp(), last + least_seconds)
            out.append(last)
        if out:
            state.update((last,))
            yield pd.DataFrame({project: [key[0]] * len(out), "run_at": pd.to_datetime([round(t * 1e6) for t in out], unit="us")})

    return bursts_.select(project, "end").groupBy(project).applyInPandasWithState(space, f"{project} {kind}, run_at timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def actions(scan: DataFrame, index: DataFrame, verify: str = "false") -> DataFrame:
    """(path, action) from scan (path, size, mtime_ms, hash) and index (same columns): reuse, refresh, rechunk, add or drop. With `verify` (a
    condition on the path) equal statistics aren't trusted."""
    s, i = scan.alias("s"), index.alias("i")
    both = s.join(i, E("s.path = i.path"), "full_outer").select(F.coalesce("s.path", "i.path").alias("path"), "s.size", "s.mtime_ms", "s.hash", E("i.path is not null").alias("known"), E("s.path is not null").alias("there"), E("i.size").alias("old_size"), E("i.mtime_ms").alias("old_mtime"), E("i.hash").alias("old_hash"))
    same = "size = old_size and abs(mtime_ms - old_mtime) < 0.001D"
    return both.select("path", E(f"case when not there then 'drop' when not known then 'add' when {same} and not ({verify}) then 'reuse' when hash <=> old_hash then 'refresh' else 'rechunk' end").alias("action"))


def verify_below(prefixes: list[str]) -> str:
    """A condition: the path is one of the dirty ones or below one."""
    if not prefixes:
        return "false"
    return f"exists({text.listed(prefixes)}, p -> path = p or startswith(path, concat(p, '/')))"


def upsert(index: DataFrame, fresh: DataFrame, todo: DataFrame) -> DataFrame:
    """The index's rows whose files stay, and the fresh rows of files that changed or came."""
    gone = todo.where("action in ('drop', 'rechunk', 'add')").select("path")
    new = fresh.join(todo.where("action in ('rechunk', 'add')").select("path"), "path", "left_semi")
    return index.join(gone, "path", "left_anti").unionByName(new)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where all runs on it (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def replace_table(df: DataFrame, path: str) -> None:
    """Writes df beside an index directory and swaps it in; the former one stays as .bak until the next swap."""
    spark = df.sparkSession
    tmp, bak = path.rstrip("/") + ".tmp", path.rstrip("/") + ".bak"
    df.write.mode("overwrite").parquet(tmp)
    jvm = spark._jvm
    new, old, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (tmp, path, bak))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(kept, True)
    if fs.exists(old):
        fs.rename(old, kept)
    if not fs.rename(new, old):
        fs.rename(kept, old)
        raise OSError(f"cannot replace {path}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The index, or its former version if a swap was cut short."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path if fs.exists(p) else path.rstrip("/") + ".bak")


class Watchers:
    """Streaming queries by project, at most `most` of them; the one least recently asked for stops first."""

    def __init__(self, most: int = 8):
        self.most, self.held = most, {}

    def get(self, project: str, start) -> StreamingQuery:
        query = self.held.pop(project, None)
        if query is None or not query.isActive:
            query = start()
        self.held[project] = query
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held))).stop()
        return query

    def status(self) -> list[tuple[str, bool, str]]:
        return [(p, q.isActive, q.status["message"]) for p, q in self.held.items()]

    def stop(self) -> None:
        while self.held:
            self.held.popitem()[1].stop()
