"""An index that is built once and searched many times: tables of one folder, each swapped in when it is written.

Postings lie sorted by term inside each file, so a search for few terms skips most row groups; lengths, chunks and the vocabulary lie beside
them. The graph's symbols, imports and calls, and vectors if an embedder is given, are tables of the same folder. `meta` is written last and names
the version and the chunking: an index without it, or with another chunking, isn't read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, lexical, vector
from ..streaming.sync import read_table, replace_table

VERSION = 1
KEYS = ["path", "chunk"]


def config_hash(chunk_lines: int, chunk_overlap: int) -> str:
    return sha256(json.dumps({"chunk_lines": chunk_lines, "chunk_overlap": chunk_overlap}, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    root: str

    def __getattr__(self, name: str) -> DataFrame:
        """A table by its name: files, chunks, postings, lengths, vocabulary, symbols, imports, calls, call_edges, vectors, meta."""
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, f"{self.root}/{name}")


def build(files: DataFrame, root: str, chunk_lines: int, chunk_overlap: int, embed: Callable[[DataFrame], DataFrame] | None = None, structure: bool = True) -> Index:
    """Builds all tables of files (path, text), those of the graph only with `structure`. `embed` makes (key, unit, body) into rows with `embedding`."""
    spark, root = files.sparkSession, root.rstrip("/")
    index = Index(spark, root)
    sized = files.select("path", "text", F.octet_length("text").cast("long").alias("size"))

    def put(name: str, df: DataFrame) -> None:
        replace_table(df, f"{root}/{name}")

    cut = lexical.chunks(sized, chunk_lines, chunk_overlap)
    put("files", sized.select("path", "size", F.expr(text.content_hash("path", "text")).alias("hash")))
    put("chunks", cut.select(*KEYS, "start_line", "end_line"))
    put("postings", lexical.postings(cut, KEYS, unique=not lexical.repeated(sized)).sortWithinPartitions("term"))
    put("lengths", index.postings.groupBy(*KEYS).agg(F.sum("tf").alias("len")))
    put("vocabulary", lexical.vocabulary(index.postings))
    if structure:
        put("symbols", graph.symbols(sized))
        put("imports", graph.resolve_imports(graph.imports(sized), sized))
        put("calls", graph.calls(sized))
        put("call_edges", graph.call_edges(index.calls, index.symbols))
    if embed:
        put("vectors", embed(vector.split_units(sized.withColumnRenamed("path", "key"))))
    counts = {"files": index.files.count(), "chunks": index.chunks.count(), "symbols": index.symbols.count() if structure else 0, "edges": index.call_edges.count() if structure else 0}
    put("meta", spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(config_hash(chunk_lines, chunk_overlap)).alias("config"), F.current_timestamp().alias("built"), *[F.lit(v).cast("long").alias(k) for k, v in counts.items()]))
    return index


def opened(spark: SparkSession, root: str, chunk_lines: int, chunk_overlap: int) -> Index:
    """The index in a folder; a ValueError if it is of another version or chunking, and so must be built anew."""
    index = Index(spark, root.rstrip("/"))
    meta = index.meta.head()
    if meta is None or (meta.version, meta.config) != (VERSION, config_hash(chunk_lines, chunk_overlap)):
        raise ValueError(f"the index in {root} is of another version or chunking")
    return index
