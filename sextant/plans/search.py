"""A batch of queries against a tree of files: the hybrid ranker, and all rankers fused under the result policy."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import fusion, lexical, policy
from ..streaming.sync import shared_folder
from .index import Index

E = F.expr


@dataclass(frozen=True)
class Options:
    """What a search may be told; checked once."""

    chunk_lines: int = fixed.CHUNK_LINES
    chunk_overlap: int = fixed.CHUNK_OVERLAP
    ranking_limit: int | None = fixed.RANKING_LIMIT
    most_results: int = 12
    confidence: str = "medium"
    mode: str = "focused"
    exclude: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.chunk_lines < fixed.LEAST_CHUNK_LINES or not 0 <= self.chunk_overlap < self.chunk_lines:
            raise ValueError("chunks need 24 lines or more, and less overlap than that")
        if self.mode not in ("focused", "complete") or self.confidence not in fixed.DYNAMIC:
            raise ValueError(f"unknown mode or confidence: {self.mode}, {self.confidence}")


def wanted_terms(queries: DataFrame, stop=fixed.STOP_WORDS, most: int = 64) -> DataFrame:
    """(qid, term)."""
    return queries.select("qid", F.explode(E(text.query_terms("q", stop, most))).alias("term"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: what several branches of a plan need is made once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def evidence(files: DataFrame, wanted: DataFrame, chunk_lines: int, chunk_overlap: int, words: bool = True) -> tuple[DataFrame, DataFrame]:
    """What a batch of queries with terms (qid, term) needs of files (path, text): the chunks (path, chunk, start_line, end_line), and of each path
    and number the length, the wanted terms with their counts and, with `words`, the best similarity of each wanted word. The texts
    are read and tokenised once, and what is staged has some numbers for each chunk. The batch's terms go to all tasks."""
    keys, spans = ["path", "chunk"], ("start_line", "end_line")
    terms, near = lexical.listed(wanted, "term"), lexical.listed(lexical.words_of(wanted), "term") if words else ()
    cut = lexical.chunks(files, chunk_lines, chunk_overlap)
    if lexical.repeated(files):
        return cut.select(*keys, *spans), staged(lexical.counted(cut, keys, wanted=terms, words=near), "evidence")
    found = staged(lexical.counted(cut, keys, unique=True, wanted=terms, words=near, carried=spans), "evidence")
    return found.select(*keys, *spans), found.drop(*spans)


def hybrid(files: DataFrame, queries: DataFrame, options: Options = Options(), index: Index | None = None) -> DataFrame:
    """(qid, path, chunk, start_line, end_line, bm25_score, subword_score, path_score, fusion, coverage, score): chunks that any source ranks. With
    a stored index of these files nothing is chunked or tokenised again; without one, texts are tokenised once."""
    keys = ["path", "chunk"]
    if options.exclude:
        patterns = "|".join(text.glob_pattern(g) for g in options.exclude)
        files = files.where(~E(text.has("path", patterns)))
    wanted = F.broadcast(wanted_terms(queries))  # a batch's terms are few; a common one must not gather in a task
    if index and not options.exclude:
        cut, terms, sized, known = index.chunks, index.postings, index.lengths, index.vocabulary
        similar = lexical.subword(terms, wanted, keys, known)
    else:
        cut, found = evidence(files, wanted, options.chunk_lines, options.chunk_overlap)
        terms, sized = found.select(*keys, "len", F.inline("terms")), found.select(*keys, "len").where("len > 0")
        similar = lexical.mean_similarity(found.select(*keys, F.inline("near")), wanted, keys)
    totals = wanted.groupBy("qid").agg(F.count("*").alias("total"))
    by_path = lexical.path_scores(files, wanted)
    sources = {
        "bm25": lexical.bm25(terms, wanted, keys, sized).select("qid", *keys, "score"),
        "subword": similar,
        "path": by_path.join(cut.select(*keys), "path").select("qid", *keys, "score"),
    }
    fused = lexical.fuse(sources, keys, options.ranking_limit)
    in_terms = terms.join(wanted, "term").select("qid", *keys, "term")
    on_path = files.select("path").join(wanted, E("contains(lower(path), term)"))
    in_path = cut.select(*keys).join(on_path, "path").select("qid", *keys, "term")
    matched = in_terms.union(in_path).distinct().groupBy("qid", *keys).agg(F.count("*").alias("hits"))
    return lexical.scored(fused, matched, totals, keys).join(cut.select(*keys, "start_line", "end_line"), keys)


def hybrid_files(files: DataFrame, queries: DataFrame, options: Options = Options(), index: Index | None = None) -> DataFrame:
    """(qid, path, score, coverage, hits, ranges)."""
    return lexical.collapse(hybrid(files, queries, options, index))


def search(queries: DataFrame, radars: dict[str, DataFrame], options: Options = Options()) -> DataFrame:
    """(qid, path, score, role, rank): rankers' files (qid, path, score) fused and put under the policy; in complete mode nothing is cut off."""
    from pyspark.sql import Window

    parts = None
    for name, df in radars.items():
        part = df.select("qid", F.lit(name).alias("source"), "path", "score", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "path")).alias("rank"))
        parts = part if parts is None else parts.unionByName(part)
    fused = fusion.fuse_radars(parts.join(F.broadcast(queries), "qid")).join(F.broadcast(queries), "qid")
    if options.mode == "complete":
        return policy.rerank(fused)
    return policy.select(fused, options.confidence, options.most_results)
