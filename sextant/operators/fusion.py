"""Fusions: of the clauses of one query, of the rankers, and of local with remote results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, paths

E = F.expr


def fuse_clauses(candidates: DataFrame) -> DataFrame:
    """(qid, path, score, clauses) from (qid, clause, path, score, rank from 1): every row of a clause contributes."""
    w = Window.partitionBy("qid")
    rows = candidates.groupBy("qid", F.lower("path").alias("path")).agg(F.sum(E(f"1.0D / ({fixed.CLAUSE_RRF} + rank)")).alias("rrf"), F.max("score").alias("best"), F.count_distinct("clause").alias("clauses"))
    return rows.withColumn("_top", F.max("rrf").over(w)).select("qid", "path", E("least(1.0D, 0.82D * rrf / _top + 0.18D * least(1.0D, best))").alias("score"), "clauses")


def clause_confidence(levels: DataFrame) -> DataFrame:
    """(qid, confidence): high only if all clauses are, medium if any is high or medium."""
    return levels.groupBy("qid").agg(E("case when bool_and(confidence = 'high') then 'high' when bool_or(confidence in ('high', 'medium')) then 'medium' else 'low' end").alias("confidence"))


def fuse_radars(candidates: DataFrame) -> DataFrame:
    """(qid, path, score, sources) from (qid, q, source, path, score, rank from 1): a source's first row for a path counts, by rank and by its score
    against the source's best; two sources add a bonus; supporting paths go down; the top becomes 1."""
    first = Window.partitionBy("qid", "source", F.lower("path")).orderBy("rank")
    rows = candidates.withColumn("_n", F.row_number().over(first)).withColumn("_top", F.max("score").over(Window.partitionBy("qid", "source"))).where("_n = 1")
    weight = "case source " + " ".join(f"when '{s}' then {w}D" for s, w in fixed.RADAR_WEIGHTS.items()) + " else 1.0D end"
    k = fixed.RADAR_RRF
    part = f"{weight} * (0.8D / ({k} + rank) + 0.2D * if(_top > 0, least(1.0D, greatest(0.0D, score)) / _top, 0.0D) / {k + 1})"
    summed = rows.groupBy("qid", "q", F.lower("path").alias("path")).agg(F.sum(E(part)).alias("s"), F.count_distinct("source").alias("sources"))
    raw = summed.withColumn("s", E(f"(s + if(sources >= 2, 0.15D / {k + 1}, 0.0D)) * {paths.local_multiplier('path', 'q')}"))
    return raw.withColumn("_top", F.max("s").over(Window.partitionBy("qid"))).select("qid", "path", E("s / _top").alias("score"), "sources")


def with_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(qid, path, score): remote rows (qid, path, pos from 0) get max(.2, .98 - .03 pos); of a path in both the higher score counts."""
    r = remote.select("qid", "path", E("greatest(0.2D, 0.98D - 0.03D * pos)").alias("score"))
    return local.select("qid", "path", "score").unionByName(r).groupBy("qid", F.lower("path").alias("path")).agg(F.max("score").alias("score"))


def radar_union(**radars: DataFrame) -> DataFrame:
    """One list in the order of the arguments."""
    out = None
    for i, (name, df) in enumerate(radars.items()):
        part = df.select("qid", F.lit(name).alias("source"), F.lit(i).alias("radar_order"), "path", "score")
        out = part if out is None else out.unionByName(part)
    return out


def margins(ranked: DataFrame) -> DataFrame:
    """(qid, top, second, margin)."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "path")
    df = ranked.withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    out = df.groupBy("qid").agg(F.max(E("if(_n = 1, score, null)")).alias("top"), F.max(E("if(_n = 2, score, null)")).alias("second"))
    return out.withColumn("margin", E("top - coalesce(second, 0.0D)"))
