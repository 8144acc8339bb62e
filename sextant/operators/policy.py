"""The result policy: merge by path, role-aware reranking, dynamic cut-off and the order of supporting files. All keyed by qid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, paths, routes, text

E = F.expr
CLAMP = "least(1.0D, greatest(0.0D, coalesce({}, 0.0D)))"


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """(qid, path, score, symbols, sources) by lower-cased path: the highest score wins, symbols and sources are united."""
    best = F.struct("score", F.col("path").alias("p"))
    return candidates.groupBy("qid", F.lower("path").alias("key")).agg(
        F.max_by("path", best).alias("path"), F.max("score").alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"), F.array_sort(F.collect_set("source")).alias("sources"),
    ).drop("key")


def owner_score(path: str, q: str, role: str, intent: str, symbols: str = "cast(array() as array<string>)", incoming: str = "0", outgoing: str = "0", definitions: str = "0") -> str:
    """What speaks for a file as the owner of what is asked: path terms, symbols, edges, definitions, role and place."""
    n = paths.normalized(path)
    terms = text.owner_terms(q)
    in_path = f"size(array_intersect({terms}, {text.owner_terms(text.replaced(n, r'[/.\\_-]+', ' '))}))"
    in_symbols = f"size(filter({symbols}, s -> exists({terms}, t -> length(t) >= 3 and contains(lower(s), t))))"
    return (
        f"least(0.12D, {in_path} * 0.035D) + least(0.18D, {in_symbols} * 0.06D) + least(0.12D, {incoming} * 0.025D) + least(0.06D, {outgoing} * 0.012D) + if({definitions} > 0, 0.08D, 0.0D)"
        f" + if({role} = 'implementation' and {intent} = 'implementation', 0.08D, 0.0D) + if({role} = 'entrypoint' and {intent} = 'entrypoint', 0.14D, 0.0D)"
        f" + if({text.has(n, '^(src|app|lib|internal|pkg|packages)/')}, 0.04D, 0.0D) + {paths.intent_adjustment(path, intent)}"
    )


def role_multiplier(role: str, intents: str) -> str:
    table = " ".join(f"when '{r}' then {m}D" for r, m in fixed.ROLE_MULTIPLIERS.items())
    named = f"element_at(transform(filter({intents}, i -> i.role = {role}), i -> i.score), 1)"
    return (
        f"case when exists({intents}, i -> i.role = {role}) then case {role} when 'implementation' then 1.14D when 'entrypoint' then 1.52D else 1.0D + 0.28D * {named} end"
        f" when {intents}[0].role = 'entrypoint' and {role} = 'implementation' then 0.78D when {intents}[0].role <> 'implementation' and {role} = 'implementation' then 0.88D else case {role} {table} end end"
    )


def rerank(candidates: DataFrame) -> DataFrame:
    """candidates (qid, q, path, score and, if present, symbols, incoming, outgoing, definitions) with role, owner, the adjusted score scaled back
    to the former top, and rank."""
    have = set(candidates.columns)
    w = Window.partitionBy("qid")
    df = candidates.withColumn("role", E(paths.role("path"))).withColumn("_i", E(routes.role_intents("q")))
    df = df.withColumn("_r0", F.row_number().over(w.orderBy(F.desc("score"), "path")))
    owner = owner_score("path", "q", "role", "_i[0].role", *(c if c in have else d for c, d in (("symbols", "cast(array() as array<string>)"), ("incoming", "0"), ("outgoing", "0"), ("definitions", "0"))))
    df = df.withColumn("_o", E(owner)).withColumn("owner", F.round("_o", 4))
    df = df.withColumn("adjusted", E(f"greatest(0.0D, round({CLAMP.format('score')} * {role_multiplier('role', '_i')} + _o, 9))"))
    df = df.withColumn("_top0", F.max(E(CLAMP.format("score"))).over(w)).withColumn("_top", F.max("adjusted").over(w))
    df = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc("adjusted"), F.desc("owner"), "_r0", "path")))
    return df.withColumn("score", E(CLAMP.format("if(_top > 0, adjusted / _top, adjusted) * _top0"))).drop("_i", "_o", "_r0", "_top0", "_top", "adjusted")


def dynamic_top_k(ranked: DataFrame, confidence: str = "medium", least_k: int | None = None, most_k: int = 12) -> DataFrame:
    """The rows before the first, from the least_k-th on, that falls below the floor or off a cliff."""
    ratio, floor, cliff = fixed.DYNAMIC[confidence]
    k = min(most_k, least_k or (5 if confidence == "low" else 3))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    df = ranked.withColumn("_n", F.row_number().over(w)).withColumn("_prev", F.lag("score").over(w)).withColumn("_top", F.first("score").over(w))
    fails = E(f"_n > {k} and (score < greatest({floor}D, _top * {ratio}D) or (_prev > 0 and score / _prev < {cliff}D))")
    df = df.withColumn("_cut", F.min(F.when(fails, F.col("_n"))).over(Window.partitionBy("qid")))
    return df.where(f"_n <= {most_k} and (_cut is null or _n < _cut)").drop("_n", "_prev", "_top", "_cut")


def smart_top_k(ranked: DataFrame, most: int = 10, floor: float = 0.08, ratio: float = 0.52, delta: float = 0.35, least_k: int = 3) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "path")
    df = ranked.withColumn("_n", F.row_number().over(w)).withColumn("_top", F.first("score").over(w))
    fails = E(f"(_n > {least_k} and score < greatest({floor}D, least(_top * {ratio}D, _top - {delta}D))) or (_n <= {least_k} and score < {floor}D)")
    df = df.withColumn("_cut", F.min(F.when(fails, F.col("_n"))).over(Window.partitionBy("qid")))
    return df.where(f"_n <= {most} and (_n = 1 or _cut is null or _n < _cut)").drop("_n", "_top", "_cut")


def support_quota(ranked: DataFrame, most: int) -> DataFrame:
    """The best `most` rows with primary roles first, supporting files filling what is left."""
    support = F.col("role").isin(*fixed.SUPPORT_ROLES)
    w = Window.partitionBy("qid").orderBy(support, "rank")
    return ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def select(candidates: DataFrame, confidence: str = "medium", most: int = 12) -> DataFrame:
    """Rerank, dynamic cut-off, then as many rows with support last."""
    ranked = rerank(candidates)
    n = dynamic_top_k(ranked, confidence, most_k=most).groupBy("qid").agg(F.count("*").alias("_most"))
    w = Window.partitionBy("qid").orderBy(F.col("role").isin(*fixed.SUPPORT_ROLES), "rank")
    return ranked.withColumn("_n", F.row_number().over(w)).join(n, "qid").where("_n <= _most").drop("_n", "_most")


def quality(cases: DataFrame, results: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, pool_count, result_count, pool_rank, result_rank, owner_top3, owner_top5, recall_failure, ranking_failure) from candidates
    `cases` (id, path, pos), `results` (id, path, rank) and `expected` (id, path)."""
    pool = cases.groupBy("id").agg(F.count("*").alias("pool_count"), (F.count("*") - F.count_distinct(F.lower("path"))).alias("pool_saturation"))
    size = results.groupBy("id").agg(F.count("*").alias("result_count"))
    first = lambda df, c, name: df.join(expected, ["id", "path"]).groupBy("id").agg(F.min(c).alias(name))
    out = pool.join(size, "id", "left").join(first(cases, "pos", "pool_rank"), "id", "left").join(first(results, "rank", "result_rank"), "id", "left")
    return out.select(
        "id", "pool_count", "pool_saturation", F.coalesce("result_count", F.lit(0)).cast("long").alias("result_count"), "pool_rank", "result_rank", E("coalesce(result_rank <= 3, false)").alias("owner_top3"),
        E("coalesce(result_rank <= 5, false)").alias("owner_top5"), E("pool_rank is null").alias("recall_failure"), E("pool_rank is not null and (result_rank is null or result_rank > 5)").alias("ranking_failure"),
    )


def quality_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), *[F.count_if(c).alias(c) for c in ("owner_top3", "owner_top5", "recall_failure", "ranking_failure")],
        F.sum("pool_saturation").alias("pool_saturation"), F.round(F.avg("result_count"), 6).alias("average_results"),
    )
