"""Policy, fusion, ranges, ranking and output (X17, X18, L1-L6, M2-M6, W4-W11, J13-J15, X24, X25, L8, L9-L11, U5-U7, K6, T-*, X42-X45, X48, A15-A18, A21, V*)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions import parse, paths, routes, text
from ..operators import fusion, lexical, output, policy, ranges, vector
from . import duck
from .base import FILES, LINES, files, lines, made, query, table, values
from .text_queries import ADJUST, NORMAL, QUERIES_, ROLE, named_roles

E = F.expr
R6 = lambda c: F.round(c, 6).alias(c)

CANDIDATES = [
    (1, "src/server.ts", 0.91), (1, "tests/server.test.ts", 0.95), (1, "docs/server.md", 0.7), (1, "src/http/parser.ts", 0.66), (1, "lib/token.ts", 0.62), (1, "config/app.yaml", 0.55), (1, "src/index.ts", 0.5), (1, "scripts/bench.mjs", 0.2), (1, "src/util.ts", 0.1),
    (3, "src/auth/login.ts", 0.4), (3, "src/cache.ts", 0.39), (3, "app/retry.go", 0.2), (5, "src/user_service.ts", 0.8), (5, "src/a.ts", 0.79), (5, "src/b.ts", 0.78), (5, "src/c.ts", 0.3), (8, "docs/config.md", 0.9), (8, "src/x.ts", 0.85), (10, "tests/retry_test.go", 0.6), (10, "src/retry.go", 0.6),
    (13, "src/index.ts", 0.9), (13, "src/api/main.ts", 0.9),
]
CAND = "qid int, path string, score double"
VC, VQ = values(CANDIDATES, CAND, "c"), values(QUERIES_, "qid int, q string", "q")


def candidates(spark):
    return made(spark, CANDIDATES, CAND).join(made(spark, QUERIES_, "qid int, q string"), "qid")


INTENTS = f"CASE WHEN len(ns) = 0 OR list_contains(ns, 'implementation') THEN CASE WHEN len(ns) = 0 THEN ['implementation'] ELSE ns END ELSE ns END"
RERANK = f"""(WITH c0 AS (SELECT qid, path, q, score, {NORMAL} AS n, list_last(string_split({NORMAL}, '/')) AS b, {named_roles('lower(q)')} AS ns FROM {VC} JOIN {VQ} USING (qid)),
c1 AS (SELECT *, {ROLE} AS role, {INTENTS} AS named, CASE WHEN regexp_matches(b, '.\\.[^.]*$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END AS stem FROM c0),
c2 AS (SELECT *, named[1] AS intent, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS r0 FROM c1),
c3 AS (SELECT *, least(0.12, 0.035 * len(list_intersect(list_distinct(regexp_extract_all(lower(q), '[a-z_$][a-z0-9_$-]+|\\p{{Han}}{{2,}}')), list_distinct(regexp_extract_all(regexp_replace(n, '[/.\\\\_-]+', ' ', 'g'), '[a-z_$][a-z0-9_$-]+|\\p{{Han}}{{2,}}')))))
  + CASE WHEN role = 'implementation' AND intent = 'implementation' THEN 0.08 ELSE 0 END + CASE WHEN role = 'entrypoint' AND intent = 'entrypoint' THEN 0.14 ELSE 0 END
  + CASE WHEN regexp_matches(n, '^(src|app|lib|internal|pkg|packages)/') THEN 0.04 ELSE 0 END + {ADJUST} AS owner FROM c2),
c4 AS (SELECT *, CASE WHEN list_contains(named, role) THEN CASE role WHEN 'implementation' THEN 1.14 WHEN 'entrypoint' THEN 1.52 ELSE 1.28 END WHEN role = 'implementation' AND intent <> 'implementation' AND NOT list_contains(ns, 'implementation') THEN 1.14
  ELSE CASE role WHEN 'implementation' THEN 1.14 WHEN 'entrypoint' THEN 1.12 WHEN 'config' THEN 0.82 WHEN 'export' THEN 0.72 WHEN 'test' THEN 0.66 ELSE 0.58 END END AS mult FROM c3),
c5 AS (SELECT *, greatest(0, round(least(1, greatest(0, score)) * mult + owner, 9)) AS adj FROM c4)
SELECT qid, path, role, round(owner, 4)::DOUBLE AS owner, round(least(1, adj / max(adj) OVER (PARTITION BY qid) * max(score) OVER (PARTITION BY qid)), 6)::DOUBLE AS score,
 CAST(row_number() OVER (PARTITION BY qid ORDER BY adj DESC, round(owner, 4) DESC, r0, path) AS INTEGER) AS rank FROM c5)"""


@query(f"SELECT qid, path, role, owner FROM {RERANK}")
def x17_owner_scores(spark, sf_dir):
    return policy.rerank(candidates(spark)).select("qid", "path", "role", "owner")


@query(f"SELECT qid, path, role, owner, score, rank FROM {RERANK}")
def x18_rerank(spark, sf_dir):
    """With L1, the order by several keys."""
    return policy.rerank(candidates(spark)).select("qid", "path", "role", "owner", R6("score"), "rank")


@query(f"SELECT qid, path, round(score / lag(score) OVER (PARTITION BY qid ORDER BY score DESC, path), 6) AS step, round(score - lead(score) OVER (PARTITION BY qid ORDER BY score DESC, path), 6) AS gap FROM {VC}")
def w4_cliffs(spark, sf_dir):
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "path")
    return made(spark, CANDIDATES, CAND).select("qid", "path", F.round(F.col("score") / F.lag("score").over(w), 6).alias("step"), F.round(F.col("score") - F.lead("score").over(w), 6).alias("gap"))


RANKED = "(SELECT qid, path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM " + VC + ")"


def ranked(spark):
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "path")
    return made(spark, CANDIDATES, CAND).withColumn("rank", F.row_number().over(w))


def dynamic(k: int, ratio: float, floor: float, cliff: float) -> str:
    return f"""(SELECT qid, path, n FROM (SELECT *, min(CASE WHEN n > {k} AND (score < greatest({floor}, top * {ratio}) OR (prev > 0 AND score / prev < {cliff})) THEN n END) OVER (PARTITION BY qid) AS cut FROM
 (SELECT *, rank AS n, lag(score) OVER (PARTITION BY qid ORDER BY rank) AS prev, first_value(score) OVER (PARTITION BY qid ORDER BY rank) AS top FROM {RANKED})) WHERE n <= 12 AND (cut IS NULL OR n < cut))"""


@query(" UNION ALL ".join(f"SELECT '{c}' AS confidence, qid, path FROM {dynamic(*a)}" for c, a in (("high", (3, 0.55, 0.24, 0.64)), ("medium", (3, 0.5, 0.18, 0.58)), ("low", (5, 0.35, 0.1, 0.45)))))
def l3_dynamic_top_k(spark, sf_dir):
    """With W5, the cut at the first failure."""
    out = None
    for c in ("high", "medium", "low"):
        part = policy.dynamic_top_k(ranked(spark), c).select(F.lit(c).alias("confidence"), "qid", "path")
        out = part if out is None else out.union(part)
    return out


@query(f"""SELECT qid, path FROM (SELECT *, min(CASE WHEN (rank > 3 AND score < greatest(0.08, least(top * 0.52, top - 0.35))) OR (rank <= 3 AND score < 0.08) THEN rank END) OVER (PARTITION BY qid) AS cut FROM
 (SELECT *, first_value(score) OVER (PARTITION BY qid ORDER BY rank) AS top FROM {RANKED})) WHERE rank <= 10 AND (rank = 1 OR cut IS NULL OR rank < cut)""")
def l4_smart_top_k(spark, sf_dir):
    return policy.smart_top_k(ranked(spark)).select("qid", "path")


@query(f"SELECT qid, path, role FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY role IN ('test', 'documentation', 'config', 'export'), rank) AS n FROM {RERANK}) WHERE n <= 4")
def l5_support_quota(spark, sf_dir):
    return policy.support_quota(policy.rerank(candidates(spark)), 4).select("qid", "path", "role")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= greatest(24, 3 * 10)")
def l6_candidate_cap(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(24, 3 * 10)).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT conv_id, w, CAST(rn AS INTEGER) AS rn FROM (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY regexp_matches(w, '^[a-z]') DESC, length(w) DESC, w) AS rn FROM (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}|\\p{Han}{2,}')) AS w FROM conversations)) WHERE rn <= 24""")
def l7_scoring_terms(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", F.explode(E(text.found("lower(text)", r"[a-z]{2,}|\p{IsHan}{2,}"))).alias("w")).distinct()
    o = Window.partitionBy("conv_id").orderBy(E("w rlike '^[a-z]'").desc(), F.length("w").desc(), "w")
    return w.withColumn("rn", F.row_number().over(o)).where("rn <= 24")


CLAUSE = [(1, 1, "a.ts", 0.9, 1), (1, 1, "b.ts", 0.5, 2), (1, 2, "B.ts", 0.8, 1), (1, 2, "c.ts", 0.2, 2), (1, 2, "b.ts", 0.1, 3), (2, 1, "x.go", 1.4, 1)]
LEVELS = [(1, "high"), (1, "low"), (2, "high"), (2, "high"), (3, "low")]


@query(f"SELECT qid, path, round(least(1, 0.82 * rrf / max(rrf) OVER (PARTITION BY qid) + 0.18 * least(1, best)), 6)::DOUBLE AS score, clauses FROM (SELECT qid, lower(path) AS path, sum(1.0::DOUBLE / (32 + rank)) AS rrf, max(score) AS best, count(DISTINCT clause) AS clauses FROM {values(CLAUSE, 'qid int, clause int, path string, score double, rank int')} GROUP BY ALL)")
def m2_clause_rrf(spark, sf_dir):
    """With W8, ranks by clause."""
    return fusion.fuse_clauses(made(spark, CLAUSE, "qid int, clause int, path string, score double, rank int")).select("qid", "path", R6("score"), "clauses")


@query(f"SELECT qid, CASE WHEN bool_and(confidence = 'high') THEN 'high' WHEN bool_or(confidence IN ('high', 'medium')) THEN 'medium' ELSE 'low' END AS confidence FROM {values(LEVELS, 'qid int, confidence string')} GROUP BY qid")
def m2_clause_confidence(spark, sf_dir):
    return fusion.clause_confidence(made(spark, LEVELS, "qid int, confidence string"))


RADAR = [(1, "graph", "src/a.ts", 0.9, 1), (1, "graph", "tests/a.test.ts", 0.8, 2), (1, "hybrid", "src/a.ts", 0.4, 1), (1, "hybrid", "lib/b.ts", 0.3, 2), (1, "hybrid", "SRC/a.ts", 0.2, 3), (1, "vector", "docs/c.md", 0.7, 1), (10, "graph", "tests/a.test.ts", 0.8, 1), (10, "vector", "src/x.ts", 0.6, 1)]
RAD = "qid int, source string, path string, score double, rank int"


@query(f"""WITH r AS (SELECT qid, source, lower(path) AS path, score, rank, max(score) OVER (PARTITION BY qid, source) AS top, row_number() OVER (PARTITION BY qid, source, lower(path) ORDER BY rank) AS n FROM {values(RADAR, RAD)}),
s AS (SELECT qid, path, sum((CASE source WHEN 'graph' THEN 1.05 WHEN 'hybrid' THEN 1.0 ELSE 0.92 END)::DOUBLE * (0.8 / (12 + rank) + 0.2 * score / top / 13)) + CASE WHEN count(DISTINCT source) >= 2 THEN 0.15 / 13 ELSE 0 END AS s, count(DISTINCT source) AS sources FROM r WHERE n = 1 GROUP BY qid, path),
m AS (SELECT qid, path, sources, s * CASE WHEN (regexp_matches(path, '(^|/)(scripts?|tests?|__tests__|fixtures?|benchmarks?|docs?)(/|$)') OR regexp_matches(path, '\\.(test|spec)\\.[^.]+$')) AND NOT regexp_matches(lower(q), '\\b(?:test|tests|spec|script|scripts|fixture|benchmark|docs?|documentation)\\b|测试|脚本|基准|文档') THEN 0.68 WHEN regexp_matches(path, '^(src|app|lib|pkg|packages)/') THEN 1.08 ELSE 1 END AS s FROM s JOIN {VQ} USING (qid))
SELECT qid, path, round(s / max(s) OVER (PARTITION BY qid), 6) AS score, sources FROM m""")
def m3_radar_rrf(spark, sf_dir):
    rows = made(spark, RADAR, RAD).join(made(spark, QUERIES_, "qid int, q string"), "qid")
    return fusion.fuse_radars(rows).select("qid", "path", R6("score"), "sources")


MERGE = [(1, "A.ts", 0.5, ["x", "y"], "graph"), (1, "a.ts", 0.7, ["z", "x"], "hybrid"), (1, "b.ts", 0.2, [], "vector"), (2, "a.ts", 0.1, ["q"], "graph")]
MER = "qid int, path string, score double, symbols array<string>, source string"


@query(f"SELECT qid, arg_max(path, (score, path)) AS path, max(score) AS score, array_to_string(list_sort(list_distinct(flatten(list(symbols)))), '|') AS symbols, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources FROM {values(MERGE, 'qid int, path string, score double, symbols list, source string').replace('[]', '[]::VARCHAR[]')} GROUP BY qid, lower(path)")
def m4_merge_candidates(spark, sf_dir):
    """With A15 and J15, ordered distinct sets and the merge by path."""
    out = policy.merge_candidates(made(spark, MERGE, MER))
    return out.select("qid", "path", "score", F.array_join("symbols", "|").alias("symbols"), F.array_join("sources", "|").alias("sources"))


@query()
def m5_rank_and_select(spark, sf_dir):
    """The policy whole: rerank, cut-off, quota; its parts have oracles of their own."""
    return policy.select(candidates(spark)).select("qid", "path", R6("score"), "role", "rank")


REMOTE = [(1, "src/server.ts", 0), (1, "src/new.ts", 1), (3, "z.ts", 40)]


@query(f"SELECT qid, lower(path) AS path, max(score)::DOUBLE AS score FROM (SELECT * FROM {VC} UNION ALL SELECT qid, path, round(greatest(0.2, 0.98 - 0.03 * pos), 6)::DOUBLE FROM {values(REMOTE, 'qid int, path string, pos int')}) GROUP BY qid, lower(path)")
def m6_remote_union(spark, sf_dir):
    """With U5, the union without dropping tails."""
    return fusion.with_remote(made(spark, CANDIDATES, CAND), made(spark, REMOTE, "qid int, path string, pos int")).select("qid", "path", R6("score"))


@query(f"SELECT qid, source, CAST(radar_order AS INTEGER) AS radar_order, path, score FROM (SELECT qid, 'graph' AS source, 0 AS radar_order, path, score FROM {VC} WHERE score > 0.5 UNION ALL SELECT qid, 'hybrid', 1, path, score FROM {VC} WHERE score <= 0.5)")
def u6_radar_union(spark, sf_dir):
    c = made(spark, CANDIDATES, CAND)
    return fusion.radar_union(graph=c.where("score > 0.5"), hybrid=c.where("score <= 0.5"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(['a/**', 'b/**'], [source || '/**', 'a/**']))), '|') AS excluded FROM documents")
def u7_exclude_merge(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E("array_join(array_sort(array_union(array('a/**', 'b/**'), array(concat(source, '/**'), 'a/**'))), '|')").alias("excluded"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 7 = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def u3_changed_or_deleted(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select("doc_id").union(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")).distinct()


@query(f"SELECT qid, round(max(score) FILTER (rank = 1), 6) AS top, round(max(score) FILTER (rank = 2), 6) AS second, round(max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), 0), 6) AS margin FROM {RANKED} GROUP BY qid")
def w7_score_margins(spark, sf_dir):
    return fusion.margins(made(spark, CANDIDATES, CAND)).select("qid", R6("top"), R6("second"), R6("margin"))


@query("""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term, unnest(range(10000)) AS pos FROM conversations)
SELECT conv_id AS qid, term, CAST(place AS INTEGER) AS place FROM (SELECT conv_id, term, row_number() OVER (PARTITION BY conv_id ORDER BY pos, turn, term) AS place FROM (SELECT conv_id, term, min((pos, turn)).pos AS pos, min((pos, turn)).turn AS turn FROM (SELECT conv_id, term, pos, turn FROM t WHERE term IS NOT NULL) GROUP BY conv_id, term)) WHERE place <= 64""".replace("min((pos, turn)).pos", "arg_min(pos, pos * 100000 + turn)").replace("min((pos, turn)).turn", "arg_min(turn, pos * 100000 + turn)"))
def w9_round_robin(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("clause"), F.posexplode(E(text.found("lower(text)", "[a-z]+"))).alias("pos", "term"))
    return lexical.round_robin(t)


# ---- ranges over the lines of documents

SPANS = "(SELECT l_suppkey AS k, CAST(l_partkey AS BIGINT) AS s, CAST(l_partkey + l_quantity AS BIGINT) AS e FROM lineitem)"
ISLANDS = """(SELECT k, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN reach IS NULL OR s > reach + {gap} THEN 1 ELSE 0 END AS fresh FROM
 (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {of} WHERE s >= 1 AND e >= s))) GROUP BY k, island)"""


def spans(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").cast("long").alias("s"), E("cast(rint(l_partkey + l_quantity) as bigint)").alias("e"))  # to the nearest, as the SQL casts


@query(f"SELECT k, s, e FROM {ISLANDS.format(gap=5, of=SPANS)}")
def w11_range_merge(spark, sf_dir):
    return ranges.merge(spans(spark, sf_dir), ["k"], 5)


@query("""WITH RECURSIVE o AS (SELECT l_suppkey AS k, CAST(l_partkey AS BIGINT) AS s, CAST(l_partkey + l_quantity AS BIGINT) AS e, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, CAST(l_partkey + l_quantity AS BIGINT)) AS i FROM lineitem WHERE l_partkey >= 1),
m AS (SELECT k, i, s AS cs, e AS ce, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, CASE WHEN o.s > m.ce + 5 THEN o.s ELSE m.cs END, CASE WHEN o.s > m.ce + 5 THEN o.e WHEN m.n >= 3 THEN m.ce ELSE greatest(m.ce, o.e) END, CASE WHEN o.s > m.ce + 5 THEN m.n + 1 ELSE m.n END FROM m JOIN o ON o.k = m.k AND o.i = m.i + 1 WHERE m.n < 4 AND NOT (m.n >= 3))
SELECT k, cs AS s, max(ce) AS e FROM m WHERE n <= 3 GROUP BY k, cs""")
def w11_range_merge_capped(spark, sf_dir):
    return ranges.merge(spans(spark, sf_dir), ["k"], 5, 3)


FLAGGED = "(SELECT l_suppkey AS k, CAST(l_orderkey AS BIGINT) AS s, CAST(l_orderkey + l_linenumber AS BIGINT) AS e, l_returnflag AS flag FROM lineitem)"


@query(f"SELECT a.k, a.s, a.e FROM {FLAGGED} a WHERE a.flag = 'R' AND NOT EXISTS (SELECT 1 FROM {FLAGGED} b WHERE b.flag IS DISTINCT FROM 'R' AND b.k = a.k AND a.s <= b.e + 12 AND b.s <= a.e + 12)")
def j13_flags_apart(spark, sf_dir):
    """Over all of lineitem, rows of one l_returnflag against the others'."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").cast("long").alias("s"), E("cast(l_orderkey + l_linenumber as bigint)").alias("e"), F.col("l_returnflag").alias("flag"))
    own = E("flag <=> 'R'")
    return ranges.apart(r.where(own).drop("flag"), r.where(~own).drop("flag"), ["k"], 12)


def hits(spark, sf_dir):
    """Every line, with a made score."""
    n = F.max("ln").over(Window.partitionBy("path"))
    return lines(spark, sf_dir).select("path", "ln", "line", E("(length(line) % 7 + 1) / 4.0D").alias("score"), n.alias("n_lines"))


ALL_HITS = f"(SELECT path, ln, CAST(length(line) % 7 + 1 AS DOUBLE) / 4 AS score FROM {LINES})"


@query(f"SELECT a.path, a.ln, round(a.score + sum(CASE WHEN b.ln = a.ln THEN 0 WHEN abs(a.ln - b.ln) <= 12 THEN b.score * (1 - abs(a.ln - b.ln) / 16.0::DOUBLE) * 0.7 ELSE b.score * 0.12 END), 8) AS near FROM {ALL_HITS} a JOIN {ALL_HITS} b ON a.path = b.path AND abs(a.ln - b.ln) <= 40 GROUP BY a.path, a.ln, a.score")
def j14_all_line_bands(spark, sf_dir):
    return ranges.near_scores(hits(spark, sf_dir), ["path"]).select("path", "ln", F.round("near", 8).alias("near"))


@query()
def l8_greedy_windows(spark, sf_dir):
    """Sequential by nature; tests hold it against a plain loop."""
    h = hits(spark, sf_dir)
    near = ranges.near_scores(h, ["path"]).withColumn("near", F.round("near", 9)).join(h.select("path", "ln", "n_lines"), ["path", "ln"])
    return ranges.greedy_windows(near, ["path"])


RTERMS = [(1, "command", 0.5), (1, "parse", 0.9), (2, "local", 1.2), (2, "running", 0.3), (3, "none", 1.0)]
ALIAS = [(t, a, w) for ts, as_, w in (("command commands cmd cmds", "command commands cmd cmds toolargs", 0.85), ("execute executed execution exec run runs running", "exec execute executor await", 0.9), ("parse parsed parsing", "parse args toolargs json", 0.75), ("local locally", "local", 0.6)) for t in ts.split() for a in as_.split()]


@query(f"SELECT qid, term, max(weight)::DOUBLE AS weight FROM (SELECT * FROM {values(RTERMS, 'qid int, term string, weight double')} UNION ALL SELECT qid, a, w FROM {values(RTERMS, 'qid int, term string, weight double')} JOIN {values(ALIAS, 'trig string, a string, w double', 'b')} ON term = trig) GROUP BY qid, term")
def x25_range_aliases(spark, sf_dir):
    return ranges.range_terms(made(spark, RTERMS, "qid int, term string, weight double"))


CODE_LINES = [("a.ts", 1, "const command = await run(args);"), ("a.ts", 2, "// command line only"), ("a.ts", 3, "if (parse === command) return commands;"), ("a.ts", 4, "- prompt parse"), ("a.ts", 5, "reparsed text"), ("a.ts", 6, "key"), ("a.ts", 7, "nothing here"), ("b.ts", 1, "* command command command command")]
LTERMS = [(1, "command", 1.0), (1, "parse", 0.8), (1, "key", 0.5)]
CODELIKE = "(regexp_matches(t, '^(?:const|let|var|if|else if|for|while|switch|case|return|await|try|catch|throw|function|class|import|export)\\b') OR regexp_matches(t, '[{};=]'))"


@query(f"""SELECT qid, path, ln, round(score, 6)::DOUBLE AS score, hits FROM (SELECT qid, path, ln, hits, raw * CASE WHEN regexp_matches(t, '^//|^/?\\*') THEN 0.5 ELSE 1 END * CASE WHEN regexp_matches(t, '^[-#*>]|^\\[TOOL_CALLS\\]|(?i)^"?(?:command\\d+|include|exclude|required|optional)\\b') THEN 0.38 ELSE 1 END * CASE WHEN {CODELIKE} THEN 1.35 ELSE 1 END
 * CASE WHEN hits = 1 AND one IN ('id', 'key') THEN 0.18 ELSE 1 END + CASE WHEN {CODELIKE} AND regexp_matches(t, '\\bif\\s*\\(.*===') THEN 0.9 ELSE 0 END + CASE WHEN {CODELIKE} AND regexp_matches(t, '\\bawait\\b.*\\(') THEN 0.65 ELSE 0 END + CASE WHEN {CODELIKE} AND regexp_matches(t, '\\b(?:const|let|var)\\b.*=') THEN 0.25 ELSE 0 END + CASE WHEN hits > 1 THEN (hits - 1) * 0.4 ELSE 0 END AS score
 FROM (SELECT qid, path, ln, trim(line) AS t, min(term) AS one, count(*) AS hits, sum(weight * CASE WHEN n > 0 THEN 1.1 + least(n, 3) * 0.18 ELSE 0.58 END) AS raw FROM (SELECT *, len(regexp_extract_all(lower(line), '\\b' || term || '\\b')) AS n FROM {values(CODE_LINES, 'path string, ln int, line string')}, {values(LTERMS, 'qid int, term string, weight double', 'w')} WHERE contains(lower(line), term)) GROUP BY ALL)) WHERE score >= 0.25""".replace("GROUP BY ALL", "GROUP BY qid, path, ln, line"))
def x24_line_scores(spark, sf_dir):
    out = ranges.line_scores(made(spark, CODE_LINES, "path string, ln int, line string"), made(spark, LTERMS, "qid int, term string, weight double"))
    return out.select("qid", "path", "ln", R6("score"), "hits")


# ---- output and tools

@query(f"SELECT lang, path, CAST(place AS INTEGER) AS place, n > 30 AS more FROM (SELECT lang, path, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, path) AS place, count(*) OVER (PARTITION BY lang) AS n FROM {FILES}) WHERE place > 20 AND place <= 30")
def l9_page(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("n", F.length("text"))
    return output.page(f, ["lang"], [F.desc("n"), "path"], 20, 10).select("lang", "path", "place", "more")


@query(f"SELECT path, ln, ln || ':' || line AS shown, CASE WHEN n > 8 THEN 9 END AS next FROM (SELECT path, ln, line, max(ln) OVER (PARTITION BY path) AS n FROM {LINES}) WHERE ln BETWEEN 4 AND 8")
def l10_line_page(spark, sf_dir):
    """With T-readfile."""
    return output.read_file(lines(spark, sf_dir), 4, None, 5)


@query(f"SELECT CAST(max(lv) AS INTEGER) AS depth FROM (SELECT lv, sum(b) OVER (ORDER BY lv) AS total FROM (SELECT lv, sum(strlen(node) + 1) AS b FROM (SELECT DISTINCT lv, array_to_string(list_slice(string_split(path, '/'), 1, lv), '/') AS node FROM {FILES}, (VALUES (1), (2), (3)) AS l(lv)) GROUP BY lv)) WHERE total <= 2000")
def l11_map_depth(spark, sf_dir):
    return output.map_depth(output.tree(files(spark, sf_dir).select("path"), 3), 2000, 3)


@query("SELECT doc_id, CAST(ln AS INTEGER) AS ln, CAST(used AS BIGINT) AS used FROM (SELECT doc_id, ln, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln) AS used FROM " + LINES + ") WHERE used <= 300")
def k6a_budget_cut(spark, sf_dir):
    return output.budget_cut(lines(spark, sf_dir), ["doc_id"], 300).select("doc_id", "ln", "used")


@query("SELECT lang, CAST(count(*) FILTER (doc_id % 3 = 0) AS BIGINT) AS owners, CAST(count(*) FILTER (doc_id % 3 <> 0) AS BIGINT) AS related FROM documents GROUP BY lang")
def k7_role_composition(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(E("doc_id % 3 = 0")).alias("owners"), F.count_if(E("doc_id % 3 <> 0")).alias("related"))


@query(f"SELECT path, ln, line, path || ':' || ln || ':' || line AS hit FROM {LINES} WHERE regexp_matches(line, 'license|Licensed') AND starts_with(path, 'src1') AND NOT regexp_matches(path, '/de/')")
def t_rg(spark, sf_dir):
    return output.rg(lines(spark, sf_dir), "license|Licensed", "src1*/**", "**/de/**")


@query(f"SELECT split_part(path, '/', 2) AS name, bool_or(true) AS is_folder FROM {FILES} WHERE starts_with(path, 'src3/') GROUP BY name")
def t_ls(spark, sf_dir):
    return output.ls(files(spark, sf_dir).select("path"), "src3")


@query(f"SELECT node, CAST(count(*) AS BIGINT) AS files, CAST(len(string_split(node, '/')) AS INTEGER) AS level FROM (SELECT array_to_string(list_slice(string_split(path, '/'), 1, lv), '/') AS node FROM {FILES}, (VALUES (1), (2)) AS l(lv)) GROUP BY node")
def t_tree(spark, sf_dir):
    return output.tree(files(spark, sf_dir).select("path"), 2)


@query(f"SELECT path FROM {FILES} WHERE regexp_matches(path, '^src[0-9]/en/doc_[^/]*\\.md$') ORDER BY path LIMIT 100")
def t_glob(spark, sf_dir):
    return output.glob(files(spark, sf_dir).select("path"), "src[0-9]/en/doc_*.md")


COMMANDS = [("command1", "rg", "a:1:x"), ("command10", "ls", "x"), ("command2", "tree", "y"), ("command3", "rg", "")]


@query(f"SELECT string_agg('<' || k || '>' || out, '' ORDER BY k) AS result, CAST(count(*) AS BIGINT) AS commands, CAST(count(*) FILTER (kind = 'rg') AS BIGINT) AS rg FROM {values(COMMANDS, 'k string, kind string, out string')}")
def t_exec(spark, sf_dir):
    """Results of parallel commands in order of their keys, with A21, counts by type."""
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "out"))), lambda x: F.concat(F.lit("<"), x["k"], F.lit(">"), x["out"])), "")
    return made(spark, COMMANDS, "k string, kind string, out string").agg(rows.alias("result"), F.count("*").alias("commands"), F.count_if(F.col("kind") == "rg").alias("rg"))


TOOLS = [("t1", '[TOOL_CALLS]search[ARGS]{"q": "a}b", "n": [1, 2,],}', "search", '{"n":[1,2],"q":"a}b"}'), ("t2", "no call", None, None), ("t3", 'x [TOOL_CALLS] exec [ARGS] {"c": {"d": "\\"{"}} tail', "exec", '{"c":{"d":"\\"{"}}'), ("t4", '[TOOL_CALLS]bad[ARGS]{"q": ', None, None)]


@query("SELECT id, name, args FROM " + values(TOOLS, "id string, t string, name string, args string"))
def x42_tool_calls(spark, sf_dir):
    """A scan for balanced braces, as a pandas UDF; expected rows by hand."""
    return made(spark, [(a, b) for a, b, _, _ in TOOLS], "id string, t string").withColumn("c", parse.tool_calls("t")).select("id", "c.name", "c.args")


OUTPUTS = [("c1", "readfile", "a.ts", "10:x\n11:y\n12:z\n[continuation]"), ("c2", "rg", "", "a.ts:3:foo\nlib/b.ts:40:bar\nnoise"), ("c3", "rg", "", "(no matches)")]


@query("SELECT * FROM " + values([("c1", "a.ts", 10, 12), ("c2", "a.ts", 1, 18), ("c2", "lib/b.ts", 25, 55)], "call string, path string, s int, e int"))
def x44_evidence(spark, sf_dir):
    return output.evidence(made(spark, OUTPUTS, "call string, kind string, path string, output string"))


TURNS = [(1, "k1", 0, 50), (2, "k1", 50, 100), (2, "k2", 0, 10), (3, "k3", 0, None)]


@query("SELECT a.key, a.next AS page FROM " + values(TURNS, "turn int, key string, start int, next int", "a") + " WHERE a.next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM " + values(TURNS, "turn int, key string, start int, next int", "b") + " WHERE b.key = a.key AND b.start = a.next AND b.turn > a.turn)")
def x45_pending_pages(spark, sf_dir):
    return output.pending(made(spark, TURNS, "turn int, key string, start int, next int"))


ISSUES = [("hybrid", True, "x"), ("hybrid", False, "file_limit"), ("hybrid", False, "read_error"), ("graph", True, ""), ("vector", False, "disabled")]


@query(f"SELECT provider, bool_and(ok) AS complete, coalesce(string_agg(DISTINCT issue, '|' ORDER BY issue) FILTER (NOT ok), '') AS issues FROM {values(ISSUES, 'provider string, ok boolean, issue string')} GROUP BY provider")
def a17_coverage(spark, sf_dir):
    return output.coverage(made(spark, ISSUES, "provider string, ok boolean, issue string"))


@query("""WITH r AS (SELECT source AS id, CAST(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), e AS (SELECT CAST(doc_id AS VARCHAR) AS path FROM labels WHERE quality = 1)
SELECT id, count(*) AS pool_count, CAST(0 AS BIGINT) AS pool_saturation, least(12, count(*)) AS result_count, CAST(min(rank) FILTER (path IN (SELECT path FROM e)) AS INTEGER) AS pool_rank, CAST(min(rank) FILTER (rank <= 12 AND path IN (SELECT path FROM e)) AS INTEGER) AS result_rank,
 coalesce(min(rank) FILTER (rank <= 12 AND path IN (SELECT path FROM e)) <= 3, false) AS owner_top3, coalesce(min(rank) FILTER (rank <= 12 AND path IN (SELECT path FROM e)) <= 5, false) AS owner_top5, min(rank) FILTER (path IN (SELECT path FROM e)) IS NULL AS recall_failure,
 min(rank) FILTER (path IN (SELECT path FROM e)) IS NOT NULL AND coalesce(min(rank) FILTER (rank <= 12 AND path IN (SELECT path FROM e)) > 5, true) AS ranking_failure FROM r GROUP BY id""")
def a18_quality(spark, sf_dir):
    """With Q10, the first rank of an expected owner."""
    return policy.quality(*_quality_input(spark, sf_dir))


def _quality_input(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    pool = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.col("doc_id").cast("string").alias("path"), F.row_number().over(w).alias("pos"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("path"))
    return pool, pool.where("pos <= 12").withColumnRenamed("pos", "rank"), pool.join(good, "path").select("id", "path")


@query("""WITH r AS (SELECT source AS id, CAST(doc_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), e AS (SELECT CAST(doc_id AS VARCHAR) AS path FROM labels WHERE quality = 1),
m AS (SELECT id, least(12, count(*)) AS n, min(rank) FILTER (path IN (SELECT path FROM e)) AS pool_rank, min(rank) FILTER (rank <= 12 AND path IN (SELECT path FROM e)) AS rr FROM r GROUP BY id)
SELECT count(*) AS total, count(*) FILTER (rr <= 3) AS owner_top3, count(*) FILTER (rr <= 5) AS owner_top5, count(*) FILTER (pool_rank IS NULL) AS recall_failure, count(*) FILTER (pool_rank IS NOT NULL AND (rr IS NULL OR rr > 5)) AS ranking_failure, CAST(0 AS BIGINT) AS pool_saturation, round(avg(n), 6) AS average_results FROM m""")
def a18_quality_totals(spark, sf_dir):
    return policy.quality_totals(policy.quality(*_quality_input(spark, sf_dir)))


# ---- vectors

VA = "(SELECT a.vec_id AS qid, b.vec_id AS id, 'group' || b.label AS path, round(list_inner_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"
VAR = f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {VA} WHERE score >= 0.25 QUALIFY rank <= 32)"


def batch_hits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    stored = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("group"), "label").alias("path"), "embedding")
    return vector.in_blocks(q, lambda block: vector.search(stored, block))


@query(f"SELECT qid, id, path, score, CAST(rank AS INTEGER) AS rank FROM {VAR}")
def l2_vector_topk_batch(spark, sf_dir):
    """With F4, the floor, and S10, stored vectors; every fiftieth vector asks."""
    return batch_hits(spark, sf_dir)


@query(f"SELECT qid, path, round(least(1, max(score) + 0.04 * least(3, count(*) - 1)), 6)::DOUBLE AS score, count(*) AS hits, array_to_string(list_slice(list(id ORDER BY rank), 1, 3), ',') AS ids FROM {VAR} GROUP BY qid, path")
def a12_vector_collapse_batch(spark, sf_dir):
    out = vector.collapse(batch_hits(spark, sf_dir))
    return out.select("qid", "path", R6("score"), "hits", E("array_join(transform(ids, x -> string(x)), ',')").alias("ids"))


@query()
def x39_embed(spark, sf_dir):
    """Word pieces (X38), mean pooling and length one over a small made vocabulary; held against plain Python in tests."""
    import numpy as np

    vocabulary = {w: i for i, w in enumerate(["[UNK]", "the", "th", "##e", "##er", "##on", "in", "er", "a", "on", "re", "##re", "##in", "##ing", ".", ","])}
    embed = vector.embedder(spark, vocabulary, np.random.default_rng(1).normal(size=(len(vocabulary), 8)))
    return table(spark, sf_dir, "benchmark").select("item_id", embed(E(text.bert_words("text"))).alias("embedding"))


@query()
def x35_vector_units(spark, sf_dir):
    """Texts cut into embedding units; a sequential rule, held against its bounds in tests."""
    return vector.split_units(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text"))


DECIDE = [
    (1, "balanced", "symbol", False, True, "high", 0.6, 2, 3, "a", True, 0.8, 0.5, 0.5, 2, 3, "a", 0.1, "z"), (2, "quality", "semantic", False, True, "high", 0.5, 2, 3, "a", True, 0.3, 0.2, 0.3, 1, 3, "b", 0.7, "b"), (3, "fast", "complex", False, True, "high", 0.5, 2, 2, "a", True, 0.2, 0.1, 0.3, 1, 3, "c", 0.0, ""),
    (4, "balanced", "semantic", True, True, "medium", 0.3, 1, 3, "a", True, 0.5, 0.2, 0.3, 2, 3, "b", 0.5, "x"), (5, "balanced", "exact", False, False, "low", 0.0, 0, 3, "", True, 0.5, 0.3, 0.3, 1, 2, "b", 0.0, ""), (6, "balanced", "impact", False, True, "high", 0.49, 1, 1, "a", False, 0.0, 0.0, 0.0, 0, 1, "", 0.0, ""),
    (7, "quality", "symbol", False, True, "medium", 0.36, 2, 3, "v", False, 0.0, 0.0, 0.0, 0, 1, "", 0.62, "v"),
]
DEC = "id int, profile string, kind string, cjk boolean, graph_used boolean, graph_conf string, graph_cov double, graph_hit int, graph_total int, graph_path string, hybrid_used boolean, hybrid_score double, hybrid_second double, hybrid_cov double, hybrid_hit int, hybrid_total int, hybrid_path string, vector_score double, vector_path string"
DSQL = f"""(SELECT *, (graph_path = hybrid_path AND gs AND rel) OR (vs AND ((vector_path = graph_path AND (gs OR gm)) OR (vector_path = hybrid_path AND rel))) AS agree FROM (SELECT *,
 graph_used AND graph_conf = 'high' AND graph_cov >= CASE profile WHEN 'quality' THEN 0.62 WHEN 'fast' THEN 0.45 ELSE 0.48 END AND graph_hit >= CASE WHEN graph_total <= 1 THEN 1 ELSE 2 END AS gs, graph_used AND graph_conf = 'medium' AND graph_cov >= CASE profile WHEN 'quality' THEN 0.36 ELSE 0.28 END AS gm,
 hybrid_used AND hybrid_hit >= 1 AND hybrid_cov >= CASE WHEN hybrid_total <= 1 THEN 0.5 ELSE 0.2 END AS rel, hybrid_used AND hybrid_score >= CASE profile WHEN 'fast' THEN 0.55 WHEN 'quality' THEN 0.75 ELSE 0.72 END AND hybrid_cov >= CASE WHEN hybrid_total <= 1 THEN 0.75 ELSE 0.35 END AND hybrid_hit >= CASE WHEN hybrid_total <= 1 THEN 1 ELSE 2 END AS hs,
 hybrid_used AND hybrid_hit >= 1 AND hybrid_cov >= CASE WHEN hybrid_total <= 1 THEN 0.5 ELSE 0.2 END AND hybrid_score >= CASE profile WHEN 'fast' THEN 0.3 WHEN 'quality' THEN 0.4 ELSE 0.32 END AS okk,
 hybrid_used AND hybrid_hit >= 1 AND hybrid_cov >= CASE WHEN hybrid_total <= 1 THEN 0.5 ELSE 0.2 END AND hybrid_score >= CASE profile WHEN 'fast' THEN 0.45 WHEN 'quality' THEN 0.62 ELSE 0.48 END AND hybrid_score - hybrid_second >= CASE profile WHEN 'quality' THEN 0.18 ELSE 0.1 END AS win, vector_score >= 0.62 AS vs FROM {values(DECIDE, DEC)}))"""


@query(f"""SELECT id, gs OR gm OR rel OR vs AS always, CASE WHEN kind = 'complex' THEN agree OR (gs AND okk) OR (profile = 'fast' AND gs AND rel) ELSE ((agree AND kind IN ('semantic', 'symbol', 'exact')) OR (gs AND kind IN ('symbol', 'exact', 'impact')) OR (gs AND kind = 'semantic' AND profile <> 'quality') OR (hs AND kind IN ('semantic', 'symbol'))
 OR (gs AND okk) OR (profile <> 'quality' AND kind IN ('semantic', 'symbol') AND (gs OR gm) AND okk) OR (profile <> 'quality' AND win AND kind IN ('semantic', 'symbol', 'exact'))) AND (NOT cjk OR agree) END AS skip_remote FROM {DSQL}""")
def x48_local_first(spark, sf_dir):
    return made(spark, DECIDE, DEC).select("id", E(routes.local_first("on")).alias("always"), E(routes.local_first()).alias("skip_remote"))


HINTS = [(1, "hybrid", 0.5, 0.1, 0), (2, "hybrid", 0.3, 0.3, 2), (3, "hybrid", 0.3, 0.3, 1), (4, "vector", 0.42, 0.0, 0), (5, "vector", 0.41, 1.0, 9), (6, "graph", 0.1, 0.9, 3)]


@query(f"SELECT id, CASE radar WHEN 'hybrid' THEN score >= 0.4 OR (coverage >= 0.3 AND matched >= 2) WHEN 'vector' THEN score >= 0.42 ELSE true END AS accepted FROM {values(HINTS, 'id int, radar string, score double, coverage double, matched int')}")
def f5_hint_gate(spark, sf_dir):
    return made(spark, HINTS, "id int, radar string, score double, coverage double, matched int").select("id", E("case radar when 'hybrid' then score >= 0.4 or (coverage >= 0.3 and matched >= 2) when 'vector' then score >= 0.42 else true end").alias("accepted"))


EVENTS = [("a", 1, 5, "src/x.ts", "calls"), ("b", 0, 3, "src/y.ts", "calls"), ("c", 4, 2, "../z", "imports"), ("d", 2, 9, "src/w.ts", "unknown"), ("e", 3, 3, "src/v.ts", "tests")]


@query(f"SELECT id, s, e, path, kind FROM {values(EVENTS, 'id string, s int, e int, path string, kind string')} WHERE s >= 1 AND e >= s AND kind IN ('imports', 'exports', 'reexports', 'calls', 'routes_to', 'tests', 'implements') AND NOT starts_with(path, '..')")
def f8_result_normaliser(spark, sf_dir):
    """With Z12 and Z19: only valid ranges, known kinds and paths below the root stay."""
    r = made(spark, EVENTS, "id string, s int, e int, path string, kind string")
    return r.where("s >= 1 and e >= s and kind in ('imports', 'exports', 'reexports', 'calls', 'routes_to', 'tests', 'implements')").where(paths.inside("path"))


@query(f"SELECT path, path || ':' || 1 || '-' || least(n, 24) || ' chars=' || length(text) AS hint FROM (SELECT path, text, len(regexp_split_to_array(text, '\\r?\\n')) AS n FROM {FILES})")
def z11_hint_lines(spark, sf_dir):
    """With K6, lines of text for files."""
    return files(spark, sf_dir).select("path", E("concat(path, ':1-', least(size(split(text, '\\r?\\n')), 24), ' chars=', length(text))").alias("hint"))


@query(f"SELECT id, CASE WHEN packages >= 4 AND depth >= 3 THEN 2 ELSE depth END AS depth FROM {values([(1, 5, 4), (2, 3, 4), (3, 4, 2)], 'id int, packages int, depth int')}")
def z14_tree_depth(spark, sf_dir):
    return made(spark, [(1, 5, 4), (2, 3, 4), (3, 4, 2)], "id int, packages int, depth int").select("id", E("if(packages >= 4 and depth >= 3, 2, depth)").alias("depth"))


FRAMES = [(1, 0, "short"), (1, 1, "a longer piece of text"), (1, 2, "[TOOL_CALLS]x[ARGS]{}"), (2, 0, "first long enough text"), (2, 1, "tiny"), (2, 2, "second long enough")]


@query(f"SELECT id, coalesce(arg_min(t, n) FILTER (contains(t, '[TOOL_CALLS]')), coalesce(string_agg(t, '' ORDER BY n) FILTER (length(t) > 10), '')) AS answer FROM {values(FRAMES, 'id int, n int, t string')} GROUP BY id")
def q11_response_assembly(spark, sf_dir):
    f = made(spark, FRAMES, "id int, n int, t string")
    long = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.length("t") > 10, F.struct("n", "t")))), lambda x: x["t"]), "")
    return f.groupBy("id").agg(F.coalesce(F.min_by("t", F.when(F.contains("t", F.lit("[TOOL_CALLS]")), F.col("n"))), long).alias("answer"))


@query("SELECT sha256('{\"chunk_lines\":72,\"chunk_overlap\":16}') AS config_hash")
def q8_config_hash(spark, sf_dir):
    return spark.range(1).select(F.sha2(F.to_json(F.struct(F.lit(72).alias("chunk_lines"), F.lit(16).alias("chunk_overlap"))), 256).alias("config_hash"))


@pandas_udf(T.ArrayType(T.IntegerType()))
def config_bounds(texts: pd.Series) -> pd.Series:
    """First lines (from 1) of the units of a config file: an unindented line that is no comment starts one after three lines, and forty lines do."""

    def bounds(t: str) -> list[int]:
        out, at = [1], 1
        for n, line in enumerate((t or "").split("\n"), 1):
            top = line[:1] not in ("", " ", "\t", "#")
            if n > 1 and ((top and n - at >= 3) or n - at >= 40):
                out.append(n)
                at = n
        return out

    return texts.map(bounds)


CONFIGS = [("a.yaml", "a: 1\nb: 2\nc: 3\nd:\n  x: 1\n  y: 2\n# note\ne: 5\n"), ("b.toml", "\n".join("  k%d = 1" % i for i in range(100)))]


@query("SELECT * FROM " + values([("a.yaml", "1,4,8"), ("b.toml", "1,41,81")], "path string, bounds string"))
def x34_config_units(spark, sf_dir):
    return made(spark, CONFIGS, "path string, text string").select("path", F.array_join(F.transform(config_bounds("text"), lambda x: x.cast("string")), ",").alias("bounds"))
