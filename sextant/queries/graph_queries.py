"""The structural ranker (X26, X28-X31, J5-J11, J16, A8-A10, A13-A16, F3, W6, W10, Q3-Q5, X23) over small sources, parts as symbols and order lines as edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import fixed, paths, text
from ..operators import graph
from . import duck
from .base import LINES, lines, made, query, table, values

E = F.expr

SOURCES = [
    ("src/server.ts", "import { run } from './lib/run';\nimport type { A } from \"./types\";\nexport * from './util';\n// import x from './gone'\nexport async function startServer(port) {\n  const app = create();\n  router.get('/users', listUsers);\n  run(port);\n}\nexport class Server {\n  listen(port) {\n    return run(port);\n  }\n}\n"),
    ("src/lib/run.js", "const fs = require('fs');\nexport const run = (x) => x + 1;\nfunction helper(a) { return run(a); }\nlet later = async () => import('./lazy');\n/* block\nfunction hidden() {}\n*/\nenum Color { Red }\n"),
    ("src/util/index.ts", "export interface Opts { a: number }\nexport type Name = string;\nexport default function listUsers(req) { return helper(req); }\n"),
    ("src/types.ts", "export abstract class A {}\n"), ("src/lib/lazy.mjs", "export function lazy() {}\n"),
    ("src/server.test.ts", "import { startServer } from './server';\nstartServer(1);\n"),
    ("cmd/main.go", "package main\n\nimport (\n\t\"fmt\"\n\tlog \"my/log\"\n)\nimport \"os\"\n\nconst Limit = 3\ntype Store struct {}\ntype Reader interface {}\nfunc main() {\n\tfmt.Println(helper(1))\n}\nfunc (s *Store) Get(k string) int { return 1 }\n"),
    ("cmd/main_test.go", "package main\nfunc TestMain() { main() }\n"), ("docs/guide.md", "# Top\ntext\n## Sub one\nx\n## Sub two\n# Next\n"), ("tools/gen.py", "class Gen:\n    def make(self):\n        pass\nasync def go(): pass\n"),
    ("native/lib.rs", "pub fn open() {}\nstruct Inner;\npub(crate) fn close() {}\n"), ("Main.java", "public class Main {\n}\n"), ("a/x.rb", "module Foo\n  def bar\n  end\nend\n"),
]
SYMBOL_ROWS = [
    ("src/server.ts", 5, "startServer", "function", True), ("src/server.ts", 10, "Server", "class", True), ("src/server.ts", 11, "listen", "method", False), ("src/lib/run.js", 2, "run", "function", True), ("src/lib/run.js", 3, "helper", "function", False),
    ("src/lib/run.js", 4, "later", "function", False), ("src/lib/run.js", 8, "Color", "enum", False), ("src/util/index.ts", 1, "Opts", "interface", True), ("src/util/index.ts", 2, "Name", "type", True), ("src/util/index.ts", 3, "listUsers", "function", True),
    ("src/types.ts", 1, "A", "class", True), ("src/lib/lazy.mjs", 1, "lazy", "function", True), ("cmd/main.go", 9, "Limit", "const", True), ("cmd/main.go", 10, "Store", "class", True), ("cmd/main.go", 11, "Reader", "interface", True), ("cmd/main.go", 12, "main", "function", False),
    ("cmd/main.go", 15, "Get", "method", True), ("cmd/main_test.go", 2, "TestMain", "function", True), ("docs/guide.md", 1, "Top", "section", True), ("docs/guide.md", 3, "Sub one", "section", True), ("docs/guide.md", 5, "Sub two", "section", True), ("docs/guide.md", 6, "Next", "section", True),
    ("tools/gen.py", 1, "Gen", "class", True), ("tools/gen.py", 2, "make", "function", True), ("tools/gen.py", 4, "go", "function", True), ("native/lib.rs", 1, "open", "function", True), ("native/lib.rs", 2, "Inner", "class", False), ("native/lib.rs", 3, "close", "function", True),
    ("Main.java", 1, "Main", "class", True), ("a/x.rb", 1, "Foo", "class", True), ("a/x.rb", 2, "bar", "function", True),
]
SYM = "path string, ln int, name string, kind string, exported boolean"
VS, VY = values(SOURCES, "path string, text string"), values(SYMBOL_ROWS, SYM)


def sources(spark):
    return made(spark, SOURCES, "path string, text string")


def known(spark):
    return made(spark, SYMBOL_ROWS, SYM)


@query(f"SELECT path, ln, name, kind, exported FROM {VY}")
def x28_symbols(spark, sf_dir):
    """Symbol extraction against the symbols as read off the sources by hand."""
    return graph.symbols(sources(spark)).select("path", "ln", "name", "kind", "exported")


@query("SELECT * FROM " + values([("src/server.ts", 14, 0), ("src/lib/run.js", 8, 0), ("src/util/index.ts", 3, 0)], "path string, n_lines int, comment_words int"))
def x26_strip_comments(spark, sf_dir):
    clean = sources(spark).where("path in ('src/server.ts', 'src/lib/run.js', 'src/util/index.ts')").select("path", E(graph.strip_comments("text")).alias("t"))
    return clean.select("path", E("size(split(t, '\\n')) - 1").alias("n_lines"), E("size(regexp_extract_all(t, 'gone|hidden|block', 0))").alias("comment_words"))


@query("SELECT * FROM " + values([("src/server.ts", 5, 9), ("src/server.ts", 10, 14), ("src/server.ts", 11, 13), ("src/lib/run.js", 2, 2), ("src/lib/run.js", 3, 3), ("cmd/main.go", 12, 14)], "path string, ln int, block_end int"))
def x27_block_ends(spark, sf_dir):
    """Brace-balanced ends: a scan of characters, as a pandas UDF."""
    @pandas_udf("int")
    def ends(text_: pd.Series, ln: pd.Series) -> pd.Series:
        return pd.Series([graph.block_end(t, n) for t, n in zip(text_, ln, strict=True)])

    some = made(spark, [("src/server.ts", 5), ("src/server.ts", 10), ("src/server.ts", 11), ("src/lib/run.js", 2), ("src/lib/run.js", 3), ("cmd/main.go", 12)], "path string, ln int")
    return some.join(sources(spark), "path").select("path", "ln", ends("text", "ln").alias("block_end"))


IMPORT_ROWS = [("src/server.ts", "imports", "./lib/run", "src/lib/run.js"), ("src/server.ts", "imports", "./types", "src/types.ts"), ("src/server.ts", "reexports", "./util", "src/util/index.ts"), ("src/server.ts", "imports", "./gone", "external:./gone"), ("src/lib/run.js", "imports", "fs", "external:fs"), ("src/lib/run.js", "imports", "./lazy", "src/lib/lazy.mjs"), ("src/server.test.ts", "imports", "./server", "src/server.ts"), ("cmd/main.go", "imports", "fmt", "external:fmt"), ("cmd/main.go", "imports", "my/log", "external:my/log"), ("cmd/main.go", "imports", "os", "external:os")]


@query("SELECT path, kind, spec FROM " + values(IMPORT_ROWS, "path string, kind string, spec string, target string"))
def x29_imports(spark, sf_dir):
    return graph.imports(sources(spark))


@query(f"""
WITH i AS (SELECT path, kind, spec FROM {values(IMPORT_ROWS, 'path string, kind string, spec string, target string')}), c AS (SELECT path, kind, spec, o, array_to_string(list_filter(string_split(regexp_replace(path, '[^/]*$', '') || spec, '/'), lambda s: s NOT IN ('', '.')), '/') || ext AS target
 FROM i, (SELECT unnest(['', '.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts', '.go', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '/index.ts', '/index.tsx', '/index.mts', '/index.cts', '/index.go']) AS ext, unnest(range(19)) AS o) WHERE spec LIKE '.%')
SELECT i.path, i.kind, i.spec, coalesce(arg_min(c.target, c.o), 'external:' || i.spec) AS target FROM i LEFT JOIN (SELECT c.* FROM c JOIN {VS} ON c.target = t.path) c ON i.path = c.path AND i.kind = c.kind AND i.spec = c.spec GROUP BY i.path, i.kind, i.spec""")
def j9_import_targets(spark, sf_dir):
    return graph.resolve_imports(graph.imports(sources(spark)), sources(spark))


CALL_SQL = f"""(SELECT path, lower(callee) AS key, arg_min(callee, pos) AS callee, min(pos) AS pos FROM (SELECT path, unnest(cs) AS callee, unnest(range(len(cs))) AS pos FROM (SELECT path, regexp_extract_all(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', '', 'g'), '(?m)(^|[^:])//[^\\n]*', '\\1', 'g'), '\\b([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1) AS cs FROM {VS}))
  WHERE NOT list_contains({duck.stop_list(fixed.CODE_KEYWORDS)}, callee) GROUP BY path, lower(callee))"""


@query(f"SELECT path, key, callee FROM {CALL_SQL}")
def x30_calls(spark, sf_dir):
    return graph.calls(sources(spark)).select("path", "key", "callee")


@query(f"""
SELECT from_file, to_file, callee FROM (SELECT c.path AS from_file, y.path AS to_file, callee, row_number() OVER (PARTITION BY c.path ORDER BY c.pos, y.o) AS n FROM {CALL_SQL} c
 JOIN (SELECT key, path, row_number() OVER (PARTITION BY key ORDER BY path) AS o FROM (SELECT DISTINCT lower(name) AS key, path FROM {VY})) y ON c.key = y.key AND y.o <= 3) WHERE n <= 120""")
def j8_call_edges(spark, sf_dir):
    return graph.call_edges(graph.calls(sources(spark)), known(spark))


@query("SELECT 'src/server.ts' AS from_file, 'src/util/index.ts' AS to_file, 'GET /users' AS route, 'listUsers' AS handler")
def j10_route_edges(spark, sf_dir):
    return graph.route_edges(sources(spark), known(spark))


@query(f"""
SELECT a.path AS from_file, b.path AS to_file FROM {VS.replace(') AS t(', ') AS a(')} JOIN {VS.replace(') AS t(', ') AS b(')} ON regexp_replace(regexp_replace(list_last(string_split(a.path, '/')), '[._-](test|spec)(\\.)|_test(\\.go)', '\\2\\3'), '\\.([cm]?[jt]sx?|go)$', '') = regexp_replace(list_last(string_split(b.path, '/')), '\\.([cm]?[jt]sx?|go)$', '')
WHERE regexp_matches(a.path, '[._-](test|spec)\\.[cm]?[jt]sx?$|_test\\.go$') AND NOT regexp_matches(b.path, '[._-](test|spec)\\.[cm]?[jt]sx?$|_test\\.go$')""")
def j11_test_edges(spark, sf_dir):
    return graph.test_edges(sources(spark))


@query(f"SELECT path, CAST(count(*) AS BIGINT) AS bag FROM (SELECT DISTINCT path, w FROM (SELECT path, lower(unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]+'))) AS w FROM {VS} UNION ALL SELECT path, lower(unnest(regexp_extract_all(path, '[A-Za-z0-9]+'))) FROM {VS} UNION ALL SELECT path, kind FROM {VY})) GROUP BY path")
def x31_search_bag(spark, sf_dir):
    """The deduplicated bag of words that graph text search reads: source words, path parts, kinds of symbols."""
    s = sources(spark)
    words = s.select("path", F.explode(E(f"concat({text.found('text', '[A-Za-z_$][A-Za-z0-9_$]+')}, {text.found('path', '[A-Za-z0-9]+')})")).alias("w")).select("path", F.lower("w").alias("w"))
    return words.union(known(spark).select("path", "kind")).groupBy("path").agg(F.count_distinct("w").alias("bag"))


@query(f"""
WITH h AS (SELECT path, ln, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level FROM (SELECT path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, 40)) AS ln FROM {VS} WHERE path LIKE '%.md') WHERE regexp_matches(line, '^#{{1,6}}\\s'))
SELECT a.path, CAST(a.ln AS INTEGER) AS ln, CAST(coalesce(min(b.ln) - 1, 7) AS INTEGER) AS section_end FROM h a LEFT JOIN h b ON b.ln > a.ln AND b.level <= a.level AND a.path = b.path GROUP BY ALL""")
def w6_section_ends(spark, sf_dir):
    s = sources(spark).where("path like '%.md'")
    n = s.select("path", E("size(split(text, '\\n'))").alias("n_lines"))
    heads = s.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).where("line rlike '^#{1,6}\\\\s'").select("path", (F.col("at") + 1).alias("ln"), E("length(regexp_extract(line, '^(#{1,6})', 1))").alias("level"), "line").withColumnRenamed("line", "name")
    return graph.section_ends(heads, n).select("path", "ln", F.col("end").alias("section_end"))


@query(f"SELECT path, ln, name, CAST(greatest(ln, coalesce(lead(ln) OVER (PARTITION BY path ORDER BY ln, name) - 1, 50)) AS INTEGER) AS symbol_end, CAST(greatest(1, ln - 2) AS INTEGER) AS s, CAST(least(50, greatest(ln, coalesce(lead(ln) OVER (PARTITION BY path ORDER BY ln, name) - 1, 50)) + 4) AS INTEGER) AS e FROM {VY}")
def q5_symbol_ranges(spark, sf_dir):
    from ..operators import ranges

    n = known(spark).select("path").distinct().withColumn("n_lines", F.lit(50))
    return ranges.expand(graph.symbol_ends(known(spark), n)).select("path", "ln", "name", F.col("end").alias("symbol_end"), "s", "e")


# ---- order lines as edges: supplier -> part

KINDS = "CASE l_returnflag WHEN 'A' THEN 'tests' WHEN 'N' THEN 'calls' ELSE 'reexports' END"
EDGES = f"(SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, {KINDS} AS kind, l_orderkey, l_linenumber, l_quantity FROM lineitem)"


def edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), E(KINDS).alias("kind"), "l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT node, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing, CAST(count(*) FILTER (kind = 'tests') AS BIGINT) AS tests, CAST(count(*) FILTER (kind = 'reexports') AS BIGINT) AS exports FROM (SELECT src AS node, 0 AS i, 1 AS o, kind FROM {EDGES} UNION ALL SELECT dst, 1, 0, kind FROM {EDGES}) GROUP BY node")
def a13_edge_degrees(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query(f"SELECT src, kind, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(dst || '/' || l_orderkey || '/' || l_linenumber)), ',') AS kept FROM (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY l_orderkey, l_linenumber) AS k FROM {EDGES} QUALIFY k <= 8) GROUP BY src, kind")
def a14_evidence_groups(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("src", "kind").orderBy("l_orderkey", "l_linenumber")
    kept = edges(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 8")
    return kept.groupBy("src", "kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", "dst", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))), ",").alias("kept"))


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS distinct_edges FROM (SELECT DISTINCT kind, src, dst FROM {EDGES}) GROUP BY kind")
def a16_edge_dedupe(spark, sf_dir):
    return edges(spark, sf_dir).select("kind", "src", "dst").distinct().groupBy("kind").agg(F.count("*").alias("distinct_edges"))


@query(f"""SELECT src, dst, kind, l_orderkey, l_linenumber, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rn FROM
 (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS k FROM {EDGES}) WHERE kind <> 'calls' OR k <= 4) WHERE rn <= 20""")
def w10_top_calls(spark, sf_dir):
    order = [F.desc("l_quantity"), "l_orderkey", "l_linenumber"]
    out = graph.top_edges(edges(spark, sf_dir), 20, {"calls": 4}, order)
    return out.select("src", "dst", "kind", "l_orderkey", "l_linenumber", "rn")


@query(f"SELECT src AS node, round(sum(least(0.55, 0.28 * score)), 6) AS boost FROM {EDGES} JOIN (SELECT 'p' || p_partkey AS dst, p_retailprice / 2000.0 AS score FROM part) USING (dst) WHERE score >= 0.45 GROUP BY src")
def j16_hop_boost(spark, sf_dir):
    scores = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), (F.col("p_retailprice") / 2000.0).alias("score"))
    return graph.hop_boost(edges(spark, sf_dir), scores).select("node", F.round("boost", 6).alias("boost"))


@query(f"SELECT kind, CAST(count(*) AS BIGINT) AS both_ends FROM {EDGES} WHERE src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) AND dst IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 25) GROUP BY kind")
def j7_edge_node_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("src"))
    p = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("dst"))
    return edges(spark, sf_dir).join(s, "src", "left_semi").join(p, "dst", "left_semi").groupBy("kind").agg(F.count("*").alias("both_ends"))


TERMS = [(1, "almond"), (1, "steel"), (2, "small"), (2, "red"), (3, "brass"), (3, "nothing"), (4, "call"), (4, "test")]
VTERMS = values(TERMS, "qid int, term string", "q")
WORDS = "list_distinct(string_split(lower(p_name), ' '))"


def asked(spark):
    return made(spark, TERMS, "qid int, term string")


def symbol_hits(spark, sf_dir):
    """(qid, term, file, amount, reason): parts as files whose names are symbols."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("file"), F.lower("p_name").alias("name"), F.split(F.lower("p_name"), " ").alias("parts"))
    hit = p.join(F.broadcast(asked(spark)), E("name = term or array_contains(parts, term) or (length(term) >= 4 and contains(name, term))"))
    return hit.select("qid", "term", "file", E("case when name = term then 0.58D else 0.32D end").alias("base"))


@query(f"SELECT qid, term, 'p' || p_partkey AS file, CASE WHEN lower(p_name) = term THEN 0.58 ELSE 0.32 END::DOUBLE AS base FROM part, {VTERMS} WHERE lower(p_name) = term OR list_contains({WORDS}, term) OR (length(term) >= 4 AND contains(lower(p_name), term))")
def j5_symbol_terms(spark, sf_dir):
    return symbol_hits(spark, sf_dir)


@query(f"SELECT qid, term, kind, CAST(count(*) AS BIGINT) AS n FROM {EDGES}, {VTERMS} WHERE regexp_replace(replace(kind, '_', ''), 's$', '') = regexp_replace(replace(term, '_', ''), 's$', '') GROUP BY ALL")
def j6_edge_terms(spark, sf_dir):
    norm = "regexp_replace(replace({}, '_', ''), 's$', '')"
    return edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")).join(F.broadcast(asked(spark)), E(f"{norm.format('kind')} = {norm.format('term')}")).select("qid", "term", "kind", "n")


DFS = f"(SELECT term, CAST(count(DISTINCT p_partkey) AS BIGINT) AS df FROM {VTERMS} LEFT JOIN part ON list_contains({WORDS}, term) OR (length(term) >= 4 AND contains(lower(p_name), term)) GROUP BY term)"
WEIGHTS = f"(SELECT term, df, greatest(0.45, least(1.8, log2(((SELECT count(*) FROM part) + 1.0::DOUBLE) / (df + 1)) + 0.55)) AS weight FROM {DFS})"


def weights(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    return graph.term_weights(asked(spark), symbol_hits(spark, sf_dir).select("file", "term"), n)


@query(f"SELECT term, df, round(weight, 6) AS weight FROM {WEIGHTS}")
def a8_graph_idf(spark, sf_dir):
    return weights(spark, sf_dir).select("term", "df", F.round("weight", 6).alias("weight"))


CONTRIB = f"""(SELECT qid, 'p' || p_partkey AS file, term, weight * CASE WHEN lower(p_name) = term THEN 0.58 ELSE 0.32 END AS amount, 'symbol' AS reason FROM part, {VTERMS} JOIN {WEIGHTS} USING (term) WHERE lower(p_name) = term OR list_contains({WORDS}, term) OR (length(term) >= 4 AND contains(lower(p_name), term))
 UNION ALL SELECT qid, dst, term, weight * 0.12 * n, 'edge' FROM (SELECT dst, kind, count(*) AS n FROM {EDGES} GROUP BY ALL), {VTERMS} JOIN {WEIGHTS} USING (term) WHERE regexp_replace(kind, 's$', '') = term)"""


def scores(spark, sf_dir):
    w = F.broadcast(weights(spark, sf_dir))
    symbols = symbol_hits(spark, sf_dir).join(w, "term").select("qid", "file", E("weight * base").alias("amount"), F.lit("symbol").alias("reason"), "term")
    per = edges(spark, sf_dir).groupBy("dst", "kind").agg(F.count("*").alias("n"))
    by_edge = per.join(F.broadcast(asked(spark)), E("regexp_replace(kind, 's$', '') = term")).join(w, "term").select("qid", F.col("dst").alias("file"), E("weight * 0.12D * n").alias("amount"), F.lit("edge").alias("reason"), "term")
    return graph.contributions([symbols, by_edge])


@query(f"SELECT qid, file, round(sum(amount), 6) AS raw, array_to_string(list_sort(list_distinct(list(term))), '|') AS terms, array_to_string(list_sort(list_distinct(list(reason))), '|') AS reasons FROM {CONTRIB} GROUP BY qid, file")
def a9_graph_scores(spark, sf_dir):
    """With Z2, contributions added up by file."""
    return scores(spark, sf_dir).select("qid", "file", F.round("raw", 6).alias("raw"), F.array_join("terms", "|").alias("terms"), F.array_join("reasons", "|").alias("reasons"))


@query(f"SELECT qid, file, round(least(1, raw / greatest(top, 1)), 6) AS score FROM (SELECT qid, file, raw, max(raw) OVER (PARTITION BY qid) AS top FROM (SELECT qid, file, sum(amount) AS raw FROM {CONTRIB} GROUP BY qid, file)) WHERE raw >= greatest(0.16, 0.08 * top)")
def f3_graph_floor(spark, sf_dir):
    return graph.floored(scores(spark, sf_dir)).select("qid", "file", F.round("score", 6).alias("score"))


@query(f"SELECT qid, round(sum(weight) FILTER (term <> 'nothing') / sum(weight), 6) AS coverage FROM {VTERMS} JOIN {WEIGHTS} USING (term) GROUP BY qid")
def a10_query_coverage(spark, sf_dir):
    """With Z3, sums of term weights."""
    w = asked(spark).join(F.broadcast(weights(spark, sf_dir)), "term")
    return w.groupBy("qid").agg(F.round(F.sum(E("if(term <> 'nothing', weight, 0.0D)")) / F.sum("weight"), 6).alias("coverage"))


CONF = [(1, 0.9, 0.95, 1), (2, 0.85, 0.6, 2), (3, 0.5, 0.3, 2), (4, 0.5, 0.3, 1), (5, 0.1, 1.0, 5), (6, 0.9, 0.5, 1), (7, 0.34, 0.55, 1)]


@query(f"SELECT id, CASE WHEN top >= 0.8 AND ((cov >= 0.9 AND hit >= 1) OR (cov >= 0.52 AND hit >= 2)) THEN 'high' WHEN top >= 0.34 AND ((cov >= 0.55 AND hit >= 1) OR (cov >= 0.24 AND hit >= 2)) THEN 'medium' ELSE 'low' END AS confidence FROM {values(CONF, 'id int, top double, cov double, hit int')}")
def x23_graph_confidence(spark, sf_dir):
    return made(spark, CONF, "id int, top double, cov double, hit int").select("id", E(graph.confidence("top", "cov", "hit")).alias("confidence"))


ROLES = [("scripts/x.js", 0.8), ("src/server.ts", 0.5), ("src/a.ts", 0.4), ("lib/main.js", 0.3), ("docs/route.ts", 0.6)]


@query(f"""SELECT path, strong, round((CASE WHEN regexp_matches(path, '^(scripts|benchmarks|docs)/') THEN raw * 0.42 ELSE raw END) + CASE WHEN regexp_matches(path, '^(src|app|pages)/') THEN 0.08 ELSE 0 END
 + CASE WHEN regexp_matches(path, '(^|/)(server|index|main|app|route)\\.[cm]?[jt]sx?$') THEN CASE WHEN strong THEN 0.42 ELSE 0.22 END ELSE 0 END, 6)::DOUBLE AS score FROM {values(ROLES, 'path string, raw double')}, (VALUES (true), (false)) AS s(strong)""")
def q4_role_adjustment(spark, sf_dir):
    both = made(spark, ROLES, "path string, raw double").withColumn("strong", F.explode(E("array(true, false)")))
    return both.select("path", "strong", E(f"round({graph.role_adjusted('raw', 'path', 'false', 'true', 'strong')}, 6)").alias("score"))


Q3 = f"(SELECT src, dst, kind, n, src IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 5000) AS a, dst IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 40) AS b FROM (SELECT src, dst, kind, count(*) AS n FROM {EDGES} GROUP BY ALL))"


@query(f"""SELECT src, dst, kind, round(score, 6) AS score, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, kind, dst) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY score DESC, kind, dst) AS k FROM (
 SELECT src, dst, kind, round(CASE WHEN a AND b THEN CASE WHEN kind = 'reexports' THEN 1.2 ELSE 0.35 END ELSE 0.15 END + 0.9 * n * 0.1 + CASE WHEN kind = 'calls' THEN 0.7 ELSE 0 END + CASE WHEN kind = 'tests' THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score
 FROM {Q3} WHERE (a OR b) AND CASE WHEN kind = 'calls' THEN true ELSE a AND b END)) WHERE kind <> 'calls' OR k <= 4) WHERE rn <= 20""")
def q3_edge_selection(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.lit(True).alias("a"))
    p = table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("p"), "p_partkey").alias("dst"), F.lit(True).alias("b"))
    per = edges(spark, sf_dir).groupBy("src", "dst", "kind").agg(F.count("*").alias("n")).join(s, "src", "left").join(p, "dst", "left").na.fill(False, ["a", "b"])
    kept = per.where("a or b").where(E(graph.admitted("(a and b)", "kind", "false", "kind = 'calls'")))
    scored = kept.withColumn("score", F.round(E(graph.edge_score("(a and b)", "kind", "n * 0.1D", "kind = 'calls'")), 6))
    return graph.top_edges(scored, 20, {"calls": 4}, [F.desc("score"), "kind", "dst"]).select("src", "dst", "kind", "score", "rn")


REL = [("r1", "src/a.ts", "lib/b.ts", "calls"), ("r2", "tests/a.ts", "src/a.ts", "tests"), ("r3", "src/server.ts", "src/a.ts", "imports"), ("r4", "docs/a.md", "x.ts", "imports"), ("r5", "src/server.ts", "lib/b.ts", "calls")]
RANK = "CASE WHEN regexp_matches({0}, '(^|/)(server|index|main|app|route)\\.[cm]?[jt]sx?$') THEN 0 WHEN regexp_matches({0}, '^(tests|docs)/') THEN 2 ELSE 1 END"


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY {RANK.format('f')}, {RANK.format('t')}, kind || ':' || f || ':' || t) AS INTEGER) AS place FROM {values(REL, 'id string, f string, t string, kind string', 'x')} QUALIFY place <= 8")
def z10_relation_order(spark, sf_dir):
    from pyspark.sql import Window

    rank = "case when {entry} then 0 when {support} then 2 else 1 end"
    of = lambda c: E(rank.format(entry=paths.is_entry(c), support=text.has(c, "^(tests|docs)/")))
    w = Window.orderBy(of("f"), of("t"), F.concat_ws(":", "kind", "f", "t"))  # a query's own few relations
    return made(spark, REL, "id string, f string, t string, kind string").withColumn("place", F.row_number().over(w)).where("place <= 8").select("id", "place")


@query(f"SELECT path, CAST(count(*) FILTER (regexp_matches(line, '\\b(if|for|while|return)\\b')) AS BIGINT) AS code_lines, CAST(count(*) AS BIGINT) AS n FROM {LINES} GROUP BY path")
def a20_status_counts(spark, sf_dir):
    word = text.whole("if|for|while|return")
    return lines(spark, sf_dir).groupBy("path").agg(F.count_if(E(text.has("line", word))).alias("code_lines"), F.count("*").alias("n"))


@query()
def q2_graph_search(spark, sf_dir):
    """The structural ranker end to end over the sources as a project: symbols, edges, contributions, floor."""
    s = sources(spark)
    y = graph.symbols(s)
    q = made(spark, [(1, "server"), (1, "run"), (2, "users")], "qid int, term string")
    hit = y.join(F.broadcast(q), E(f"lower(name) = term or array_contains({text.identifier_parts('name')}, term)"))
    by_symbol = hit.select("qid", F.col("path").alias("file"), E("if(lower(name) = term, 0.58D, 0.32D)").alias("amount"), F.lit("symbol").alias("reason"), "term")
    by_path = s.join(F.broadcast(q), E("contains(lower(path), term)")).select("qid", F.col("path").alias("file"), F.lit(0.34).alias("amount"), F.lit("path").alias("reason"), "term")
    called = graph.call_edges(graph.calls(s), y).join(F.broadcast(q), E("contains(lower(callee), term)")).select("qid", F.col("to_file").alias("file"), F.lit(0.12).alias("amount"), F.lit("edge").alias("reason"), "term")
    return graph.floored(graph.contributions([by_symbol, by_path, called])).select("qid", "file", F.round("score", 6).alias("score"))


@query(f"SELECT path FROM {values([(p,) for p, _ in SOURCES], 'path string')} WHERE regexp_matches(path, '\\.([cm]?[jt]sx?|go)$')")
def z13_graph_gate(spark, sf_dir):
    return sources(spark).where(f"{paths.language('path')} is not null").select("path")




HINTED = [("src/server.ts", "", 4), ("src/lib/run.js", "", 3), ("src/lib/run.js", "implementation", 3), ("lib/parse.ts", "", 0), ("src/types.ts", "", 5), ("src/x.ts", "", 9), ("a.md", "documentation", 0), ("src/util/index.ts", "", 1), ("cmd/main.go", "", 6), ("src/m.ts", "entrypoint", 1)]
TOUCH = [("src/server.ts", "src/types.ts", "imports"), ("src/server.ts", "src/lib/run.js", "imports"), ("z.ts", "src/x.ts", "calls")]


@query(f"""SELECT path, role, CASE WHEN role = 'entrypoint' THEN 'entrypoints' WHEN role = 'implementation' THEN 'implementations' WHEN role <> '' THEN 'helpers' WHEN regexp_matches(path, '(^|/)(server|index|main|app|route)\\.[cm]?[jt]sx?$') THEN 'entrypoints'
 WHEN rank > 0 AND regexp_matches(path, '(^|/)(helpers?|utils?|lib|shared|config)(/|$)|(^|/)(extract|parse|format|normalize|resolve|load|read|write|config|credential|key|client|provider)[\\w-]*\\.[cm]?[jt]sx?$|(helper|util|config|credential|key|client|provider)[\\w-]*\\.[cm]?[jt]sx?$') THEN 'helpers'
 WHEN rank <= 2 OR path IN (SELECT dst FROM {values(TOUCH, 'src string, dst string, kind string', 'e')} WHERE kind = 'imports' AND regexp_matches(src, '(^|/)(server|index|main|app|route)\\.[cm]?[jt]sx?$')) THEN 'implementations'
 WHEN path IN (SELECT dst FROM {values(TOUCH, 'src string, dst string, kind string', 'e')} UNION SELECT src FROM {values(TOUCH, 'src string, dst string, kind string', 'e')}) THEN 'helpers' ELSE 'implementations' END AS listed FROM {values(HINTED, 'path string, role string, rank int')}""")
def x51_hint_groups(spark, sf_dir):
    e = made(spark, TOUCH, "src string, dst string, kind string")
    imported = e.where("kind = 'imports'").where(paths.is_entry("src")).select(F.col("dst").alias("path"), F.lit(True).alias("imported")).distinct()
    touched = e.select(F.explode(F.array("src", "dst")).alias("path")).distinct().withColumn("touched", F.lit(True))
    h = made(spark, HINTED, "path string, role string, rank int").join(imported, "path", "left").join(touched, "path", "left").na.fill(False, ["imported", "touched"])
    return h.select("path", "role", E(paths.hint_group("path", "role", "rank", "imported", "touched")).alias("listed"))


GRAMS = "(SELECT w, unnest(list_distinct(list_transform(range(1, length(w) + 1), lambda i: substr('^' || w || '$', i, 3)))) AS g FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part))"


@query(f"SELECT a.w AS q, b.w AS v, count(*) AS shared FROM {GRAMS} a JOIN {GRAMS} b ON a.g = b.g AND a.w < b.w GROUP BY a.w, b.w")
def u4_shared_trigrams(spark, sf_dir):
    """Sizes of intersections of trigram sets, by a join on the trigram."""
    g = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct().select("w", F.explode(E(text.trigrams("w"))).alias("g"))
    return g.select(F.col("w").alias("q"), "g").join(g.select(F.col("w").alias("v"), "g"), "g").where("q < v").groupBy("q", "v").agg(F.count("*").alias("shared"))


@query()
def z6_term_ranges(spark, sf_dir):
    """Lines scored by terms, their neighbourhoods, greedy windows: the parts have oracles of their own."""
    from ..operators import ranges

    terms = ranges.range_terms(made(spark, [(1, "run", 1.0), (1, "command", 0.8), (2, "router", 1.2)], "qid int, term string, weight double"))
    ls = sources(spark).select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("path", (F.col("at") + 1).alias("ln"), "line")
    scored = ranges.line_scores(ls, terms)
    n = ls.groupBy("path").agg(F.max("ln").alias("n_lines"))
    near = ranges.near_scores(scored, ["qid", "path"]).withColumn("near", F.round("near", 6)).join(n, "path")
    return ranges.greedy_windows(near, ["qid", "path"])
