"""Sources (S), predicates (F) and functions (X) over the test tables and small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, paths, routes, text
from ..operators import vector
from ..sources import tree
from . import duck
from .base import FILES, LINES, files, lines, made, query, table, values

E = F.expr

PATHS = [
    ("src/server.ts",), ("src/routes/index.tsx",), ("tests/readme.md",), ("docs/guide/intro.html",), ("lib/user_test.go",), ("lib/user.go",), ("config/app.yaml",), ("package.json",), (".env.local",),
    ("scripts/compare.mjs",), ("app/main.py",), ("pkg/mod.rs",), ("README",), ("web/__tests__/a.js",), ("benchmarks/bench_sort.cpp",), ("cmd/cli",), ("Dockerfile",), ("internal/Auth.Service.java",),
    ("src/app/worker.go",), ("node_modules/x/index.js",), ("build/out.js",), ("a/../../b.ts",), ("./a/b/../c.ts",), ("/etc/passwd",), ("C:\\x\\y.ts",), ("fixtures/sample.json",), ("src\\win\\path.ts",), ("src/mid-server.spec.ts",),
]
QUERIES_ = [
    (1, "where is the HTTP server entrypoint and then the token parser"), (2, "find `parseHTTPResponse` in src/net/http_client.ts; list callers"), (3, "梳理登录鉴权的完整流程，以及缓存失败重试"), (4, ""), (5, "who calls UserService.login and what is the impact"),
    (6, "how does the rate limit work end-to-end"), (7, "exact string match \"max_retry_count\""), (8, "docs and examples of config settings"), (9, "class named OrderBook with method submit_order_now"), (10, "test coverage for retry also fixtures; mock data\nsecond line"),
    (11, "谁调用了 createSession？数据库连接池在哪"), (12, "Explain why does the telemetry pipeline drop events when a very long request passes through the complete chain of handlers in order"),
    (13, "export barrel public api"), (14, "run local command parsing"), (15, "route handler dependencies"), (16, "grep literal a.b::c"), (17, "foo_bar_baz fooBarBaz FooBarBaz"),
]
TOKENS = [("parseHTTPResponseID2Value",), ("`foo_bar`",), ("src\\lib\\x.ts",), ("a",), ("(the)",), ("数据库连接",), ("x9$y",), ("HTTPServer.listen();",), ("the",), ("snake_case_name2",), ("é-accent",), ("ABC",), ("",), ("foo.barBaz",)]


def of_paths(spark):
    return made(spark, PATHS, "path string")


def of_queries(spark):
    return made(spark, QUERIES_, "qid int, q string")


VP, VQ, VT = values(PATHS, "path string"), values(QUERIES_, "qid int, q string"), values(TOKENS, "token string")


# ---- sources

EXT = "lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1))"
NAME = "lower(list_last(string_split(path, '/')))"


@query(f"""
SELECT path, size, rn FROM (
  SELECT path, size, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS rn FROM (SELECT path, CAST(strlen(text) AS BIGINT) AS size FROM {FILES})
  WHERE list_contains({duck.stop_list(fixed.SOURCE_EXTENSIONS)}, {EXT}) AND size > 0 AND size <= 1000000
    AND NOT list_has_any(string_split(path, '/'), {duck.stop_list(fixed.EXCLUDED_DIRS)})) WHERE rn <= 6000""")
def s1_project_scan(spark, sf_dir):
    return tree.scan(files(spark, sf_dir)).select("path", "size", "rn")


@query(f"""
SELECT path, CASE WHEN ext IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN ext = 'go' THEN 'go' ELSE 'typescript' END AS language
FROM (SELECT path, {EXT} AS ext FROM {VP}) WHERE ext IN ('js','jsx','mjs','cjs','ts','tsx','mts','cts','go') AND NOT list_has_any(string_split(path, '/'), {duck.stop_list(fixed.EXCLUDED_DIRS)})""")
def s2_language_scan(spark, sf_dir):
    return tree.without_excluded(of_paths(spark)).withColumn("language", E(paths.language("path"))).where("language is not null")


@query(f"""
SELECT path FROM {VP} WHERE regexp_full_match({NAME}, '.*\\.ya?ml|.*\\.toml|dockerfile.*|caddyfile|package\\.json|tsconfig.*\\.json|\\.env\\.example')
  AND len(string_split(path, '/')) - 1 <= 3 ORDER BY path LIMIT 150""")
def s3_config_files(spark, sf_dir):
    return of_paths(spark).where(paths.is_config("path") + " and size(split(path, '/')) - 1 <= 3").orderBy("path").limit(150)


IGNORE = [("", 1, "*.log"), ("", 2, "/tmp/"), ("", 3, "src/**/gen"), ("", 4, "!src/keep.log"), ("src", 1, "secret.*"), ("src", 2, "!secret.md"), ("", 5, "cache?")]
IGNORED = [("a.log",), ("src/x.log",), ("src/keep.log",), ("tmp/a",), ("src/tmp/a",), ("src/a/b/gen/z.ts",), ("src/secret.key",), ("src/secret.md",), ("src/n/secret.md",), ("cache1/x",), ("cached/x",), ("caches",), ("ok.ts",), ("srcx/secret.key",)]
RULES = [("", 1, r"^(.*/)?[^/]*\.log(/.*)?$", False), ("", 2, r"^tmp/.*$", False), ("", 3, r"^src/(.*/)?gen(/.*)?$", False), ("", 4, r"^src/keep\.log(/.*)?$", True), ("src", 1, r"^(.*/)?secret\.[^/]*(/.*)?$", False), ("src", 2, r"^(.*/)?secret\.md(/.*)?$", True), ("", 5, r"^(.*/)?cache[^/](/.*)?$", False)]


HARD = [("a/__pycache__/x.pyc",), ("b.min.js",), ("src/x.min.css.map",), ("run.exe",), ("x/server.log",), (".idea/w.xml",), ("src/.vscode/s.json",), ("vendor/a.go",), ("src/vendors/a.go",), ("distx/a.js",), ("src/dist/a.js",), ("logs/a.txt",), ("minify.js",)]


@query(f"""
SELECT path, regexp_matches(path, '(^|/)(\\.git|\\.hg|\\.svn|\\.model-cache|node_modules|dist|build|out|coverage|\\.next|\\.nuxt|\\.svelte-kit|\\.turbo|\\.cache|__pycache__|\\.venv|venv|vendor|target|\\.codegraph|\\.codex|\\.ace-tool|\\.idea|\\.vscode)/')
    OR regexp_matches(path, '(^|/)[^/]*(\\.min\\.[^/]*|\\.exe|\\.log)(/|$)') AS ignored FROM (SELECT path FROM {values(HARD, 'path string')} UNION ALL SELECT path FROM {FILES})""")
def s4_hard_excludes(spark, sf_dir):
    both = made(spark, HARD, "path string").union(files(spark, sf_dir).select("path"))
    return both.withColumn("ignored", E(tree.is_hard_excluded("path")))


IGNORE_FILES = [("a.md", "text"), (".gitignore", "# made\n\n*.tmp\n!keep.tmp\r\n"), ("x.tmp", ""), ("keep.tmp", ""), ("src/.ignore", "gen/\nkeep.tmp"), ("src/gen/a.ts", ""), ("src/keep.tmp", ""), ("gen/a.ts", ""), ("src/y.tmp", ""), ("z.exe", "")]


@query(f"SELECT path, path IN ('x.tmp', 'src/gen/a.ts', 'src/keep.tmp', 'src/y.tmp', 'z.exe') AS ignored FROM {values(IGNORE_FILES, 'path string, body string')}")
def s4_discovered_rules(spark, sf_dir):
    """Rules are read from the project's own ignore files."""
    tree_files = made(spark, IGNORE_FILES, "path string, text string")
    return tree.with_ignored(tree_files).select("path", "ignored")


@query(f"""
SELECT path, coalesce(arg_max(NOT neg, length(dir) * 1000 + seq), false) AS ignored FROM {values(IGNORED, 'path string')}
LEFT JOIN {values(RULES, 'dir string, seq int, pattern string, neg boolean', 'r')}
  ON (dir = '' OR starts_with(path, dir || '/')) AND regexp_matches(CASE WHEN dir = '' THEN path ELSE substr(path, length(dir) + 2) END, pattern) GROUP BY path""")
def s4_ignore_rules(spark, sf_dir):
    return tree.ignored(made(spark, IGNORED, "path string"), IGNORE).select("path", "ignored")


GUARD = [("a.md", "fine text"), ("b.bin", "nul\x00here"), ("c.txt", "\x01\x02\x03abc"), ("d.txt", "tab\tline\nok\x07" + "x" * 50), ("e.txt", ""), ("f.txt", "a\x7fb" + "y" * 30)]
STRIP = "regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
GUARD_SQL = "(SELECT path, replace(replace(replace(replace(replace(replace(t, '<0>', chr(0)), '<1>', chr(1)), '<2>', chr(2)), '<3>', chr(3)), '<7>', chr(7)), '<d>', chr(127)) AS text FROM " + values(
    [(p, t.replace("\x00", "<0>").replace("\x01", "<1>").replace("\x02", "<2>").replace("\x03", "<3>").replace("\x07", "<7>").replace("\x7f", "<d>")) for p, t in GUARD], "path string, t string") + ")"


@query(f"SELECT path, strpos(text, chr(0)) > 0 OR length(text) - length({STRIP}) > 0.1 * length(text) AS binary_file, {STRIP} AS clean FROM (SELECT path, text FROM {FILES} UNION ALL SELECT * FROM {GUARD_SQL})")
def s5_text_guard(spark, sf_dir):
    both = files(spark, sf_dir).select("path", "text").union(made(spark, GUARD, "path string, text string"))
    return both.select("path", E(text.is_binary("text")).alias("binary_file"), E(text.sanitized("text")).alias("clean"))


@query(f"SELECT path, sha256(length(path) || ':' || path || length(text) || ':' || text) AS content_hash FROM {FILES}")
def s6_content_hash(spark, sf_dir):
    return files(spark, sf_dir).select("path", E(text.content_hash("path", "text")).alias("content_hash"))


@query(f"""
SELECT source, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS total_size, CAST(max(doc_id) AS BIGINT) AS newest,
  sha1(string_agg(path || ':' || strlen(text) || ':' || doc_id, '' ORDER BY path)) AS signature FROM {FILES} GROUP BY source""")
def s7_source_signature(spark, sf_dir):
    return tree.signature(files(spark, sf_dir).select("source", "path", F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("mtime")), "source")


@query(f"SELECT dir AS root, CAST(count(*) AS BIGINT) AS packages, count(*) >= 2 AS monorepo FROM (SELECT DISTINCT source AS dir, lang AS pkg FROM {FILES}) GROUP BY dir")
def s12_monorepo(spark, sf_dir):
    return tree.packages(files(spark, sf_dir).select("path"))


@query(f"SELECT path, ln, line, lower(line) AS lowered FROM {LINES}")
def s13_file_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("path", "ln", "line", F.lower("line").alias("lowered"))


@query(f"SELECT path FROM {FILES} WHERE starts_with(path, 'src1/en/')")
def s14_path_filter(spark, sf_dir):
    return tree.below(files(spark, sf_dir).select("path"), "src1/en")


# ---- predicates

@query(f"SELECT path, list_contains({duck.stop_list(fixed.SOURCE_EXTENSIONS)}, {EXT}) OR list_contains({duck.stop_list(fixed.CONFIG_NAMES)}, {NAME}) AS is_source FROM {VP}")
def f1_source_predicate(spark, sf_dir):
    return of_paths(spark).select("path", E(paths.is_source("path")).alias("is_source"))


@query(f"""
SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
WHERE length(word) >= 2 AND NOT list_contains({duck.stop_list(fixed.STOP_WORDS)}, word) GROUP BY word""")
def f2_useful_terms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(E(text.found("lower(text)", "[a-z]+"))).alias("word"))
    return words.where((F.length("word") >= 2) & ~F.col("word").isin(fixed.STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""
SELECT path, NOT (regexp_matches(path, '^([/\\\\]|[A-Za-z]:)')) AND (SELECT min(d) >= 0 FROM (SELECT sum(step) OVER (ORDER BY i) AS d FROM
  (SELECT i, CASE WHEN s IN ('', '.') THEN 0 WHEN s = '..' THEN -1 ELSE 1 END AS step FROM (SELECT unnest(string_split(replace(path, '\\', '/'), '/')) AS s, unnest(range(100)) AS i) WHERE s IS NOT NULL))) AS inside FROM {VP}""")
def f6_inside_root(spark, sf_dir):
    return of_paths(spark).select("path", E(paths.inside("path")).alias("inside"))


RANGES = [(1, 5, 9), (1, 0, 3), (1, 7, 6), (1, 10, 12), (1, 14, 20), (2, 1, 1), (2, 3, 4), (2, 30, 31), (2, 100, 120), (3, 5, 5), (3, 2, 40), (3, 41, 60), (3, 66, 70), (3, 200, 210), (3, 205, 220)]


@query(f"SELECT id, s, e FROM {values(RANGES, 'id int, s int, e int')} WHERE s >= 1 AND e >= s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, e) <= 3")
def f7_valid_ranges(spark, sf_dir):
    df = made(spark, RANGES, "id int, s int, e int")
    kept = df.groupBy("id").agg(E("slice(array_sort(filter(collect_list(struct(s, e)), r -> r.s >= 1 and r.e >= r.s)), 1, 3)").alias("rs"))
    return kept.select("id", F.inline("rs"))


@query("SELECT vec_id, least(1, greatest(0, coalesce(x, 0))) AS clamped, round(x, 4) AS rounded FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS x FROM embeddings)")
def f9_clamp_round(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 10).alias("x"))
    return x.select("vec_id", E("least(1.0D, greatest(0.0D, coalesce(x, 0.0D)))").alias("clamped"), F.round("x", 4).alias("rounded"))


@query(f"""
SELECT path, regexp_matches(path, '^(scripts|benchmarks|docs)/') AS tooling, regexp_matches(path, '^(src|app|pages)/') AS runtime,
  regexp_matches(path, '(^|/)(server|index|main|app|route)\\.[cm]?[jt]sx?$') AS entry FROM {VP}""")
def f10_path_predicates(spark, sf_dir):
    return of_paths(spark).select("path", E(paths.is_tooling("path")).alias("tooling"), E(paths.is_runtime("path")).alias("runtime"), E(paths.is_entry("path")).alias("entry"))


@query(f"SELECT qid, len(regexp_extract_all(q, '[一-鿿]')) >= 4 AND NOT regexp_matches(q, '[A-Za-z_$][A-Za-z0-9_$]{{2,}}') AS cjk FROM {VQ}")
def f11_cjk_dominant(spark, sf_dir):
    return of_queries(spark).select("qid", E(routes.is_cjk_dominant("q")).alias("cjk"))


@query(f"SELECT qid, regexp_matches(lower(q), '\\.(py|rs|java|kt|rb|php|cs)\\b') AND NOT regexp_matches(lower(q), '\\.([cm]?[jt]sx?|go)\\b') AS other_language FROM {VQ}")
def f12_language_target(spark, sf_dir):
    other = f"{text.has('lower(q)', r'\.(py|rs|java|kt|rb|php|cs)(?![a-z0-9_])')} and not {text.has('lower(q)', r'\.([cm]?[jt]sx?|go)(?![a-z0-9_])')}"
    return of_queries(spark).select("qid", E(other).alias("other_language"))


# ---- text functions

def sorted_list(x: str):
    return E(f"array_join(array_sort({x}), '|')")


@query(f"SELECT token, array_to_string({duck.parts('token')}, '|') AS parts, array_to_string({duck.parts('token', '_$')}, '|') AS graph_parts FROM {VT}")
def x1_identifier_parts(spark, sf_dir):
    """With X32, the variant that keeps _ and $."""
    return made(spark, TOKENS, "token string").select("token", E(f"array_join({text.identifier_parts('token')}, '|')").alias("parts"), E(f"array_join({text.identifier_parts('token', '_$')}, '|')").alias("graph_parts"))


@query(f"SELECT token, {duck.text_list('list_distinct(' + duck.forms('token', fixed.STOP_WORDS) + ')')} AS forms FROM {VT}")
def x2_expand_token(spark, sf_dir):
    return made(spark, TOKENS, "token string").select("token", sorted_list(text.expand_token("token", fixed.STOP_WORDS)).alias("forms"))


TECH = "list_concat(regexp_extract_all(q, '`([^`\\r\\n]{1,160})`', 1), regexp_extract_all(q, '(?:[A-Za-z]:)?(?:[.@\\w$-]+[\\\\/])+[.@\\w$-]+'), regexp_extract_all(q, '\\b[A-Za-z_$][\\w$]*(?:[._-][A-Za-z0-9_$@-]+)+\\b'), regexp_extract_all(q, '\\b(?:[A-Z][a-z0-9]+){2,}[A-Za-z0-9]*\\b'), regexp_extract_all(q, '\\b[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\\b'))"


@query(f"SELECT qid, {duck.text_list('list_distinct(' + TECH + ')')} AS tokens FROM {VQ}")
def x3_technical_tokens(spark, sf_dir):
    return of_queries(spark).select("qid", sorted_list(text.technical_tokens("q")).alias("tokens"))


NATURAL = "regexp_extract_all(q, '[A-Za-z_$][\\w$]*|[0-9]+|\\p{Han}{1,8}')"
BIGRAMS = "flatten(list_transform(regexp_extract_all(q, '\\p{Han}{2,}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))"


@query(f"SELECT qid, coalesce({duck.text_list('list_distinct(list_concat(flatten(list_transform(' + NATURAL + ', lambda w: ' + duck.forms('w') + ')), ' + BIGRAMS + '))')}, '') AS terms FROM {VQ}")
def x4_natural_terms(spark, sf_dir):
    return of_queries(spark).select("qid", sorted_list(text.natural_terms("q")).alias("terms"))


@query(f"SELECT qid, array_to_string({BIGRAMS}, '|') AS bigrams FROM {VQ}")
def x5_han_bigrams(spark, sf_dir):
    return of_queries(spark).select("qid", E(f"array_join({text.han_bigrams('q')}, '|')").alias("bigrams"))


CLAUSES = "list_filter(list_transform(regexp_split_to_array(trim(q), '(?i)(?:\\r?\\n+|[。！？!?；;]+|\\s+(?:and\\s+then|then|also|plus)\\s+|(?:并且|同时|以及|然后|另外|此外|还要|并查找|并定位))'), lambda p: regexp_replace(trim(p), '^[,，、:\\s]+|[,，、:\\s]+$', '', 'g')), lambda p: p <> '')"


@query(f"SELECT conv_id, turn, CAST(i AS INTEGER) AS clause, cs[i] AS part FROM (SELECT conv_id, turn, cs, unnest(range(1, len(cs) + 1)) AS i FROM (SELECT conv_id, turn, {CLAUSES} AS cs FROM (SELECT conv_id, turn, text AS q FROM conversations UNION ALL SELECT -qid, 0, q FROM {VQ})))")
def x6_clause_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("q")).union(of_queries(spark).select((-F.col("qid")).cast("long"), F.lit(0).cast("long"), "q"))
    return c.select("conv_id", "turn", F.posexplode(E(text.clauses("q"))).alias("i", "part")).select("conv_id", "turn", (F.col("i") + 1).alias("clause"), "part")


@query(f"SELECT qid, coalesce({duck.text_list('list_distinct(list_concat(flatten(list_transform(list_concat(' + TECH + ', ' + NATURAL + '), lambda w: ' + duck.forms('w', fixed.STOP_WORDS) + ')), ' + BIGRAMS + '))')}, '') AS terms FROM {VQ}")
def x7_query_terms(spark, sf_dir):
    return of_queries(spark).select("qid", sorted_list(text.query_terms("q", fixed.STOP_WORDS, 500)).alias("terms"))


@query(f"""
SELECT doc_id, coalesce({duck.text_list('list_distinct(flatten(list_transform(ws, lambda w: ' + duck.forms('w', fixed.STOP_WORDS) + ')))')}, '') AS terms
FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z_$][\\w$]+|[0-9]{{2,}}')) AS ws FROM documents)""")
def x8_index_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sorted_list(text.index_terms("text", fixed.STOP_WORDS, 10_000_000)).alias("terms"))


BRIDGE = [("登录", "login"), ("登录", "auth"), ("鉴权", "auth"), ("数据库", "database"), ("数据库连接池", "pool"), ("连接", "connection"), ("缓存", "cache"), ("缓存失败", "miss"), ("重试", "retry"), ("流程", "flow")]


@query(f"""
SELECT DISTINCT qid, en AS term FROM (SELECT qid, unnest(regexp_extract_all(q, '数据库连接池|缓存失败|数据库|登录|鉴权|连接|缓存|重试|流程')) AS zh FROM {VQ}) JOIN {values(BRIDGE, 'k string, en string', 'b')} ON zh = k""")
def x9_bridge_terms(spark, sf_dir):
    """The dictionary is a parameter: a table (source word, term)."""
    from ..operators.lexical import bridge

    return bridge(of_queries(spark), made(spark, BRIDGE, "k string, en string"), "qid", "q").select("qid", "term")


@query(f"""
SELECT qid, q || coalesce(' ' || string_agg(en, ' ' ORDER BY en), '') AS augmented FROM (SELECT DISTINCT qid, q, en FROM (SELECT qid, q, unnest(list_concat(regexp_extract_all(q, '数据库连接池|缓存失败|数据库|登录|鉴权|连接|缓存|重试|流程'), ['-'])) AS zh FROM {VQ}) LEFT JOIN {values(BRIDGE, 'k string, en string', 'b')} ON zh = k) GROUP BY qid, q""")
def x10_bridge_query(spark, sf_dir):
    from ..operators.lexical import bridge

    terms = bridge(of_queries(spark), made(spark, BRIDGE, "k string, en string"), "qid", "q").groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("ts"))
    return of_queries(spark).join(terms, "qid", "left").select("qid", F.concat_ws(" ", "q", F.array_join(F.coalesce("ts", F.array()), " ", None)).alias("x"), "ts", "q").select("qid", F.when(F.col("ts").isNull(), F.col("q")).otherwise(F.col("x")).alias("augmented"))


CONCEPTS = [(g, m) for g, ms in enumerate(fixed.CONCEPT_GROUPS) for m in ms.split()]


@query(f"""
SELECT DISTINCT qid, b.m AS term FROM {VQ} JOIN {values(CONCEPTS, 'g int, m string', 'a')} ON contains(lower(q), a.m) JOIN {values(CONCEPTS, 'g int, m string', 'b')} ON a.g = b.g""")
def x11_concept_expand(spark, sf_dir):
    from ..operators.lexical import concepts

    return concepts(of_queries(spark), "qid", "q")


@query(f"SELECT token, {duck.text_list('list_distinct(list_transform(range(1, greatest(2, length(g) - 1)), lambda i: substr(g, i, 3)))')} AS grams FROM (SELECT token, '^' || token || '$' AS g FROM {VT})")
def x12_trigrams(spark, sf_dir):
    return made(spark, TOKENS, "token string").select("token", sorted_list(text.trigrams("token")).alias("grams"))


PART_WORDS = "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part"


@query(f"""
WITH v AS (SELECT w, list_distinct(list_transform(range(1, greatest(2, length(w) + 1)), lambda i: substr('^' || w || '$', i, 3))) AS g FROM ({PART_WORDS}))
SELECT a.w AS q, b.w AS v, round(CASE WHEN a.w = b.w THEN 1.0 WHEN contains(a.w, b.w) OR contains(b.w, a.w) THEN 0.82
  WHEN abs(length(a.w) - length(b.w)) <= greatest(5, length(a.w)) AND 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) >= 0.42 THEN 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) ELSE 0 END, 6) AS sim
FROM v a, v b WHERE sim > 0""")
def x13_similarity(spark, sf_dir):
    from ..operators.lexical import fuzzy_pairs

    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()
    return fuzzy_pairs(words.select(F.col("w").alias("q")), words.select(F.col("w").alias("v"))).select("q", "v", F.round("sim", 6).alias("sim"))


ROLE = """CASE WHEN regexp_matches(n, '(^|/)(tests?|__tests__|specs?|fixtures?|testdata|mocks?)(/|$)') OR regexp_matches(b, '(?:^|[._-])(test|spec|fixture|mock)(?:[._-]|$)') THEN 'test'
WHEN regexp_matches(n, '(^|/)(docs?|documentation|examples?)(/|$)') OR regexp_matches(b, '\\.(md|mdx|rst|adoc|txt)$') OR regexp_matches(b, '^(readme|changelog|contributing|license)(\\.|$)') THEN 'documentation'
WHEN regexp_matches(n, '(^|/)(config|configs|migrations?|deploy|\\.github)(/|$)') OR regexp_matches(b, '(^|[._-])(config|rc)([._-]|$)') OR regexp_matches(b, '^(\\.env(\\..+)?|\\.npmrc|\\.yarnrc(\\.yml)?|\\.editorconfig|\\.prettierrc(\\..+)?|\\.eslintrc(\\..+)?)$')
  OR regexp_matches(b, '\\.(json|ya?ml|toml|ini|env|properties|lock)$') OR regexp_matches(b, '^(dockerfile|makefile|gemfile|procfile|tsconfig|vite\\.config|webpack\\.config)') THEN 'config'
WHEN regexp_matches(n, '(^|/)(index|mod|exports?|public-api)\\.[cm]?[jt]sx?$') OR regexp_matches(n, '(^|/)(__init__|mod)\\.(py|rs)$') THEN 'export'
WHEN regexp_matches(n, '(^|/)(main|server|app|cli|route|worker)\\.[cm]?[jt]sx?$') OR regexp_matches(n, '(^|/)(main|server|app|cli|worker)\\.(py|go|rs|java|kt|cs|php|rb)$') OR regexp_matches(b, '^(main|server|app|cli|route|worker)(\\.[^.]*)?$') THEN 'entrypoint'
ELSE 'implementation' END"""
NORMAL = "lower(regexp_replace(replace(path, '\\', '/'), '^/+', ''))"


@query(f"SELECT path, {ROLE} AS role FROM (SELECT path, {NORMAL} AS n, list_last(string_split({NORMAL}, '/')) AS b FROM (SELECT * FROM {VP} UNION ALL SELECT DISTINCT url FROM pages))")
def x14_file_roles(spark, sf_dir):
    both = of_paths(spark).union(table(spark, sf_dir, "pages").select("url").distinct())
    return both.select("path", E(paths.role("path")).alias("role"))


def named_roles(l: str) -> str:
    w = duck.word
    pairs = [("test", w("test|tests|testing|spec|fixture|mock|coverage") + "|测试|用例|覆盖率|样本"), ("documentation", w("docs?|documentation|readme|guide|example") + "|文档|说明|示例"), ("config", w("config|configuration|setting|env|deploy|docker") + "|配置|环境变量|部署"), ("entrypoint", w("entrypoint|bootstrap|startup|server|servers|route|endpoint|cli|main|mcp") + "|入口|启动|路由|端点|注册工具"), ("export", w("export|exports|barrel|public api|re-export") + "|导出|暴露接口"), ("implementation", w("implement|implementation|owner|source|logic|function|class|method") + "|实现|源码|逻辑|函数|方法|类")]
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {duck.has(l, p)} THEN '{r}' ELSE '' END" for r, p in pairs) + "], lambda r: r <> ''))"


ALL_QUERIES = f"(SELECT CAST(qid AS BIGINT) AS qid, q FROM {VQ} UNION ALL SELECT 1000 + item_id, text FROM benchmark)"


def all_queries(spark, sf_dir):
    return of_queries(spark).select(F.col("qid").cast("long").alias("qid"), "q").union(table(spark, sf_dir, "benchmark").select(F.col("item_id") + 1000, "text"))


@query(f"""
SELECT qid, array_to_string(CASE WHEN len(ns) = 0 THEN ['implementation=1.0'] WHEN list_contains(ns, 'implementation') THEN list_transform(ns, lambda r: r || '=1.0')
  ELSE list_append(list_transform(ns, lambda r: r || '=1.0'), 'implementation=0.55') END, '|') AS intents FROM (SELECT qid, {named_roles('lower(q)')} AS ns FROM {ALL_QUERIES})""")
def x15_role_intents(spark, sf_dir):
    return all_queries(spark, sf_dir).select("qid", E(f"array_join(transform({routes.role_intents('q')}, x -> concat(x.role, '=', x.score)), '|')").alias("intents"))


ADJUST = """round(CASE intent WHEN 'entrypoint' THEN
 CASE WHEN stem IN ('main','server','app','cli','route','worker') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(n, '(^|/)(src|app|cmd|bin)/') AND stem IN ('main','server','app','cli') THEN 0.1 ELSE 0 END
 - CASE WHEN regexp_matches(n, '(^|/)(scripts?|benchmarks?|benches?|fixtures?)(/|$)') THEN 0.24 ELSE 0 END - CASE WHEN regexp_matches(b, '(^|[._-])(compare|smoke|bench|fixture|sample|mock)([._-]|$)') THEN 0.18 ELSE 0 END
 - CASE WHEN regexp_matches(n, '(^|/)(tests?|__tests__|docs?)(/|$)') THEN 0.1 ELSE 0 END
WHEN 'implementation' THEN CASE WHEN regexp_matches(n, '(^|/)(scripts?|benchmarks?|benches?)(/|$)') THEN -0.08 ELSE 0 END ELSE 0 END, 6)"""


@query(f"""
SELECT path, intent, CAST({ADJUST} AS DOUBLE) AS delta FROM (SELECT path, intent, n, b, CASE WHEN regexp_matches(b, '.\\.[^.]*$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END AS stem
  FROM (SELECT path, intent, {NORMAL} AS n, list_last(string_split({NORMAL}, '/')) AS b FROM {VP}, (VALUES ('entrypoint'), ('implementation'), ('test')) AS i(intent)))""")
def x16_path_adjustment(spark, sf_dir):
    both = of_paths(spark).withColumn("intent", F.explode(E("array('entrypoint', 'implementation', 'test')")))
    return both.select("path", "intent", E(f"round({paths.intent_adjustment('path', 'intent')}, 6)").alias("delta"))


@query(f"""
SELECT path, qid, CASE WHEN (regexp_matches(n, '(^|/)(scripts?|tests?|__tests__|fixtures?|benchmarks?|docs?)(/|$)') OR regexp_matches(n, '\\.(test|spec)\\.[^.]+$'))
  AND NOT regexp_matches(lower(q), '\\b(?:test|tests|spec|script|scripts|fixture|benchmark|docs?|documentation)\\b|测试|脚本|基准|文档') THEN 0.68 WHEN regexp_matches(n, '^(src|app|lib|pkg|packages)/') THEN 1.08 ELSE 1.0 END::DOUBLE AS multiplier
FROM (SELECT path, {NORMAL} AS n FROM {VP}), {VQ}""")
def x19_local_multiplier(spark, sf_dir):
    return of_paths(spark).join(F.broadcast(of_queries(spark)), F.lit(True)).select("path", "qid", E(paths.local_multiplier("path", "q")).alias("multiplier"))


def weights(kind: str) -> str:
    w = duck.word
    table_ = {
        "exact": [(3, """["'`][^"'`]{2,}["'`]"""), (3, "(?i)" + w("exact|literal|hardcoded|string match") + "|所有出现|每一处|全部位置|精确匹配|字符串|枚举所有"), (2, "(?i)" + w("rg|ripgrep|grep"))],
        "impact": [(4, "(?i)" + w("call(ers|ees)?|call graph|who calls|referenced by|dependenc(y|ies)|impact|blast radius|upstream|downstream") + "|谁调用|调用链|调用方|被谁用|依赖关系|影响面|引用链|上游|下游")],
        "complex": [(3, "(?i)" + w("how does|end-to-end|architecture|trace(?: the)? (?:complete )?(?:request )?(?:flow|lifecycle)|request lifecycle|complete flow|walk through|implement(ation)? of|why does") + "|怎么实现|如何实现|梳理|端到端|完整流程|架构|为什么|链路|跨包|跨模块"), (1, "(?s)^.{120}")],
        "symbol": [(4, "(?i)(^|[\\s/\\\\])[\\w.-]+\\.(go|ts|tsx|js|jsx|mjs|cjs|py|rs|java|kt|css|json|yml|yaml|md|sql)\\b"), (2, "[\\\\/][\\w.-]+[\\\\/]|(?i:\\b(src|app|lib|pkg|packages|backend|frontend)/)"), (3, "\\b[\\w]+(?:\\.|::|#)[\\w]+")],
        "semantic": [(2, "(?i)" + w("where (is|are|does)|find|locate|search for") + "|在哪|哪里|找一下|定位|搜索")],
    }
    return " + ".join(f"CASE WHEN {duck.has('q', p)} THEN {n} ELSE 0 END" for n, p in table_[kind])


NAMED = """regexp_extract(q, '(?i)\\b(?:function|class|method|component|hook|type|interface|struct|handler)\\s+(?:named\\s+)?[`"'']?([A-Za-z_$][\\w$]*)[`"'']?', 1)"""
ROUTE = f"""(SELECT qid, q, e_impact AS impact, e_exact AS exact_, e_complex AS complex_, e_symbol AS symbol_, e_semantic + CASE WHEN e_symbol = 0 AND e_exact = 0 AND e_impact = 0 THEN 2 ELSE 0 END AS semantic FROM (
 SELECT qid, q, {weights('impact')} AS e_impact, {weights('exact')} AS e_exact, {weights('complex')} AS e_complex,
 {weights('symbol')} + (CASE WHEN nc > 0 THEN least(4, nc + 1) ELSE 0 END) + (CASE WHEN ns > 0 THEN least(3, ns + 1) ELSE 0 END) + CASE WHEN named <> '' AND lower(named) NOT IN ('a','an','and','for','from','in','into','of','on','the','through','to','with') THEN 2 ELSE 0 END AS e_symbol,
 {weights('semantic')} + CASE WHEN len(regexp_extract_all(q, '[一-鿿]')) >= 4 OR len(regexp_extract_all(q, '[A-Za-z]{{2,}}')) >= 5 THEN 1 ELSE 0 END AS e_semantic
 FROM (SELECT qid, q, len(regexp_extract_all(q, '\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\\b')) AS nc, len(regexp_extract_all(q, '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b')) AS ns, {NAMED} AS named FROM {ALL_QUERIES})))"""
KIND = "CASE WHEN q = '' THEN 'semantic' WHEN semantic > greatest(impact, exact_, complex_, symbol_) AND complex_ >= 3 AND complex_ >= semantic - 1 THEN 'complex' WHEN impact = top THEN 'impact' WHEN exact_ = top THEN 'exact' WHEN complex_ = top THEN 'complex' WHEN symbol_ = top THEN 'symbol' ELSE 'semantic' END"
KINDS = f"(SELECT qid, q, impact, exact_, complex_, symbol_, semantic, {KIND} AS kind FROM (SELECT *, greatest(impact, exact_, complex_, symbol_, semantic) AS top FROM {ROUTE}))"


@query(f"SELECT qid, kind, CAST(CASE WHEN q = '' THEN 0 ELSE impact * 10000 + exact_ * 1000 + complex_ * 100 + symbol_ * 10 + semantic END AS INTEGER) AS scores FROM {KINDS}")
def x20_route_kind(spark, sf_dir):
    scores = text.let("s", routes.route_scores("q"), "s.impact * 10000 + s.exact * 1000 + s.complex * 100 + s.symbol * 10 + s.semantic")
    return all_queries(spark, sf_dir).select("qid", E(routes.route_kind("q")).alias("kind"), E(scores).alias("scores"))


@query(f"""
SELECT qid, kind, CAST(CASE kind WHEN 'impact' THEN 3 WHEN 'complex' THEN 3 ELSE 2 END AS INTEGER) AS turns,
  CASE kind WHEN 'symbol' THEN CASE WHEN g THEN 'graph' WHEN h THEN 'hybrid' ELSE 'remote' END WHEN 'semantic' THEN CASE WHEN h THEN 'hybrid' WHEN g THEN 'graph' ELSE 'remote' END WHEN 'exact' THEN 'rg' WHEN 'impact' THEN CASE WHEN g THEN 'graph' ELSE 'remote' END ELSE 'remote' END AS primary_radar, g, h
FROM {KINDS}, (VALUES (true, true), (true, false), (false, true), (false, false)) AS a(g, h)""")
def x21_search_plan(spark, sf_dir):
    both = all_queries(spark, sf_dir).withColumn("kind", E(routes.route_kind("q"))).withColumn("a", F.explode(E("array(struct(true as g, true as h), struct(true as g, false as h), struct(false as g, true as h), struct(false as g, false as h))")))
    both = both.select("qid", "kind", "a.g", "a.h")
    return both.select("qid", "kind", E(routes.preferred_turns("kind", "3")).alias("turns"), E(routes.primary("kind", "g", "h")).alias("primary_radar"), "g", "h")


@query(f"SELECT qid, kind, conf, CAST(CASE WHEN kind IN ('symbol', 'semantic') AND conf = 'high' THEN 1 WHEN kind IN ('impact', 'complex') THEN 3 ELSE 2 END AS INTEGER) AS turns FROM {KINDS}, (VALUES ('high'), ('medium'), ('low')) AS c(conf)")
def x49_adapted_turns(spark, sf_dir):
    both = all_queries(spark, sf_dir).withColumn("kind", E(routes.route_kind("q"))).withColumn("conf", F.explode(E("array('high', 'medium', 'low')")))
    return both.select("qid", "kind", "conf", E(routes.adapted_turns(routes.preferred_turns("kind", "3"), "kind", "conf")).alias("turns"))


def flags(t: str) -> str:
    any_ = lambda ws: f"list_has_any({t}, {duck.stop_list(ws)})"
    return ", ".join(f"{any_(v)} AS {k}" for k, v in fixed.INTENT_TERMS.items()) + f", {any_(fixed.TOOLING_TERMS)} AS tooling, {any_(fixed.SURFACE_TERMS)} AS surface, len(list_intersect({t}, {duck.stop_list(fixed.SURFACE_TERMS)})) >= 2 AND {any_(fixed.SURFACE_ENTRY_TERMS)} AS strong"


@query(f"SELECT qid, {flags('ts')} FROM (SELECT qid, list_distinct(regexp_extract_all(lower(q), '[a-z]+')) AS ts FROM {VQ})")
def z1_intent_flags(spark, sf_dir):
    return of_queries(spark).select("qid", E(routes.intent_flags(f"array_distinct({text.found('lower(q)', '[a-z]+')})")).alias("f")).select("qid", "f.*")


@query(f"SELECT qid, coalesce({duck.text_list('list_distinct(regexp_extract_all(lower(q), ' + duck.quote('[a-z_$][a-z0-9_$-]+|' + chr(92) + 'p{Han}{2,}') + '))')}, '') AS terms FROM {ALL_QUERIES}")
def z4_owner_terms(spark, sf_dir):
    return all_queries(spark, sf_dir).select("qid", sorted_list(text.owner_terms("q")).alias("terms"))


@query(f"SELECT path, {NORMAL} AS key, '/codebase/' || path AS prefixed, trim(regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g')) AS words FROM {VP}")
def z23_path_helpers(spark, sf_dir):
    """With X36, the words of a path."""
    return of_paths(spark).select("path", E(paths.normalized("path")).alias("key"), F.concat(F.lit("/codebase/"), "path").alias("prefixed"), E(text.path_words("path")).alias("words"))


@query(f"SELECT path, 'file: ' || trim(regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g')) || chr(10) || text AS chunk_text FROM {FILES}")
def x36_whole_chunk_text(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.concat(F.lit("file: "), E(text.path_words("path")), F.lit("\n"), "text").alias("chunk_text"))


@query("SELECT item_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(text), '(\\p{Han})', ' \\1 ', 'g'), '([[:punct:]])', ' \\1 ', 'g')), '\\s+'), lambda w: w <> ''), '|') AS words FROM benchmark")
def x37_bert_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", E(f"array_join({text.bert_words('text')}, '|')").alias("words"))


GLOBS = ["**/*.ts", "src/**", "*.go", "docs/*/intro.html", "src/?erver.ts", "**/[a-b]*.js", "lib/*"]
GLOB_SQL = [("**/*.ts", r"^(.*/)?[^/]*\.ts$"), ("src/**", r"^src/.*$"), ("*.go", r"^[^/]*\.go$"), ("docs/*/intro.html", r"^docs/[^/]*/intro\.html$"), ("src/?erver.ts", r"^src/[^/]erver\.ts$"), ("**/[a-b]*.js", r"^(.*/)?[a-b][^/]*\.js$"), ("lib/*", r"^lib/[^/]*$")]


@query(f"SELECT rule, path FROM {values(GLOB_SQL, 'rule string, p string', 'g')}, {VP} WHERE regexp_matches(path, p)")
def x41_globs(spark, sf_dir):
    globs = F.broadcast(made(spark, [(g, text.glob_pattern(g)) for g in GLOBS], "rule string, p string"))
    return of_paths(spark).join(globs, F.expr("path rlike p")).select("rule", "path")


@query("SELECT a.vec_id AS qid, b.vec_id AS vec_id, round(list_inner_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0")
def x40_dot_products(spark, sf_dir):
    """For every fiftieth vector."""
    e = table(spark, sf_dir, "embeddings")
    probes = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return vector.in_blocks(probes, lambda q: vector.products(e.select("vec_id", "embedding"), q))


ANSWERS = [(1, "<file path=\"/codebase/a/b.ts\"><range>1-20</range><range>30-31</range></file> noise <file path=\"c.go\"></file><file path=\"d.ts\">\n<range>7-9</range></file>"), (2, "nothing"), (3, "<file path=\"x\"><range>bad</range><range>5-2</range></file>")]


@query(f"""
SELECT id, path, CAST(regexp_extract(r, '([0-9]+)-', 1) AS INTEGER) AS s, CAST(regexp_extract(r, '-([0-9]+)', 1) AS INTEGER) AS e FROM (
  SELECT id, regexp_replace(regexp_extract(f, 'path="([^"]*)"', 1), '^/codebase/', '') AS path, unnest(regexp_extract_all(f, '<range>[0-9]+-[0-9]+</range>')) AS r
  FROM (SELECT id, unnest(regexp_extract_all(answer, '(?s)<file path="[^"]*">.*?</file>')) AS f FROM {values(ANSWERS, 'id int, answer string')}))""")
def x43_answer_parse(spark, sf_dir):
    from ..functions.parse import answer_ranges

    return answer_ranges(made(spark, ANSWERS, "id int, answer string"), "answer").select("id", "path", "s", "e")


SNIPPET_RANGES = [(1, 14), (2, 4), (15, 2147483647)]


@query(f"""
SELECT path, s, CAST(least(e, len(ls)) AS INTEGER) AS e, array_to_string(list_slice(ls, s, least(e, len(ls))), chr(10)) AS snippet
FROM (SELECT path, regexp_split_to_array(text, '\\r?\\n') AS ls FROM {FILES}), {values(SNIPPET_RANGES, 's int, e int', 'r')} WHERE s <= len(ls)""")
def x46_whole_ranges(spark, sf_dir):
    """Every requested range that starts inside the file, whole."""
    both = files(spark, sf_dir).select("path", F.split("text", "\r?\n").alias("ls")).join(F.broadcast(made(spark, SNIPPET_RANGES, "s int, e int")), E("s <= size(ls)"))
    return both.select("path", "s", E("least(e, size(ls))").alias("e"), E("array_join(slice(ls, s, least(e, size(ls)) - s + 1), '\n')").alias("snippet"))


@query(f"SELECT qid, rtrim(translate(base64(encode('{{\"v\":1,\"id\":\"' || md5(q) || '\",\"offset\":' || qid * 10 || '}}')), '+/', '-_'), '=') AS cursor, CASE WHEN qid * 10 <= 100 THEN CAST(qid * 10 AS BIGINT) END AS decoded, CAST(NULL AS BIGINT) AS foreign_offset FROM {VQ}")
def x47_cursor(spark, sf_dir):
    c = of_queries(spark).select("qid", F.md5("q").alias("id"), E(text.cursor("md5(q)", "qid * 10")).alias("cursor"))
    return c.select("qid", "cursor", E(text.cursor_offset("cursor", "id", "100")).alias("decoded"), E(text.cursor_offset("cursor", "'other'", "100")).alias("foreign_offset"))


ENDPOINTS = [("/codebase/src/a.ts#run",), ("external:react",), ("/codebase/b.go",), ("plain#x#y",)]


@query(f"SELECT e, lower(replace(regexp_replace(regexp_replace(e, '^/codebase/', ''), '#.*$', ''), '\\', '/')) AS path, coalesce(regexp_extract(e, '#(.*)$', 1), '') AS symbol FROM {values(ENDPOINTS, 'e string')}")
def x50_edge_endpoints(spark, sf_dir):
    from ..operators.graph import endpoint_path, endpoint_symbol

    return made(spark, ENDPOINTS, "e string").select("e", E(endpoint_path("e")).alias("path"), E(endpoint_symbol("e")).alias("symbol"))
