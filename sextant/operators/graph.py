"""The structural ranker: symbols, imports, calls, routes and tests as tables, and scores over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, paths, text

E = F.expr
W = r"(?<![A-Za-z0-9_])"

# What declares a symbol, by language, at the start of a line; name in the last group.
SYMBOLS = {
    "javascript": (
        ("function", r"^\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\("),
        ("class", r"^\s*(export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
        ("interface", r"^\s*(export\s+)?interface\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
        ("type", r"^\s*(export\s+)?type\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
        ("enum", r"^\s*(export\s+)?enum\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
        ("function", r"^\s*(export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?(?:function(?![A-Za-z0-9_])|\([^)]*\)\s*=>|[A-Za-z_$][A-Za-z0-9_$]*\s*=>)"),
        ("method", r"^(\s{2,})(?:public\s+|private\s+|protected\s+|static\s+|async\s+|override\s+|readonly\s+)*(?:get\s+|set\s+)?([A-Za-z_$][A-Za-z0-9_$]*)\s*\([^)]*\)\s*(?::[^{]+)?\{"),
    ),
    "go": (
        ("function", r"^(func)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
        ("method", r"^(func)\s+\([^)]*\)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
        ("class", r"^(type)\s+([A-Za-z_][A-Za-z0-9_]*)\s+struct(?![A-Za-z0-9_])"),
        ("interface", r"^(type)\s+([A-Za-z_][A-Za-z0-9_]*)\s+interface(?![A-Za-z0-9_])"),
        ("const", r"^(const|var)\s+([A-Za-z_][A-Za-z0-9_]*)(?![A-Za-z0-9_])"),
    ),
    "markdown": (("section", r"^(#{1,6})\s+(.+?)\s*$"),),
    "python": (("class", r"^(\s*)class\s+([A-Za-z_][A-Za-z0-9_]*)"), ("function", r"^(\s*)(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(")),
    "rust": (("function", r"^(\s*(?:pub(?:\([^)]*\))?\s+)?)(?:async\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)"), ("class", r"^(\s*(?:pub\s+)?)(?:struct|enum|trait)\s+([A-Za-z_][A-Za-z0-9_]*)")),
    "ruby": (("class", r"^(\s*)(?:class|module)\s+([A-Z][A-Za-z0-9_]*)"), ("function", r"^(\s*)def\s+([a-z_][A-Za-z0-9_]*)")),
    "c": (("class", r"^(\s*(?:public\s+|private\s+|final\s+|abstract\s+)*)(?:class|interface|enum|struct)\s+([A-Za-z_][A-Za-z0-9_]*)"),),
}
LANGUAGES = {"javascript": "js jsx mjs cjs ts tsx mts cts", "go": "go", "markdown": "md mdx", "python": "py", "rust": "rs", "ruby": "rb php", "c": "c cc cpp h hpp cs java kt swift"}


def strip_comments(c: str) -> str:
    """Without // and /* */ comments; their line breaks stay, so lines keep their numbers."""
    blocks = f"array_join(transform(split(regexp_replace({c}, '(?s)/\\\\*.*?\\\\*/', '\\u0001$0\\u0001'), '\\u0001'), x -> if(x like '/*%', regexp_replace(x, '[^\\\\n]', ' '), x)), '')"
    return text.replaced(blocks, r"(?m)(^|[^:])//[^\n]*", "$1")


def symbols(files: DataFrame) -> DataFrame:
    """(path, ln, name, kind, exported): declarations that stand on one line; of two kinds for one name and line the first listed."""
    stripped = files.select("path", E(paths.extension("path")).alias("ext"), E(strip_comments("text")).alias("t"), "text")
    by = "case " + " ".join(f"when array_contains({text.listed(e.split())}, ext) then '{k}'" for k, e in LANGUAGES.items()) + " end"
    lines = stripped.withColumn("lang", E(by)).where("lang is not null").select("path", "lang", F.posexplode(F.split(F.when(F.col("lang").isin("markdown", "python", "ruby"), F.col("text")).otherwise(F.col("t")), "\r?\n")).alias("at", "line"))
    rules = [(k, i, kind, p) for k, ps in SYMBOLS.items() for i, (kind, p) in enumerate(ps)]
    cases = "array(" + ", ".join(f"if(lang = '{k}', named_struct('o', {i}, 'kind', '{kind}', 'mark', regexp_extract(line, {text.quote(p)}, 1), 'name', regexp_extract(line, {text.quote(p)}, 2)), null)" for k, i, kind, p in rules) + ")"
    hit = lines.select("path", "lang", (F.col("at") + 1).alias("ln"), F.explode(E(f"filter({cases}, x -> x is not null and x.name <> '')")).alias("x"))
    hit = hit.where(~F.col("x.name").isin(fixed.CODE_KEYWORDS) | ~F.col("lang").isin("javascript", "go"))
    exported = E("case lang when 'javascript' then x.mark like 'export%' when 'go' then x.name rlike '^[A-Z]' when 'rust' then trim(x.mark) like 'pub%' else true end")
    return hit.groupBy("path", "ln", F.col("x.name").alias("name")).agg(F.min_by("x.kind", "x.o").alias("kind"), F.min_by(exported, "x.o").alias("exported"))


def section_ends(heads: DataFrame, n_lines: DataFrame) -> DataFrame:
    """(path, ln, name, level, end): a section ends before the next heading of its level or a higher one."""
    following = F.array_sort(F.collect_list(F.struct("ln", "level", "name")))
    rows = heads.groupBy("path").agg(following.alias("hs")).join(n_lines, "path")
    return rows.select("path", "n_lines", "hs", F.explode("hs").alias("h")).select(
        "path", "h.ln", "h.name", "h.level", E("coalesce(array_min(transform(filter(hs, x -> x.ln > h.ln and x.level <= h.level), x -> x.ln)) - 1, n_lines)").alias("end"))


def symbol_ends(symbols_: DataFrame, n_lines: DataFrame) -> DataFrame:
    """A symbol ends before the next one of its file."""
    following = F.lead("ln").over(Window.partitionBy("path").orderBy("ln", "name"))
    return symbols_.join(n_lines, "path").withColumn("end", F.greatest(F.col("ln"), F.coalesce(following - 1, F.col("n_lines"))))


def block_end(source: str, start: int, most: int = 80_000) -> int:
    """The line (from 1) on which the braces opened on or after line `start` close; without a brace before a semicolon the line itself,
    without one at all up to 20 lines on, and 120 if they never close. A character scan, for a pandas UDF."""
    lines = source.split("\n")
    at = sum(len(x) + 1 for x in lines[: start - 1])
    depth, opened = 0, False
    for i in range(at, min(len(source), at + most)):
        c = source[i]
        if c == "{":
            depth, opened = depth + 1, True
        elif c == "}" and opened:
            depth -= 1
            if not depth:
                return source.count("\n", 0, i) + 1
        elif c == ";" and not opened:
            return source.count("\n", 0, i) + 1
    return min(len(lines), start + (120 if opened else 20))


IMPORTS = (
    ("imports", r"(?<![A-Za-z0-9_])import\s+(?:type\s+)?(?:[^'\"`]*?\s+from\s+)?[\"'`]([^\"'`]+)[\"'`]"),
    ("reexports", r"(?<![A-Za-z0-9_])export\s+[^\"'`]*?\s+from\s+[\"'`]([^\"'`]+)[\"'`]"),
    ("imports", r"(?<![A-Za-z0-9_])require\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)"),
    ("imports", r"(?<![A-Za-z0-9_])import\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)"),
)


def imports(files: DataFrame) -> DataFrame:
    """(path, kind, spec)."""
    js = "concat(" + ", ".join(f"transform({text.found('text', p, 1)}, s -> named_struct('kind', '{k}', 'spec', s))" for k, p in IMPORTS) + ")"
    single = text.found("text", r'(?m)^import\s+(?:[A-Za-z0-9_]+\s+)?"([^"]+)"', 1)
    block = f"flatten(transform({text.found('text', r'(?ms)^import\s*\((.*?)^\)', 1)}, b -> {text.found('b', chr(34) + '([^' + chr(34) + ']+)' + chr(34), 1)}))"
    go = f"transform(concat({single}, {block}), s -> named_struct('kind', 'imports', 'spec', s))"
    return files.select("path", F.explode(E(f"if({paths.extension('path')} = 'go', {go}, {js})")).alias("x")).select("path", "x.kind", "x.spec").distinct()


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, kind, spec, target): for a relative spec the first candidate file that exists, else external:spec."""
    exts = ["", *("." + e for e in fixed.GRAPH_EXTENSIONS), *("/index." + e for e in fixed.GRAPH_EXTENSIONS)]
    base = paths.resolved("concat(regexp_replace(path, '[^/]*$', ''), spec)")
    tried = found.withColumn("base", E(base)).select("path", "kind", "spec", "base", F.posexplode(F.array(*map(F.lit, exts))).alias("o", "ext")).where("spec like '.%'")
    exists = tried.select("path", "kind", "spec", "o", F.concat("base", "ext").alias("target")).join(files.select(F.col("path").alias("target")).distinct(), "target")
    first = exists.groupBy("path", "kind", "spec").agg(F.min_by("target", "o").alias("target"))
    return found.join(first, ["path", "kind", "spec"], "left").withColumn("target", F.coalesce("target", F.concat(F.lit("external:"), "spec")))


def calls(files: DataFrame) -> DataFrame:
    """(path, callee, at): distinct called names of a file, case apart, in order of first appearance."""
    names = E(text.found(strip_comments("text"), W + r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", 1))
    each = files.select("path", F.posexplode(names).alias("at", "callee")).where(~F.col("callee").isin(fixed.CODE_KEYWORDS))
    return each.groupBy("path", F.lower("callee").alias("key")).agg(F.min_by("callee", "at").alias("callee"), F.min("at").alias("at"))


def call_edges(called: DataFrame, symbols_: DataFrame, per_name: int = 3, per_file: int = 120) -> DataFrame:
    """(from_file, to_file, callee): a name goes to the files that define it, the first few, up to per_file edges a file."""
    defined = symbols_.groupBy(F.lower("name").alias("key"), F.col("path").alias("to_file")).agg(F.min("ln").alias("ln"))
    defined = defined.withColumn("o", F.row_number().over(Window.partitionBy("key").orderBy("to_file"))).where(F.col("o") <= per_name)
    hit = called.withColumnRenamed("path", "from_file").join(defined, "key")
    w = Window.partitionBy("from_file").orderBy("at", "o")
    return hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_file).select("from_file", "to_file", "callee")


ROUTES = W + r"(?:app|router|server|route)\.(get|post|put|patch|delete|options|head|use)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*([A-Za-z_$][A-Za-z0-9_$]*)"


def route_edges(files: DataFrame, symbols_: DataFrame) -> DataFrame:
    """(from_file, to_file, route, handler): to the first file that defines the handler, else to the file itself."""
    hit = files.select("path", F.explode(F.arrays_zip(*[E(text.found("text", ROUTES, g)).alias(a) for g, a in ((1, "verb"), (2, "at"), (3, "handler"))])).alias("r"))
    first = symbols_.groupBy(F.lower("name").alias("key")).agg(F.min("path").alias("target"))
    out = hit.withColumn("key", F.lower("r.handler")).join(first, "key", "left")
    return out.select(F.col("path").alias("from_file"), F.coalesce("target", "path").alias("to_file"), F.concat(F.upper("r.verb"), F.lit(" "), "r.at").alias("route"), F.col("r.handler").alias("handler")).distinct()


def test_edges(files: DataFrame, most: int = 5) -> DataFrame:
    """(from_file, to_file): a test and the files whose name it bears."""
    f = files.select("path", E(paths.is_test("path")).alias("t"), E(paths.test_base("path")).alias("base"))
    hit = f.where("t").select(F.col("path").alias("from_file"), "base").join(f.where("not t").select(F.col("path").alias("to_file"), "base"), "base")
    w = Window.partitionBy("from_file").orderBy("to_file")
    return hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("from_file", "to_file")


def endpoint_path(c: str) -> str:
    return f"lower(replace(regexp_replace(regexp_replace({c}, '^/codebase/', ''), '#.*$', ''), '\\\\', '/'))"


def endpoint_symbol(c: str) -> str:
    return f"regexp_extract({c}, '#(.*)$', 1)"


def degrees(edges: DataFrame) -> DataFrame:
    """(node, incoming, outgoing, tests, exports) from edges (src, dst, kind)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"), "kind").select("x.*", "kind")
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("incoming"), F.sum("o").cast("long").alias("outgoing"), F.count_if(F.col("kind") == "tests").alias("tests"), F.count_if(F.col("kind").isin("exports", "reexports")).alias("exports"))


def top_edges(edges: DataFrame, per_node: int, per_kind: dict[str, int], order: list) -> DataFrame:
    """Of each src the best per_node edges, of some kinds fewer."""
    kinds = F.row_number().over(Window.partitionBy("src", "kind").orderBy(*order))
    most = F.lit(per_node)
    for k, n in per_kind.items():
        most = F.when(F.col("kind") == k, F.lit(n)).otherwise(most)
    kept = edges.withColumn("_k", kinds).where(F.col("_k") <= most)
    return kept.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(*order))).where(F.col("rn") <= per_node).drop("_k")


def hop_boost(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(node, boost): an edge to a node of score .45 or more gives its source min(.55, .28 score)."""
    hit = edges.join(scores.where("score >= 0.45").withColumnRenamed("node", "dst"), "dst")
    return hit.groupBy(F.col("src").alias("node")).agg(F.sum(E("least(0.55D, 0.28D * score)")).alias("boost"))


def term_weights(terms: DataFrame, present: DataFrame, n_files: int) -> DataFrame:
    """(term, df, weight) from present (file, term): rare terms weigh up to 1.8, common ones .45."""
    df = present.distinct().groupBy("term").agg(F.count("*").alias("df"))
    both = terms.select("term").distinct().join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    return both.withColumn("weight", E(f"greatest(0.45D, least(1.8D, log2(({n_files} + 1.0D) / (df + 1)) + 0.55D))"))


def contributions(parts: list[DataFrame]) -> DataFrame:
    """(qid, file, raw, terms, reasons) from parts (qid, file, amount, reason, term): amounts add up, terms and reasons are sets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("qid", "file").agg(F.sum("amount").alias("raw"), F.array_sort(F.collect_set("term")).alias("terms"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def role_adjusted(raw: str, path: str, wants_tooling: str, wants_surface: str, strong: str) -> str:
    """Tooling goes down first, then sources and entry points up."""
    down = f"if({paths.is_tooling(path)} and not {wants_tooling}, {raw} * 0.42D, {raw})"
    return f"{down} + if({wants_surface} and {paths.is_runtime(path)}, 0.08D, 0.0D) + if({wants_surface} and {paths.is_entry(path)}, if({strong}, 0.42D, 0.22D), 0.0D)"


def floored(scores: DataFrame, wants_tooling: str = "false") -> DataFrame:
    """Candidates: at least .16 and .08 of the best; tooling paths a quarter of it unless asked for."""
    top = F.max("raw").over(Window.partitionBy("qid"))
    df = scores.where("raw > 0").withColumn("_top", top)
    return df.where(f"raw >= greatest(0.16D, 0.08D * _top) and (not {paths.is_tooling('file')} or {wants_tooling} or raw >= 0.25D * _top)").withColumn("score", E("least(1.0D, raw / greatest(_top, 1.0D))")).drop("_top")


def confidence(top: str, coverage: str, matched: str) -> str:
    high = f"{top} >= 0.8D and (({coverage} >= 0.9D and {matched} >= 1) or ({coverage} >= 0.52D and {matched} >= 2))"
    medium = f"{top} >= 0.34D and (({coverage} >= 0.55D and {matched} >= 1) or ({coverage} >= 0.24D and {matched} >= 2))"
    return f"case when {high} then 'high' when {medium} then 'medium' else 'low' end"


def edge_score(both_top: str, kind: str, weight: str, intent: str) -> str:
    base = f"if({both_top}, if({kind} in ('imports', 'reexports'), 1.2D, 0.35D), 0.15D)"
    return f"{base} + 0.9D * {weight} + if({intent}, 0.7D, 0.0D) + if({kind} = 'routes_to', 0.25D, 0.0D) + if({kind} = 'tests', 0.2D, 0.0D)"


def admitted(both_top: str, kind: str, hit: str, intent: str) -> str:
    return f"case when {kind} in ('imports', 'reexports', 'routes_to', 'tests') then {both_top} or {intent} or {hit} else {hit} or {intent} end"
