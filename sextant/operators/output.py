"""Pages, budgets, coverage and texts of results; and the restricted tools over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

E = F.expr


def page(ranked: DataFrame, by: list[str], order: list, offset: int, size: int) -> DataFrame:
    """Rows offset+1 to offset+size of each group, with place and whether more follow."""
    w = Window.partitionBy(*by)
    df = ranked.withColumn("place", F.row_number().over(w.orderBy(*order)))
    return df.withColumn("more", F.count("*").over(w) > offset + size).where((F.col("place") > offset) & (F.col("place") <= offset + size))


def fingerprint(ranked: DataFrame, by: list[str]) -> DataFrame:
    """A hash over each group's ordered paths: pages of another result don't fit."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"])
    return ranked.groupBy(*by).agg(F.substring(F.sha2(F.to_json(rows), 256), 1, 24).alias("fingerprint"))


def budget_cut(lines: DataFrame, by: list[str], most: int) -> DataFrame:
    """Lines while their lengths plus one stay within the budget."""
    w = Window.partitionBy(*by).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(F.length("line") + 1).over(w)).where(F.col("used") <= most)


def hint_lines(files: DataFrame) -> DataFrame:
    """One line of text for each ranked file."""
    shown = "array_join(transform(slice(ranges, 1, 4), r -> concat(r.s, '-', r.e)), ',')"
    return files.withColumn("line", E(f"concat(path, ':', {shown}, ' score=', format_number(score, 3))"))


def coverage(issues: DataFrame) -> DataFrame:
    """(provider, complete, issues) from rows (provider, ok, issue)."""
    return issues.groupBy("provider").agg(F.bool_and("ok").alias("complete"), F.array_join(F.array_sort(F.collect_set(E("if(ok, null, issue)"))), "|").alias("issues"))


def rg(lines: DataFrame, pattern: str, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(path, ln, line, hit) of lines that match, `path:line:text`, in order of path and line. The dialect is Java's."""
    df = lines.where(E(text.has("line", pattern)))
    if include:
        df = df.where(E(text.has("path", text.glob_pattern(include))))
    if exclude:
        df = df.where(~E(text.has("path", text.glob_pattern(exclude))))
    return df.select("path", "ln", "line", F.concat_ws(":", "path", F.col("ln").cast("string"), "line").alias("hit"))


def read_file(lines: DataFrame, start: int = 1, end: int | None = None, most: int = 250) -> DataFrame:
    """(path, ln, shown, next): numbered lines of a page and the line on which the next one starts."""
    last = start + most - 1 if end is None else min(end, start + most - 1)
    n = F.max("ln").over(Window.partitionBy("path"))
    df = lines.withColumn("_n", n).where(F.col("ln").between(start, last))
    return df.select("path", "ln", F.concat_ws(":", F.col("ln").cast("string"), "line").alias("shown"), E(f"if(_n > {last}, {last + 1}, null)").alias("next"))


def ls(files: DataFrame, folder: str = "", every: bool = False) -> DataFrame:
    """(name, is_folder): sorted names directly below a folder; names with a dot in front only if asked for."""
    base = folder.rstrip("/") + "/" if folder else ""
    rest = files.where(F.startswith("path", F.lit(base))).select(F.expr(f"substring(path, {len(base) + 1})").alias("rest"))
    out = rest.select(F.substring_index("rest", "/", 1).alias("name"), F.contains("rest", F.lit("/")).alias("is_folder")).groupBy("name").agg(F.bool_or("is_folder").alias("is_folder"))
    return out if every else out.where("name not like '.%'")


def tree(files: DataFrame, depth: int = 3) -> DataFrame:
    """(node, level, files): folders and files down to a depth, with the number of files below."""
    parts = files.select(F.split("path", "/").alias("p"))
    nodes = parts.select(F.explode(E(f"transform(sequence(1, least(size(p), {depth})), i -> array_join(slice(p, 1, i), '/'))")).alias("node"))
    return nodes.groupBy("node").agg(F.count("*").alias("files")).withColumn("level", E("size(split(node, '/'))"))


def glob(files: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """Paths that match, at most 100 by order, none through a folder with a dot in front."""
    return files.where(E(text.has("path", text.glob_pattern(pattern)))).where("not path rlike '(^|/)\\\\.[^/]+/'").select("path").orderBy("path").limit(most)


def map_depth(nodes: DataFrame, most_bytes: int, target: int) -> DataFrame:
    """The deepest level, up to target, at which the tree's text stays within the bytes; 0 if none does."""
    per = nodes.groupBy("level").agg(F.sum(F.octet_length("node") + 1).alias("b"))
    total = per.alias("a").join(per.alias("b"), E("b.level <= a.level")).groupBy(E("a.level").alias("level")).agg(F.sum("b.b").alias("bytes"))
    return total.agg(F.coalesce(F.max(E(f"if(bytes <= {most_bytes} and level <= {target}, level, null)")), F.lit(0)).alias("depth"))


def evidence(outputs: DataFrame) -> DataFrame:
    """(call, path, s, e) from tool outputs (call, kind, path, output): numbered lines become their span, matches fifteen lines about."""
    ls_ = outputs.select("call", "kind", "path", F.explode(F.split("output", "\r?\n")).alias("x"))
    read = ls_.where("kind = 'readfile'").withColumn("ln", E("try_cast(regexp_extract(x, '^([0-9]+):', 1) as int)")).where("ln is not null").groupBy("call", "path").agg(F.min("ln").alias("s"), F.max("ln").alias("e"))
    hits = ls_.where("kind = 'rg'").select("call", E("regexp_extract(x, '^(.+?):([0-9]+):', 1)").alias("path"), E("try_cast(regexp_extract(x, '^(.+?):([0-9]+):', 2) as int)").alias("ln")).where("ln is not null")
    return read.unionByName(hits.select("call", "path", E("greatest(1, ln - 15)").alias("s"), E("ln + 15").alias("e")))


def pending(calls: DataFrame) -> DataFrame:
    """Pages that tool outputs announced (key, next) and no later call (key, start) asked for."""
    told = calls.where("next is not null").select("turn", "key", F.col("next").alias("page"))
    asked = calls.select(F.col("turn").alias("t2"), F.col("key").alias("k2"), F.col("start").alias("page2"))
    return told.join(asked, E("key = k2 and page = page2 and t2 > turn"), "left_anti").select("key", "page")
