"""A tree of files as a DataFrame: scan, ignore rules, signatures, packages. Reading itself is Spark's text or binaryFile source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, paths, text


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, size, mtime_ms, text) of all files below root, through Spark's own readers."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^[a-z]+:(//)?(?=/)", "")
    cut = base.split("://", 1)[-1] if "://" in base else base
    return raw.select(F.expr(f"substring_index(path, {text.quote(cut)}, -1)").alias("path"), F.col("length").alias("size"), (F.unix_millis("modificationTime")).cast("double").alias("mtime_ms"), F.expr("cast(content as string)").alias("text"), path.alias("full_path"))


def without_excluded(files: DataFrame) -> DataFrame:
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, fixed.EXCLUDED_DIRS))))


def scan(files: DataFrame, most_files: int = 6000, most_bytes: int = 1_000_000) -> DataFrame:
    """Source files of acceptable size outside excluded folders, the first most_files by path (rn). The rank is taken
    over a top-n, not over all files in one task."""
    sized = files if "size" in files.columns else files.withColumn("size", F.octet_length("text").cast("long"))
    kept = without_excluded(sized).where(paths.is_source("path")).where((F.col("size") > 0) & (F.col("size") <= most_bytes))
    first = kept.orderBy("path").limit(most_files)
    return first.withColumn("rn", F.row_number().over(Window.orderBy("path")).cast("long"))


def coverage(files: DataFrame, most_bytes: int = 1_000_000) -> DataFrame:
    """One row of counters: seen, sources, empty, too large, binary."""
    source = F.expr(paths.is_source("path"))
    size = F.octet_length("text")
    return files.agg(
        F.count("*").alias("seen"), F.count_if(source).alias("sources"), F.count_if(source & (size == 0)).alias("empty"),
        F.count_if(source & (size > most_bytes)).alias("oversize"), F.count_if(source & F.expr(text.is_binary("text"))).alias("binary_files"),
    )


def ignored(files: DataFrame, rules: list[tuple[str, int, str]]) -> DataFrame:
    """files with `ignored`. rules: (folder, sequence, line of its ignore file); the deepest folder's last matching line decides.
    The rules are a project's own few lines, so they are broadcast."""
    spark = files.sparkSession
    rows = [(d, n, *text.ignore_pattern(line)) for d, n, line in rules if line.strip() and not line.startswith("#")]
    table = F.broadcast(spark.createDataFrame(rows, "dir string, seq int, pattern string, negated boolean"))
    local = "if(dir = '', path, substring(path, length(dir) + 2))"
    hit = files.join(table, F.expr(f"(dir = '' or startswith(path, concat(dir, '/'))) and {local} rlike pattern"), "left")
    return hit.groupBy(*files.columns).agg(F.coalesce(F.max_by(~F.col("negated"), F.struct(F.length("dir"), "seq")), F.lit(False)).alias("ignored"))


def is_hard_excluded(path: str, more: tuple[str, ...] = ()) -> str:
    """Whether a path is left out whatever the ignore files say."""
    patterns = "|".join(f"(?:{text.ignore_pattern(rule)[0]})" for rule in (*fixed.HARD_EXCLUDES, *more))
    return text.has(path, patterns)


def discovered(files: DataFrame, names: list[str] = fixed.IGNORE_FILES, most: int = 10_000) -> list[tuple[str, int, str]]:
    """The rules (folder, sequence, line) of a tree's ignore files, for `ignored`. A tree with more than `most` lines of rules is refused, as
    they are broadcast."""
    own = files.where(F.substring_index("path", "/", -1).isin(names))
    line = own.select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.substring_index("path", "/", -1).alias("name"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("n", "line"))
    rows = line.where("trim(line) <> '' and not startswith(line, '#')").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lines of ignore rules")
    rows.sort(key=lambda r: (r.dir, names.index(r.name), r.n))
    return [(r.dir, seq, r.line.strip()) for seq, r in enumerate(rows, 1)]


def with_ignored(files: DataFrame) -> DataFrame:
    """files with `ignored`, by the hard excludes and by the ignore files that are among them."""
    kept = ignored(files, discovered(files))
    return kept.withColumn("ignored", F.expr(is_hard_excluded("path")) | F.col("ignored"))


def signature(files: DataFrame, by: str) -> DataFrame:
    """Per project: counts, sizes, the newest change, and a hash over its sorted files."""
    one = F.concat_ws(":", "path", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return files.groupBy(by).agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.max("mtime").alias("newest"),
        F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", one.alias("one")))), lambda x: x["one"]), "")).alias("signature"),
    )


def packages(files: DataFrame) -> DataFrame:
    """Per root folder the number of packages (folders of its own) and whether it is a monorepo."""
    parts = files.select(F.split("path", "/").alias("p")).where("size(p) >= 3").select(F.col("p")[0].alias("root"), F.col("p")[1].alias("pkg")).distinct()
    return parts.groupBy("root").agg(F.count("*").alias("packages")).withColumn("monorepo", F.col("packages") >= 2)


def below(files: DataFrame, prefix: str) -> DataFrame:
    return files.where(F.startswith("path", F.lit(prefix.rstrip("/") + "/")))
