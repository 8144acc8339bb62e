"""The registry: a query by name with its DuckDB oracle, and tables as the queries see them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of files."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.expr("concat(source, '/', lang, '/doc_', doc_id, '.md')").alias("path"), "text", "lang", "source")


FILES = "(SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.md' AS path, text, lang, source FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", "path", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).select("doc_id", "path", (F.col("at") + 1).alias("ln"), "line")


LINES = f"(SELECT doc_id, path, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS ln, unnest(ls) AS line FROM (SELECT doc_id, path, regexp_split_to_array(text, '\\r?\\n') AS ls FROM {FILES}))"


def made(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def rounded(c: Column | str, digits: int) -> Column:
    """As the oracles' engine rounds doubles: the scaled double, half away from zero. Spark's own rounds the shortest decimal."""
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(sql_value, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple], schema: str, name: str = "t") -> str:
    """The same rows for DuckDB."""
    columns = ", ".join(x.split()[0] for x in schema.split(", "))
    return "(VALUES " + ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows) + f") AS {name}({columns})"
