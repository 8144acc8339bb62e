"""Line ranges: merging, neighbourhoods, greedy selection and scores of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

E = F.expr


def merge(ranges: DataFrame, by: list[str], gap: int = 5, most: int | None = None) -> DataFrame:
    """Islands of ranges (by, s, e) no more than gap lines apart. With `most`, the last island kept ends with its first member, as
    merging stops there."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    df = ranges.where("s >= 1 and e >= s").withColumn("_reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_new", E(f"if(_reach is null or s > _reach + {gap}, 1, 0)"))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.groupBy(*by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("e", F.struct("s", "e")).alias("_first"))
    if most is None:
        return out.select(*by, "s", "e")
    return out.where(F.col("_island") <= most).select(*by, "s", F.when(F.col("_island") == most, F.col("_first")).otherwise(F.col("e")).alias("e"))


def near_scores(hits: DataFrame, by: list[str]) -> DataFrame:
    """Each hit line's score with its neighbours': within 12 lines decaying, within 40 a little. A self-join on the file and on buckets of 40
    lines, so that only lines near each other meet."""
    a = hits.withColumn("_b", F.explode(E("array(ln div 41 - 1, ln div 41, ln div 41 + 1)"))).select(*by, "_b", "ln", "score")
    b = hits.select(*by, E("ln div 41").alias("_b"), F.col("ln").alias("other"), F.col("score").alias("s2"))
    part = E("case when other = ln then 0.0D when abs(other - ln) <= 12 then s2 * (1 - abs(other - ln) / 16.0D) * 0.7D when abs(other - ln) <= 40 then s2 * 0.12D else 0.0D end")
    return a.join(b, [*by, "_b"]).groupBy(*by, "ln", "score").agg((F.col("score") + F.sum(part)).alias("near"))


def greedy_windows(hits: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """Windows from 20 lines before to 40 after a hit, best first, skipping those that overlap one taken; a fold over each file's sorted hits."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("near")).alias("o"), F.col("ln").alias("ln"), F.col("n_lines").alias("n"))))
    fold = f"""aggregate(hs, cast(array() as array<struct<s:int,e:int>>), (a, h) ->
        if(size(a) >= {most} or exists(a, r -> greatest(1, h.ln - 20) <= r.e and least(h.n, h.ln + 40) >= r.s), a,
           array_append(a, named_struct('s', cast(greatest(1, h.ln - 20) as int), 'e', cast(least(h.n, h.ln + 40) as int)))))"""
    return hits.groupBy(*by).agg(order.alias("hs")).select(*by, F.inline(E(fold)))


def range_terms(terms: DataFrame) -> DataFrame:
    """(qid, term, weight): the terms' own weights and those of the fixed aliases that they trigger; the highest counts."""
    spark = terms.sparkSession
    rows = [(t, a, w) for ts, as_, w in fixed.RANGE_ALIASES for t in ts.split() for a in as_.split()]
    alias = F.broadcast(spark.createDataFrame(rows, "term string, alias string, w double"))
    more = terms.join(alias, "term").select("qid", F.col("alias").alias("term"), F.col("w").alias("weight"))
    return terms.select("qid", "term", "weight").unionByName(more).groupBy("qid", "term").agg(F.max("weight").alias("weight"))


CODE = r"^(?:const|let|var|if|else if|for|while|switch|case|return|await|try|catch|throw|function|class|import|export)(?![A-Za-z0-9_])|[{};=]"


def line_scores(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, path, ln, score, hits) of lines with terms (qid, term, weight); whole words count more than parts, code more than comments."""
    whole = f"size(regexp_extract_all(lower(line), concat('(?<![A-Za-z0-9_])', term, '(?![A-Za-z0-9_])'), 0))"
    hit = lines.join(F.broadcast(terms), E("contains(lower(line), term)")).withColumn("_n", E(whole))
    per = hit.groupBy("qid", "path", "ln", "line").agg(F.sum(E("weight * if(_n > 0, 1.1D + least(_n, 3) * 0.18D, 0.58D)")).alias("raw"), F.count("*").alias("hits"), F.min("term").alias("one"))
    t = "trim(line)"
    code = text.has(t, CODE)
    bonus = (
        f"if({code} and {text.has(t, r'(?<![A-Za-z0-9_])if\s*\(.*===')}, 0.9D, 0.0D) + if({code} and {text.has(t, r'(?<![A-Za-z0-9_])await(?![A-Za-z0-9_]).*\(')}, 0.65D, 0.0D)"
        f" + if({code} and {text.has(t, r'(?<![A-Za-z0-9_])(?:const|let|var)(?![A-Za-z0-9_]).*=')}, 0.25D, 0.0D) + if(hits > 1, (hits - 1) * 0.4D, 0.0D)"
    )
    scored = (
        f"raw * if({text.has(t, r'^//|^/?\*')}, 0.5D, 1.0D) * if({text.has(t, r'^[-#*>]|^\[TOOL_CALLS\]|(?i)^\"?(?:command[0-9]+|include|exclude|required|optional)(?![A-Za-z0-9_])')}, 0.38D, 1.0D)"
        f" * if({code}, 1.35D, 1.0D) * if(hits = 1 and one in ('id', 'key'), 0.18D, 1.0D) + {bonus}"
    )
    return per.withColumn("score", F.round(E(scored), 9)).where("score >= 0.25").select("qid", "path", "ln", "score", "hits")


def expand(symbols: DataFrame) -> DataFrame:
    """Symbol ranges with two lines before and four after, inside the file."""
    return symbols.select("*", E("greatest(1, ln - 2)").alias("s"), E("least(n_lines, `end` + 4)").alias("e"))


def apart(ranges: DataFrame, others: DataFrame, by: list[str], gap: int = 12) -> DataFrame:
    """Ranges with no other range within gap lines."""
    o = others.select(*by, F.col("s").alias("s2"), F.col("e").alias("e2"))
    cond = [ranges[c] == o[c] for c in by]
    near = (ranges["s"] <= o["e2"] + gap) & (o["s2"] <= ranges["e"] + gap)
    for c in cond:
        near = near & c
    return ranges.join(o, near, "left_anti")
