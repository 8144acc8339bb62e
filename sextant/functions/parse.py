"""Parsers of assistant answers and tool calls, over text columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import found, quote


def answer_ranges(df: DataFrame, c: str) -> DataFrame:
    """df with a row for each <range>a-b</range> of each <file path="...">."""
    f = df.withColumn("_f", F.explode(F.expr(found(c, r'(?s)<file path="[^"]*">.*?</file>'))))
    r = f.withColumn("_r", F.explode(F.expr(found("_f", r"<range>[0-9]+-[0-9]+</range>"))))
    path = f"regexp_replace(regexp_extract(_f, {quote(chr(112) + 'ath=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))}, 1), '^/codebase/', '')"
    return r.select(*df.columns, F.expr(path).alias("path"), F.expr("cast(regexp_extract(_r, '([0-9]+)-', 1) as int)").alias("s"), F.expr("cast(regexp_extract(_r, '-([0-9]+)', 1) as int)").alias("e"))


CALL = re.compile(r"\[TOOL_CALLS\]\s*(\w+)\s*\[ARGS\]\s*")


def tool_call(text: str | None) -> tuple[str, str] | None:
    """(name, arguments as JSON) of the first tool call: braces are balanced outside strings, commas before a closing bracket forgiven."""
    m = CALL.search(text or "")
    if not m or not text[m.end() : m.end() + 1] == "{":
        return None
    depth, inside, escaped = 0, False, False
    for i in range(m.end(), len(text)):
        c = text[i]
        if inside:
            inside = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                body = text[m.end() : i + 1]
                for attempt in (body, re.sub(r",\s*([}\]])", r"\1", body)):
                    try:
                        return m[1], json.dumps(json.loads(attempt), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
                    except ValueError:
                        continue
                return None
    return None


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.StringType())]))
def tool_calls(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([tool_call(t) or (None, None) for t in texts], columns=["name", "args"])
