"""Personal data: patterns propose, checksums confirm, context words adjust the score. JVM-side throughout.

Null texts count as empty. Extra columns of the input are not looked at. Every row gives one row, repeated
ids included. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marked_spans, without_marks

#: Kind, pattern, a character without which the pattern can't match. Possessive quantifiers keep the scan
#: linear and free of recursion; each start is the first of its run, or directly after the match before.
PROPOSERS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", ""),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])", ""),
    "national": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
}
BASE = ("email", "ip", "card", "phone")

#: Confirming conditions on a span x with the matched text x.m.
LUHN = """aggregate(split(reverse(regexp_replace(x.m, '[^0-9]', '')), ''), named_struct('i', 0, 't', 0),
    (a, c) -> if(c = '', a, named_struct('i', a.i + 1, 't', a.t + if(a.i % 2 = 0, cast(c as int), cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0)))),
    a -> a.t % 10 = 0)"""
MOD97 = """aggregate(split(concat(substring(replace(x.m, ' ', ''), 5), substring(replace(x.m, ' ', ''), 1, 4)), ''), 0,
    (a, c) -> if(c = '', a, if(c between '0' and '9', a * 10 + cast(c as int), a * 100 + ascii(c) - 55) % 97), a -> a = 1)"""
CONFIRMERS = {
    "ip": "forall(split(x.m, '\\\\.'), p -> length(ltrim('0', p)) < 4 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": LUHN,
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 9 and 15",
    "iban": MOD97,
}

#: Words that, shortly before a span, speak for its kind.
CONTEXT = {
    "email": "e-?mail|contact|write|reach|@",
    "ip": "\\bip\\b|address|host|server|client",
    "card": "card|visa|credit|debit|payment|pan\\b",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "national": "ssn|social security|national id|tax id",
}
#: Score of a confirmed span without context, with it; spans of kinds that aren't base need 0.5.
SCORES = {"email": (0.8, 0.95), "ip": (0.6, 0.9), "card": (0.8, 0.99), "phone": (0.6, 0.9), "iban": (0.95, 0.99), "national": (0.3, 0.8)}
WINDOW = 40


def _kind(kind: str) -> Column:
    pattern, needed = PROPOSERS[kind]
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    spans = marked_spans("_t", pattern)
    gate = F.contains("_t", F.lit(needed)) if needed else F.col("_t").rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(gate, spans).otherwise(none)


def _scored(kind: str) -> str:
    plain, near = SCORES[kind]
    context = CONTEXT[kind].replace("\\", "\\\\")
    before = f"lower(substring(_t, greatest(1, x.s + 1 - {WINDOW}), least(x.s, {WINDOW})))"
    confirmed = f"filter(_{kind}, x -> {CONFIRMERS[kind]})" if kind in CONFIRMERS else f"_{kind}"
    scored = f"transform({confirmed}, x -> named_struct('kind', '{kind}', 'start', x.s, 'end', x.e, 'score', if({before} rlike '{context}', {near}D, {plain}D)))"
    return scored if kind in BASE else f"filter({scored}, x -> x.score >= 0.5)"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_col and `spans`: array of (kind, start, end, score), by kind as in PROPOSERS, then start."""
    df = docs.select(F.col(id_col), F.col(text_col), without_marks(text_col).alias("_t"))
    df = df.select("*", *[_kind(k).alias(f"_{k}") for k in PROPOSERS])
    spans = F.concat(*[F.expr(_scored(k)) for k in PROPOSERS])
    return df.select(F.col(id_col), F.col(text_col), spans.alias("spans"))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces each span of `find_pii` by its kind in brackets; of overlapping spans the first by start counts."""
    text = f"coalesce({text_col}, '')"
    return found.withColumn(
        text_col,
        F.expr(
            f"""aggregate(array_sort(transform(spans, x -> named_struct('s', x.start, 'e', x.end, 'k', x.kind))),
                named_struct('at', 0, 'out', ''),
                (a, x) -> if(x.s < a.at, a, named_struct('at', x.e, 'out', concat(a.out, substring({text}, a.at + 1, x.s - a.at), '[', x.k, ']'))),
                a -> concat(a.out, substring({text}, a.at + 1)))"""
        ),
    )


def joined(spans: str) -> Column:
    return F.array_join(F.expr(f"transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end))"), ",")


def digest(docs: DataFrame) -> DataFrame:
    df = find_pii(docs).select("doc_id", "spans", F.expr(f"filter(spans, x -> x.kind in {BASE})").alias("base"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
