"""Secrets: Boolean trigram queries pick the documents for each rule, the rule's pattern verifies. JVM-side throughout.

`derived` reads each rule's parsed pattern and finds the strings of which every match must hold one (as a code search does): runs of
single characters, case apart, are joined, optional parts and alternatives multiply them, what has many forms ends them; strings that a
match must hold one after another are all asked for. Each string stands for all trigrams in it, so a rule's query is an OR of ANDs of trigrams.

The index is partitioned by document: a row holds, as bits of a number, which trigrams of any query (63 at most) its lower-cased text has. The posting list of
a trigram is the rows with its bit, intersecting lists is AND of bits, and no posting leaves its row's task, so a source or a token
in a third of all rows makes no large group. `postings` gives the lists by trigram, for a store. Rules without a mandatory trigram scan fully.

Null and empty texts have no spans; texts of any length are scanned whole; an empty table gives no rows. Every row gives one row, repeated ids
included; spans of one kind never tie, those of two kinds with one start stand in the order of RULES. Extra columns aren't kept, and no
name of theirs clashes.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, marked_spans, without_marks

#: Rule, pattern, condition on a match x.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
RULES: dict[str, tuple[str, str]] = {
    "assign": (ASSIGN + r"[A-Za-z0-9+/_.=-]+", "length(regexp_extract(x.m, '{ASSIGN}([A-Za-z0-9+/_.=-]+)', 1)) >= 6"),
    "access": (r"AKIA[A-Z0-9]{16,}+", "true"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", "true"),
    "private_key": (r"-----BEGIN (?:[A-Z0-9]++ ){0,3}+PRIVATE KEY-----", "true"),
    "github": (r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])", "true"),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "true"),
}
BASE = ("assign", "access", "hex")
#: Forms that a string may have before it ends, and alternatives that a query may have.
FORMS = 16
#: Alternatives, in each the strings that are all needed.
Needs = set[frozenset[str]] | None


class Strings:
    """What a part of a pattern says of its matches: all that it can match (`exact`, None if that is many), or what is `needed` in them."""

    def __init__(self, exact: set[str] | None, needed: Needs = None):
        self.exact, self.needed = exact, needed

    def needs(self) -> Needs:
        return self.needed if self.exact is None else useful(self.exact)


def useful(found: set[str]) -> Needs:
    """One of the strings, if each has a trigram."""
    return {frozenset([w]) for w in found} if found and min(map(len, found)) >= 3 else None


def both(a: Needs, b: Needs) -> Needs:
    """Two conditions that both hold; where that makes many alternatives the one that has fewer."""
    if not a or not b:
        return a or b
    product = {x | y for x in a for y in b}
    return product if len(product) <= FORMS else min(a, b, key=len)


def described(part) -> Strings:
    """Of a parsed pattern or a part of it, upper and lower case being one."""
    kind, value = part
    if kind is op.LITERAL:
        return Strings({chr(value).lower()})
    if kind is op.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                chars.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < FORMS:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return Strings(None)
        return Strings(chars if len(chars) <= FORMS else None)
    if kind is op.SUBPATTERN:
        return sequence(value[-1])
    if kind is op.ATOMIC_GROUP:
        return sequence(value)
    if kind is op.BRANCH:
        parts = [sequence(x) for x in value[1]]
        if all(p.exact is not None for p in parts):
            return Strings(set().union(*(p.exact for p in parts)))
        needs = [p.needs() for p in parts]
        return Strings(None, set().union(*needs) if all(needs) else None)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        found = sequence(inner)
        if least == 0:
            return Strings(found.exact | {""} if most == 1 and found.exact is not None else None)
        return found if (least, most) == (1, 1) else Strings(None, found.needs())
    if kind in (op.ASSERT, op.ASSERT_NOT, op.AT):
        return Strings({""})  # takes no characters
    return Strings(None)


def sequence(parts) -> Strings:
    """Of parts one after another: neighbours with few forms are joined, the conditions of all runs hold."""
    run: set[str] = {""}
    needed, whole = None, True
    for found in map(described, parts):
        joined = None if found.exact is None else {a + b for a in run for b in found.exact}
        if joined is not None and len(joined) <= FORMS:
            run = joined
            continue
        whole = False
        needed = both(needed, useful(run))
        if found.exact is None:
            needed, run = both(needed, found.needed), {""}
        else:
            run = found.exact
    return Strings(run) if whole else Strings(None, both(needed, useful(run)))


def derived(pattern: str) -> list[list[str]]:
    """The Boolean trigram query of a pattern, an OR of ANDs of trigrams; [] (any document) if no trigram is mandatory."""
    found = sequence(parser.parse(pattern)).needs() or set()
    return sorted(sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)}) for words in found)


QUERIES = {rule: derived(pattern) for rule, (pattern, _) in RULES.items()}
TRIGRAMS = sorted({t for q in QUERIES.values() for ts in q for t in ts})
BIT = {t: 1 << i for i, t in enumerate(TRIGRAMS)}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bits(text: str) -> Column:
    """Which of TRIGRAMS the lower-cased text has, as bits."""
    return F.expr(" | ".join(f"if(contains({text}, {_quoted(t)}), {bit}L, 0L)" for t, bit in BIT.items()))


def indexed(docs: DataFrame, text_col: str = "text", name: str = "trigrams") -> DataFrame:
    """docs with the index's bits of each row's text."""
    (lower,) = fresh([*docs.columns, name], "lower")
    return docs.withColumn(lower, F.lower(without_marks(text_col))).withColumn(name, _bits(lower)).drop(lower)


def postings(index: DataFrame, id_col: str = "doc_id", name: str = "trigrams") -> DataFrame:
    """(trigram, id): the inverted lists of an indexed table, for a store outside this job."""
    listed = ", ".join(f"if({name} & {bit}L <> 0, {_quoted(t)}, null)" for t, bit in BIT.items())
    return index.select(F.explode(F.expr(f"filter(array({listed}), x -> x is not null)")).alias("trigram"), id_col)


def candidate(rule: str, name: str = "trigrams") -> Column:
    """Whether a row of the index is in the intersection of the posting lists of one of the rule's strings; ASCII case apart, no match is missed."""
    needs = [sum(BIT[t] for t in ts) for ts in QUERIES[rule]]
    return F.expr(" or ".join(f"{name} & {m}L = {m}L" for m in needs)) if needs else F.lit(True)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_col and `spans`: array of (kind, start, end), by start, then kind as in RULES."""
    df = indexed(docs.select(F.col(id_col), F.col(text_col), without_marks(text_col).alias("_t")), "_t")
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")
    df = df.select(id_col, text_col, *[F.when(candidate(k), marked_spans("_t", RULES[k][0])).otherwise(none).alias(f"_{k}") for k in RULES])
    spans = []
    for at, (k, (_, condition)) in enumerate(RULES.items()):
        condition = condition.replace("{ASSIGN}", ASSIGN.replace("\\", "\\\\").replace("'", "\\'"))
        spans.append(F.expr(f"transform(filter(_{k}, x -> {condition}), x -> named_struct('start', x.s, 'at', {at}, 'end', x.e, 'kind', '{k}'))"))
    ordered = F.array_sort(F.concat(*spans))
    return df.select(id_col, text_col, F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.expr(f"transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end))"), ",")


def digest(docs: DataFrame) -> DataFrame:
    df = find_secrets(docs).select("doc_id", "spans", F.expr(f"filter(spans, x -> x.kind in {BASE})").alias("base"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
