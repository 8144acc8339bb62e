"""Token and query functions as Spark SQL expressions over an expression `c`; all run JVM-side.

Word boundaries are ASCII and written as lookarounds, as Java's own boundary looks at Unicode letters.
Lengths are in code points and order is binary.
"""

from __future__ import annotations

from collections.abc import Iterable

HAN = r"\p{IsHan}"


def quote(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(values: Iterable[str]) -> str:
    values = list(values)
    return "array(" + ", ".join(map(quote, values)) + ")" if values else "cast(array() as array<string>)"


def whole(alternatives: str) -> str:
    """A pattern for whole ASCII words."""
    return rf"(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


def has(c: str, pattern: str) -> str:
    return f"({c} rlike {quote(pattern)})"


def found(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({c}, {quote(pattern)}, {group})"


def replaced(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {quote(pattern)}, {quote(by)})"


def let(name: str, value: str, body: str) -> str:
    """body with `name` standing for value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def identifier_parts(c: str, keep: str = "") -> str:
    """Lower-cased parts of an identifier: camelCase, ACRONYMWord and, unless kept, _ and $ are boundaries."""
    spaced = replaced(replaced(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    if not keep:
        spaced = replaced(spaced, "[_$]+", " ")
    return f"filter(transform(split({spaced}, {quote(f'[^A-Za-z0-9{keep}{HAN}]+')}), p -> lower(trim(p))), p -> p <> '')"


def useful(array: str, stop: Iterable[str] = ()) -> str:
    return f"array_distinct(filter({array}, t -> length(t) >= 2 and not array_contains({listed(stop)}, t)))"


def expand_token(c: str, stop: Iterable[str] = ()) -> str:
    """All forms under which a code token is looked up: itself, its parts, the parts joined, itself without punctuation."""
    raw = replaced(f"trim({c})", r"""^[`'"(\[{<]+|[`'"\])}>.,;:!?]+$""", "")
    forms = (
        "concat(array(lower(replace(r, '\\\\', '/'))), ps, "
        + let("ws", "filter(ps, p -> p rlike '^[a-z0-9]+$')", "if(size(ws) > 1, array(array_join(ws, ''), array_join(ws, '_')), cast(array() as array<string>))")
        + f", array(lower({replaced('r', f'[^A-Za-z0-9_${HAN}]', '')})))"
    )
    every = useful(let("r", raw, let("ps", identifier_parts("r"), forms)), stop)
    # a word that is one part has one form: most tokens need none of the above
    plain = f"if(length({c}) >= 2 and not (lower({c}) in ({', '.join(map(quote, stop)) or quote('')})), array(lower({c})), cast(array() as array<string>))"
    return f"if({has(c, '^(?:[A-Za-z][a-z0-9]*|[A-Z]+)$')}, {plain}, {every})"


def raw_tokens(c: str) -> str:
    return found(c, rf"[A-Za-z_$][A-Za-z0-9_$]+|{HAN}{{2,}}")


def technical_tokens(c: str) -> str:
    """Quoted code, paths, dotted names, PascalCase and camelCase, in that order."""
    edge = r"(?<![A-Za-z0-9_])"
    return "array_distinct(filter(transform(concat(" + ", ".join([
        found(c, r"`([^`\r\n]{1,160})`", 1),
        found(c, r"(?:[A-Za-z]:)?(?:[.@A-Za-z0-9_$-]+[\\/])+[.@A-Za-z0-9_$-]+"),
        found(c, edge + r"[A-Za-z_$][A-Za-z0-9_$]*(?:[._-][A-Za-z0-9_$@-]+)+(?![A-Za-z0-9_])"),
        found(c, edge + r"(?:[A-Z][a-z0-9]+){2,}[A-Za-z0-9]*(?![A-Za-z0-9_])"),
        found(c, edge + r"[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*(?![A-Za-z0-9_])"),
    ]) + "), x -> trim(x)), x -> x <> ''))"


def han_bigrams(c: str) -> str:
    return f"flatten(transform({found(c, HAN + '{2,}')}, r -> transform(sequence(1, length(r) - 1), i -> substring(r, i, 2))))"


def natural_terms(c: str, stop: Iterable[str] = ()) -> str:
    """Words, numbers and Han runs of up to eight, expanded, then the Han bigrams."""
    tokens = found(c, rf"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|{HAN}{{1,8}}")
    return f"array_distinct(concat(flatten(transform({tokens}, w -> {expand_token('w', stop)})), {useful(han_bigrams(c), stop)}))"


def query_terms(c: str, stop: Iterable[str] = (), most: int = 64) -> str:
    technical = f"flatten(transform({technical_tokens(c)}, w -> {expand_token('w', stop)}))"
    return f"slice(array_distinct(concat({technical}, {natural_terms(c, stop)})), 1, {most})"


CLAUSE = r"(?i)(?:\r?\n+|[。！？!?；;]+|\s+(?:and\s+then|then|also|plus)\s+|(?:并且|同时|以及|然后|另外|此外|还要|并查找|并定位))"


def clauses(c: str) -> str:
    parts = f"filter(transform(split(trim({c}), {quote(CLAUSE)}), p -> {replaced('trim(p)', r'^[,，、:\s]+|[,，、:\s]+$', '')}), p -> p <> '')"
    return let("cs", parts, f"if(size(cs) = 0 and trim({c}) <> '', array(trim({c})), cs)")


def index_terms(c: str, stop: Iterable[str] = (), most: int = 3500) -> str:
    return f"slice(array_distinct(concat(flatten(transform({found(c, r'[A-Za-z_$][A-Za-z0-9_$]+|[0-9]{2,}')}, w -> {expand_token('w', stop)})), {natural_terms(han_only(c), stop)})), 1, {most})"


def han_only(c: str) -> str:
    return f"array_join({found(c, HAN + '+')}, ' ')"


def trigrams(c: str) -> str:
    """The set of trigrams of ^c$."""
    return let("g", f"concat('^', {c}, '$')", "array_distinct(transform(sequence(1, greatest(1, length(g) - 2)), i -> substring(g, i, 3)))")


def similarity(q: str, v: str, shared: str, n_q: str, n_v: str) -> str:
    """1 if equal, .82 if one holds the other, else the Dice coefficient of trigram sets; 0 below .42."""
    dice = f"2.0D * {shared} / ({n_q} + {n_v})"
    return f"case when {q} = {v} then 1.0D when contains({q}, {v}) or contains({v}, {q}) then 0.82D when abs(length({q}) - length({v})) <= greatest(5, length({q})) and {dice} >= 0.42D then {dice} else 0.0D end"


def owner_terms(c: str) -> str:
    return f"array_distinct({found(f'lower({c})', rf'[a-z_$][A-Za-z0-9_$-]+|{HAN}{{2,}}')})"


def path_words(c: str) -> str:
    return f"trim({replaced(c, '[^A-Za-z0-9]+', ' ')})"


def bert_words(c: str) -> str:
    """Lower-cased words, with CJK characters and punctuation on their own."""
    spaced = replaced(replaced(f"lower({c})", f"({HAN})", " $1 "), r"([\p{Punct}])", " $1 ")
    return f"filter(split(trim({spaced}), '\\\\s+'), w -> w <> '')"


def dot(a: str, b: str) -> str:
    """Inner product in doubles, in order."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0.0D, (s, x) -> s + x)"


def sanitized(c: str) -> str:
    return replaced(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def is_binary(c: str) -> str:
    """A NUL, or more than a tenth of control characters."""
    return f"(contains({c}, '\\u0000') or length({c}) - length({sanitized(c)}) > 0.1D * length({c}))"


def content_hash(path: str, c: str) -> str:
    return f"sha2(concat(length({path}), ':', {path}, length({c}), ':', {c}), 256)"


def base64url(c: str) -> str:
    return f"rtrim('=', translate(replace(base64({c}), '\\r\\n', ''), '+/', '-_'))"


def cursor(identity: str, offset: str) -> str:
    return base64url(f"cast(to_json(named_struct('v', 1, 'id', {identity}, 'offset', {offset})) as binary)")


def cursor_offset(cursor_: str, identity: str, total: str) -> str:
    """The cursor's offset; null if it is malformed, another query's, or out of range."""
    padded = f"rpad(translate({cursor_}, '-_', '+/'), cast(ceil(length({cursor_}) / 4.0) * 4 as int), '=')"
    held = f"from_json(cast(try_to_binary({padded}, 'base64') as string), 'v int, id string, offset long')"
    return let("k", held, f"if(k.v = 1 and k.id = {identity} and k.offset between 0 and {total}, k.offset, null)")


def glob_pattern(glob: str) -> str:
    """A glob (*, ?, **, [classes]) as an anchored pattern; a plain Python rule, run once when the plan is made."""
    import re

    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def ignore_pattern(rule: str) -> tuple[str, bool]:
    """(pattern, negated) of one line of an ignore file, for paths relative to the file's folder: a slash anchors, a
    final one takes folders only, and what is in an ignored folder is ignored."""
    negated = rule.startswith("!")
    body = rule[negated:]
    folder = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    inner = glob_pattern(body.lstrip("/"))[1:-1]
    return f"^{'' if anchored else '(?:.*/)?'}{inner}{'/.*' if folder else '(?:/.*)?'}$", negated
