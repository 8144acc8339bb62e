"""DuckDB spellings for the oracles; none is built from the Spark expressions."""

from __future__ import annotations


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parts(c: str, keep: str = "") -> str:
    x = f"regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    if not keep:
        x = f"regexp_replace({x}, '[_$]+', ' ', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[^A-Za-z0-9{keep}\\p{{Han}}]+'), lambda p: lower(trim(p))), lambda p: p <> '')"


def stop_list(stop) -> str:
    return "[" + ", ".join(map(quote, stop)) + "]::VARCHAR[]"


def forms(token: str, stop=()) -> str:
    """A list of the forms of a token, repeats included."""
    raw = f"regexp_replace(trim({token}), '^[`''\"(\\[{{<]+|[`''\"\\])}}>.,;:!?]+$', '', 'g')"
    ps = parts(raw)
    ascii_ps = f"list_filter({ps}, lambda p: regexp_full_match(p, '[a-z0-9]+'))"
    joined = f"CASE WHEN len({ascii_ps}) > 1 THEN [array_to_string({ascii_ps}, ''), array_to_string({ascii_ps}, '_')] ELSE []::VARCHAR[] END"
    stripped = f"lower(regexp_replace({raw}, '[^A-Za-z0-9_$\\p{{Han}}]', '', 'g'))"
    every = f"list_concat([lower(replace({raw}, '\\', '/'))], {ps}, {joined}, [{stripped}])"
    return f"list_filter({every}, lambda t: length(t) >= 2 AND NOT list_contains({stop_list(stop)}, t))"


def word(alternatives: str) -> str:
    return rf"\b(?:{alternatives})\b"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quote(pattern)})"


def text_list(x: str) -> str:
    return f"array_to_string(list_sort({x}), '|')"
