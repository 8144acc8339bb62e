"""What a path says: its role, its predicates and the adjustments that ranking makes for them."""

from __future__ import annotations

from . import fixed
from .text import has, listed, quote, replaced, whole


def normalized(p: str) -> str:
    return f"lower({replaced(replaced(p, r'\\', '/'), '^/+', '')})"


def name(p: str) -> str:
    return f"element_at(split({p}, '/'), -1)"


def stem(p: str) -> str:
    return replaced(name(p), r"(?<=.)\.[^.]*$", "")


def extension(p: str) -> str:
    return f"lower(regexp_extract({name(p)}, {quote(r'.\.([^.]+)$')}, 1))"


def is_source(p: str) -> str:
    return f"(array_contains({listed(fixed.SOURCE_EXTENSIONS)}, {extension(p)}) or array_contains({listed(fixed.CONFIG_NAMES)}, lower({name(p)})))"


def language(p: str) -> str:
    whens = " ".join(f"when {quote(e)} then {quote(v)}" for e, v in fixed.GRAPH_EXTENSIONS.items())
    return f"case {extension(p)} {whens} end"


CONFIG_FILE = r"^(?:.*\.ya?ml|.*\.toml|dockerfile.*|caddyfile|package\.json|tsconfig.*\.json|\.env\.example)$"


def is_config(p: str) -> str:
    return has(f"lower({name(p)})", CONFIG_FILE)


# Roles by the first pattern that a lower-cased path or its name matches.
ROLE_PATTERNS = (
    ("test", "path", r"(^|/)(tests?|__tests__|specs?|fixtures?|testdata|mocks?)(/|$)"),
    ("test", "name", r"(?:^|[._-])(test|spec|fixture|mock)(?:[._-]|$)"),
    ("documentation", "path", r"(^|/)(docs?|documentation|examples?)(/|$)"),
    ("documentation", "name", r"\.(md|mdx|rst|adoc|txt)$"),
    ("documentation", "name", r"^(readme|changelog|contributing|license)(\.|$)"),
    ("config", "path", r"(^|/)(config|configs|migrations?|deploy|\.github)(/|$)"),
    ("config", "name", r"(^|[._-])(config|rc)([._-]|$)"),
    ("config", "name", r"^(\.env(?:\..+)?|\.npmrc|\.yarnrc(?:\.yml)?|\.editorconfig|\.prettierrc(?:\..+)?|\.eslintrc(?:\..+)?)$"),
    ("config", "name", r"\.(json|ya?ml|toml|ini|env|properties|lock)$"),
    ("config", "name", r"^(dockerfile|makefile|gemfile|procfile|tsconfig|vite\.config|webpack\.config)"),
    ("export", "path", r"(^|/)(index|mod|exports?|public-api)\.[cm]?[jt]sx?$"),
    ("export", "path", r"(^|/)(__init__|mod)\.(py|rs)$"),
    ("entrypoint", "path", r"(^|/)(main|server|app|cli|route|worker)\.[cm]?[jt]sx?$"),
    ("entrypoint", "path", r"(^|/)(main|server|app|cli|worker)\.(py|go|rs|java|kt|cs|php|rb)$"),
    ("entrypoint", "name", r"^(main|server|app|cli|route|worker)(\.[^.]*)?$"),
)


def role(p: str) -> str:
    n = normalized(p)
    whens = " ".join(f"when {has(n if where == 'path' else name(n), pattern)} then '{r}'" for r, where, pattern in ROLE_PATTERNS)
    return f"case {whens} else 'implementation' end"


def intent_adjustment(p: str, intent: str) -> str:
    n = normalized(p)
    entry = f"array_contains({listed(fixed.ENTRY_STEMS)}, {stem(n)})"
    core = f"array_contains({listed(fixed.ENTRY_STEMS[:4])}, {stem(n)})"
    parts = [
        f"if({entry}, 0.20D, 0.0D)",
        f"if({has(n, r'(^|/)(src|app|cmd|bin)/')} and {core}, 0.10D, 0.0D)",
        f"if({has(n, r'(^|/)(scripts?|benchmarks?|benches?|fixtures?)(/|$)')}, -0.24D, 0.0D)",
        f"if({has(name(n), r'(^|[._-])(compare|smoke|bench|fixture|sample|mock)([._-]|$)')}, -0.18D, 0.0D)",
        f"if({has(n, r'(^|/)(tests?|__tests__|docs?)(/|$)')}, -0.10D, 0.0D)",
    ]
    aside = f"if({has(n, r'(^|/)(scripts?|benchmarks?|benches?)(/|$)')}, -0.08D, 0.0D)"
    return f"case {intent} when 'entrypoint' then {' + '.join(parts)} when 'implementation' then {aside} else 0.0D end"


def is_tooling(p: str) -> str:
    return has(p, "^(scripts|benchmarks|docs)/")


def is_runtime(p: str) -> str:
    return has(p, "^(src|app|pages)/")


def is_entry(p: str) -> str:
    return has(p, r"(^|/)(server|index|main|app|route)\.[cm]?[jt]sx?$")


# What marks a helper file.
HELPER = (
    r"(^|/)(helpers?|utils?|lib|shared|config)(/|$)"
    r"|(^|/)(extract|parse|format|normalize|resolve|load|read|write|config|credential|key|client|provider)[A-Za-z0-9_-]*\.[cm]?[jt]sx?$"
    r"|(?:helper|util|config|credential|key|client|provider)[A-Za-z0-9_-]*\.[cm]?[jt]sx?$"
)


def hint_group(p: str, role_: str, rank: str, imported: str, touched: str) -> str:
    """Where a hint lists a file (rank from 0): by its role if one is known, else by its path, an entry point's import and its rank."""
    return (
        f"case when {role_} = 'entrypoint' then 'entrypoints' when {role_} = 'implementation' then 'implementations' when {role_} in ('test', 'documentation', 'config', 'export') then 'helpers'"
        f" when {is_entry(p)} then 'entrypoints' when {has(p, HELPER)} and {rank} > 0 then 'helpers' when {imported} or {rank} <= 2 then 'implementations' when {touched} then 'helpers' else 'implementations' end"
    )


def is_test(p: str) -> str:
    return has(p, r"(^|/)__tests__/|[._-](test|spec)\.[cm]?[jt]sx?$|_test\.go$")


def test_base(p: str) -> str:
    """The name without test suffix and extension; what a test and its subject share."""
    return replaced(replaced(name(p), r"(\.(test|spec)|[-_]test)(?=\.[cm]?[jt]sx?$)|_test(?=\.go$)", ""), r"\.([cm]?[jt]sx?|go)$", "")


def local_multiplier(p: str, q: str) -> str:
    """Of the merge across rankers: supporting files go down unless the query asks for such, product source goes up."""
    n = normalized(p)
    asks = has(f"lower({q})", whole("test|tests|spec|script|scripts|fixture|benchmark|docs?|documentation") + "|测试|脚本|基准|文档")
    supports = has(n, r"(^|/)(scripts?|tests?|__tests__|fixtures?|benchmarks?|docs?)(/|$)|\.(test|spec)\.[^.]+$")
    return f"case when {supports} and not {asks} then 0.68D when {has(n, '^(src|app|lib|pkg|packages)/')} then 1.08D else 1.0D end"


def inside(p: str) -> str:
    """Whether a relative path stays below its root: no absolute path, and never more .. than folders before them."""
    segments = f"split(replace({p}, '\\\\', '/'), '/')"
    depth = f"aggregate({segments}, 0, (d, s) -> case when d < 0 then d when s in ('', '.') then d when s = '..' then d - 1 else d + 1 end)"
    return f"(not {has(p, r'^([/\\]|[A-Za-z]:)')} and {depth} >= 0)"


def resolved(p: str) -> str:
    """The path without . and .. segments."""
    return f"array_join(aggregate(split({p}, '/'), cast(array() as array<string>), (a, s) -> case when s in ('', '.') then a when s = '..' then slice(a, 1, greatest(size(a) - 1, 0)) else array_append(a, s) end), '/')"
