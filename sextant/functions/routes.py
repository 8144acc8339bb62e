"""What a query asks for: roles, intents and the kind of search."""

from __future__ import annotations

from . import fixed
from .text import found, has, let, listed, quote, whole

# Patterns by role, on the lower-cased query.
ROLE_WORDS = (
    ("test", whole("test|tests|testing|spec|fixture|mock|coverage") + "|测试|用例|覆盖率|样本"),
    ("documentation", whole("docs?|documentation|readme|guide|example") + "|文档|说明|示例"),
    ("config", whole("config|configuration|setting|env|deploy|docker") + "|配置|环境变量|部署"),
    ("entrypoint", whole("entrypoint|bootstrap|startup|server|servers|route|endpoint|cli|main|mcp") + "|入口|启动|路由|端点|注册工具"),
    ("export", whole("export|exports|barrel|public api|re-export") + "|导出|暴露接口"),
    ("implementation", whole("implement|implementation|owner|source|logic|function|class|method") + "|实现|源码|逻辑|函数|方法|类"),
)


def role_intents(q: str) -> str:
    """array of (role, score), highest first, ties by name; implementation is always there, with .55 if other roles were named."""
    named = "filter(array(" + ", ".join(f"if({has(f'lower({q})', p)}, '{r}', '')" for r, p in ROLE_WORDS) + "), r -> r <> '')"
    rows = "transform(ns, r -> named_struct('role', r, 'score', 1.0D))"
    default = "if(array_contains(ns, 'implementation'), cast(array() as array<struct<role:string,score:double>>), array(named_struct('role', 'implementation', 'score', if(size(ns) = 0, 1.0D, 0.55D))))"
    return let("ns", named, f"array_sort(concat({rows}, {default}), (a, b) -> case when a.score <> b.score then if(a.score > b.score, -1, 1) when a.role < b.role then -1 else 1 end)")


def role_intent(q: str) -> str:
    return f"element_at({role_intents(q)}, 1).role"


# Fixed values: (kind, weight, signal, pattern) on the query as it is.
SIGNALS = (
    ("exact", 3, "quoted-literal", r"""["'`][^"'`]{2,}["'`]"""),
    ("exact", 3, "exact-language", "(?i)" + whole("exact|literal|hardcoded|string match") + "|所有出现|每一处|全部位置|精确匹配|字符串|枚举所有"),
    ("exact", 2, "grep-tool", "(?i)" + whole("rg|ripgrep|grep")),
    ("impact", 4, "impact-language", "(?i)" + whole("call(ers|ees)?|call graph|who calls|referenced by|dependenc(y|ies)|impact|blast radius|upstream|downstream") + "|谁调用|调用链|调用方|被谁用|依赖关系|影响面|引用链|上游|下游"),
    ("complex", 3, "complex-language", "(?i)" + whole("how does|end-to-end|architecture|trace(?: the)? (?:complete )?(?:request )?(?:flow|lifecycle)|request lifecycle|complete flow|walk through|implement(ation)? of|why does") + "|怎么实现|如何实现|梳理|端到端|完整流程|架构|为什么|链路|跨包|跨模块"),
    ("complex", 1, "long-query", r"(?s)^.{120}"),
    ("symbol", 4, "file-name", r"(?i)(^|[\s/\\])[A-Za-z0-9_.-]+\.(go|ts|tsx|js|jsx|mjs|cjs|py|rs|java|kt|css|json|yml|yaml|md|sql)(?![A-Za-z0-9_])"),
    ("symbol", 2, "path-like", r"[\\/][A-Za-z0-9_.-]+[\\/]|(?i)(?<![A-Za-z0-9_])(src|app|lib|pkg|packages|backend|frontend)/"),
    ("symbol", 3, "qualified-symbol", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]+(?:\.|::|#)[A-Za-z0-9_]+"),
    ("semantic", 2, "locate-language", "(?i)" + whole("where (is|are|does)|find|locate|search for") + "|在哪|哪里|找一下|定位|搜索"),
)
CAMEL = whole("[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+")
SNAKE = whole("[a-z][a-z0-9]*(?:_[a-z0-9]+)+")
NAMED = r"""(?i)(?<![A-Za-z0-9_])(?:function|class|method|component|hook|type|interface|struct|handler)\s+(?:named\s+)?[`"']?([A-Za-z_$][A-Za-z0-9_$]*)[`"']?"""
PROSE = "a an and for from in into of on the through to with".split()
ORDER = ("impact", "exact", "complex", "symbol", "semantic")


def _weight(kind: str, q: str) -> str:
    return " + ".join([f"if({has(q, p)}, {w}, 0)" for k, w, _, p in SIGNALS if k == kind] or ["0"])


def route_scores(q: str) -> str:
    """struct of the five kinds' scores."""
    named = f"regexp_extract({q}, {quote(NAMED)}, 1)"
    symbol = (
        f"{_weight('symbol', q)} + {let('n', f'size({found(q, CAMEL)})', 'if(n > 0, least(4, n + 1), 0)')} + {let('n', f'size({found(q, SNAKE)})', 'if(n > 0, least(3, n + 1), 0)')}"
        f" + if({named} <> '' and not array_contains({listed(PROSE)}, lower({named})), 2, 0)"
    )
    prose = f"if(size({found(q, '[一-鿿]')}) >= 4 or size({found(q, '[A-Za-z]{2,}')}) >= 5, 1, 0)"
    base = f"named_struct('impact', {_weight('impact', q)}, 'exact', {_weight('exact', q)}, 'complex', {_weight('complex', q)}, 'symbol', {symbol}, 'semantic', {_weight('semantic', q)} + {prose})"
    prior = "s.semantic + if(s.symbol = 0 and s.exact = 0 and s.impact = 0, 2, 0)"
    return let("s", base, f"if(trim({q}) = '', named_struct('impact', 0, 'exact', 0, 'complex', 0, 'symbol', 0, 'semantic', 0), named_struct('impact', s.impact, 'exact', s.exact, 'complex', s.complex, 'symbol', s.symbol, 'semantic', {prior}))")


def route_kind(q: str) -> str:
    top = "greatest(s.impact, s.exact, s.complex, s.symbol, s.semantic)"
    first = " ".join(f"when s.{k} = {top} then '{k}'" for k in ORDER[:-1])
    kind = f"case when s.impact < {top} and s.exact < {top} and s.complex < {top} and s.symbol < {top} and s.complex >= 3 and s.complex >= {top} - 1 then 'complex' {first} else 'semantic' end"
    return f"if(trim({q}) = '', 'semantic', {let('s', route_scores(q), kind)})"


def preferred_turns(kind: str, base: str) -> str:
    b = f"greatest(1, least(5, {base}))"
    return f"case {kind} when 'impact' then greatest({b}, 3) when 'complex' then least(5, greatest({b}, 3)) else least({b}, 2) end"


def primary(kind: str, graph: str, hybrid: str) -> str:
    return (
        f"case {kind} when 'symbol' then case when {graph} then 'graph' when {hybrid} then 'hybrid' else 'remote' end"
        f" when 'semantic' then case when {hybrid} then 'hybrid' when {graph} then 'graph' else 'remote' end"
        f" when 'exact' then 'rg' when 'impact' then if({graph}, 'graph', 'remote') else 'remote' end"
    )


def intent_flags(terms: str) -> str:
    flags = [f"'{k}', arrays_overlap({terms}, {listed(v)})" for k, v in fixed.INTENT_TERMS.items()]
    flags.append(f"'tooling', arrays_overlap({terms}, {listed(fixed.TOOLING_TERMS)})")
    flags.append(f"'surface', arrays_overlap({terms}, {listed(fixed.SURFACE_TERMS)})")
    strong = f"size(array_intersect({terms}, {listed(fixed.SURFACE_TERMS)})) >= 2 and arrays_overlap({terms}, {listed(fixed.SURFACE_ENTRY_TERMS)})"
    return f"named_struct({', '.join(flags)}, 'strong', {strong})"


def is_cjk_dominant(q: str) -> str:
    return f"(size({found(q, '[一-鿿]')}) >= 4 and not {has(q, '[A-Za-z_$][A-Za-z0-9_$]{2,}')})"


def local_first(mode: str = "auto") -> str:
    """Whether local results answer the query. Reads columns profile, kind, cjk, graph_used, graph_conf, graph_cov, graph_hit, graph_total,
    graph_path, hybrid_used, hybrid_score, hybrid_second, hybrid_cov, hybrid_hit, hybrid_total, hybrid_path, vector_score, vector_path."""
    by = lambda i: f"case profile when 'fast' then {fixed.DECISION['fast'][i]}D when 'quality' then {fixed.DECISION['quality'][i]}D else {fixed.DECISION['balanced'][i]}D end"
    graph_strong = "(graph_used and graph_conf = 'high' and graph_cov >= case profile when 'quality' then 0.62D when 'fast' then 0.45D else 0.48D end and graph_hit >= if(graph_total <= 1, 1, 2))"
    graph_medium = "(graph_used and graph_conf = 'medium' and graph_cov >= case profile when 'quality' then 0.36D else 0.28D end)"
    relevant = "(hybrid_used and hybrid_hit >= 1 and hybrid_cov >= if(hybrid_total <= 1, 0.5D, 0.2D))"
    hybrid_strong = f"(hybrid_used and hybrid_score >= {by(0)} and hybrid_cov >= if(hybrid_total <= 1, 0.75D, 0.35D) and hybrid_hit >= if(hybrid_total <= 1, 1, 2))"
    hybrid_ok = f"({relevant} and hybrid_score >= {by(1)})"
    winner = f"({relevant} and hybrid_score >= {by(2)} and hybrid_score - hybrid_second >= {by(3)})"
    vector_strong = "(vector_score >= 0.62D)"
    agree = (
        f"((graph_path = hybrid_path and {graph_strong} and {relevant}) or ({vector_strong} and ((vector_path = graph_path and ({graph_strong} or {graph_medium})) or (vector_path = hybrid_path and {relevant}))))"
    )
    keys = ["gs", "gm", "rel", "hs", "ok", "win", "vs", "agree"]
    values = [graph_strong, graph_medium, relevant, hybrid_strong, hybrid_ok, winner, vector_strong, agree]
    struct = "named_struct(" + ", ".join(f"'{k}', coalesce({v}, false)" for k, v in zip(keys, values, strict=True)) + ")"
    auto = (
        "(d.agree and kind in ('semantic', 'symbol', 'exact')) or (d.gs and kind in ('symbol', 'exact', 'impact')) or (d.gs and kind = 'semantic' and profile <> 'quality')"
        " or (d.hs and kind in ('semantic', 'symbol')) or (d.gs and d.ok) or (profile <> 'quality' and kind in ('semantic', 'symbol') and (d.gs or d.gm) and d.ok)"
        " or (profile <> 'quality' and d.win and kind in ('semantic', 'symbol', 'exact'))"
    )
    if mode == "off":
        return "false"
    if mode == "on":
        return let("d", struct, "d.gs or d.gm or d.rel or d.vs")
    body = f"if(kind = 'complex', d.agree or (d.gs and d.ok) or (profile = 'fast' and d.gs and d.rel), ({auto}) and (not cjk or d.agree))"
    return let("d", struct, body)


def adapted_turns(turns: str, kind: str, graph_conf: str) -> str:
    """One turn is enough where the graph is sure; impact and complex queries keep theirs."""
    return f"if({kind} in ('symbol', 'semantic') and {graph_conf} = 'high', 1, {turns})"
