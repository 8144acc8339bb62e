"""Word lists, extensions, patterns and weights that results depend on."""

SOURCE_EXTENSIONS = (
    "c cc cpp cs css dart go graphql h hpp html java js jsx kt kts lua md mdx mjs php proto py rb rs scss sh sql svelte swift toml ts tsx vue xml yaml yml"
).split()
CONFIG_NAMES = "dockerfile makefile gemfile procfile .gitignore .dockerignore".split()
GRAPH_EXTENSIONS = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go"}
EXCLUDED_DIRS = (
    ".ace-tool .cache .codegraph .git .hg .next .nuxt .svn .svelte-kit .turbo .venv build coverage deps dist node_modules out target third_party vendor venv"
).split()

# What is left out of a project whatever its ignore files say, and the names of ignore files in the order in which they are read; a tool's own
# folder and ignore file are added as parameters.
HARD_EXCLUDES = (
    ".git/ .hg/ .svn/ .model-cache/ node_modules/ dist/ build/ out/ coverage/ .next/ .nuxt/ .svelte-kit/ .turbo/ .cache/ __pycache__/ .venv/ venv/ vendor/ target/ "
    ".codegraph/ .codex/ .ace-tool/ .idea/ .vscode/ *.min.* *.exe *.log"
).split()
IGNORE_FILES = ".gitignore .cursorignore .ignore".split()

STOP_WORDS = "a all and are be by code does file files find for from how in is it of on or the this to where with".split()
GRAPH_STOP_WORDS = (
    "a about after all and are around be before by can code could does file files find for from happen how in including is it large make makes making of on or"
    " project repositories the this to when where which who with"
).split()
CODE_KEYWORDS = (
    "as async await break case catch class const continue default delete do else export extends false finally for from function get if import in instanceof let new null of"
    " return set static super switch this throw true try typeof undefined var void while with yield"
).split()

CONCEPT_GROUPS = (
    "auth authenticate authentication authorize authorization login logout jwt session token 登录 登陆 鉴权 认证 授权",
    "cache cached caching memo redis ttl 缓存",
    "config configuration env environment option setting settings 配置 环境变量",
    "database db migration orm pool query repository sql 数据库 数据访问",
    "error exception failure panic retry 异常 错误 失败 重试",
    "event log logging metric observability telemetry trace 日志 监控 埋点 追踪",
    "handler middleware request response route router server 中间件 请求 响应 路由",
    "limit quota rate ratelimit throttle 限流 配额 频率",
    "search index rank ranking retrieval semantic 检索 搜索 排序 索引 语义",
    "test testing spec fixture mock 测试 样本",
    "user account member profile 用户 账号 成员",
)

INTENT_TERMS = {
    "calls": "call calls caller callers callee callees impact".split(),
    "imports": "import imports dependency dependencies export exports".split(),
    "routes": "route routes routing handler endpoint api http".split(),
    "tests": "test tests spec coverage".split(),
}
TOOLING_TERMS = "benchmark benchmarks check cli graph index script scripts task tasks".split()
SURFACE_TERMS = "api auth credential credentials endpoint http mcp relay request requests route server tool tools".split()
SURFACE_ENTRY_TERMS = "api endpoint http mcp relay request requests route server tool tools".split()
RANGE_ALIASES = (
    ("command commands cmd cmds", "command commands cmd cmds toolargs", 0.85),
    ("execute executed execution exec run runs running", "exec execute executor await", 0.9),
    ("parse parsed parsing", "parse args toolargs json", 0.75),
    ("local locally", "local", 0.6),
)

ROLE_MULTIPLIERS = {"implementation": 1.14, "entrypoint": 1.12, "config": 0.82, "export": 0.72, "test": 0.66, "documentation": 0.58}
SUPPORT_ROLES = ("test", "documentation", "config", "export")
ENTRY_STEMS = "main server app cli route worker".split()

BM25_K1, BM25_B = 1.35, 0.72
CHUNK_LINES, CHUNK_OVERLAP, LEAST_CHUNK_LINES = 72, 16, 24
CHUNK_RRF, RADAR_RRF, CLAUSE_RRF, RANKING_LIMIT = 24, 12, 32, 160
SOURCE_WEIGHTS = {"bm25": 1.15, "subword": 0.85, "path": 0.9}
RADAR_WEIGHTS = {"graph": 1.05, "hybrid": 1.0, "vector": 0.92}
DYNAMIC = {"high": (0.55, 0.24, 0.64), "medium": (0.50, 0.18, 0.58), "low": (0.35, 0.10, 0.45)}
DECISION = {"fast": (0.55, 0.30, 0.45, 0.10), "quality": (0.75, 0.40, 0.62, 0.18), "balanced": (0.72, 0.32, 0.48, 0.10)}
