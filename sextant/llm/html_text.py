"""Main text of web pages by the maximum-scoring contiguous run of blocks.

A page becomes words and tags. Words score positive, tags negative, words in parts that labelled pages show to be
furniture negative too; one linear scan (Kadane's) finds the run of blocks with the highest sum. Weights are log
odds counted on labelled pages: `labelled_pages` fills the site skeletons of SKELETONS, `fit` counts on any table (html, text).
Inside the run, blocks of furniture (an advert between paragraphs) are left out.

What speaks for furniture is learned for tags, for whole names (of a class, id, role) and, for names that no labelled page has, for the words in them.
The last is weak evidence ("has-sidebar" is no sidebar): it doesn't count for an element that holds most of the page's words. Names of html and
body never count, and neither does a form around most of the page.

Null and empty html gives an empty text. Unclosed tags, stray ends and quotes are taken as browsers take them. Elements that HTML doesn't know are
part of the line, as in browsers. Of runs with the same score the first counts.
Every row gives one row, repeated ids included; an empty table gives none. Pages are read one by one; none is cut, however long. Columns of
the input pass through, but `text` and the html column give way.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|textarea|select|iframe|object|title|canvas)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)[^>]*>|<[!?/][^>]*>",
    re.I | re.S,
)
NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's elements without content, those that hold others, and the others that end a line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HOLDERS = {"html", "body", "head", "article", "main", "nav", "header", "footer", "aside", "form", "section", "div", "ul", "ol", "dl", "table", "menu", "dialog", "fieldset", "figure", "button", "details", "search"}
LINES = {"address", "blockquote", "caption", "center", "dd", "dir", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "legend", "li", "optgroup", "option", "p", "pre", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
MAIN = ("article", "main")

#: Skeletons of sites, as they are usual; ARTICLE stands for the main text, SAY and LIST for other text and links.
SKELETONS = (
    "<header class='site-header'><div class='logo'>SAY</div><nav class='navbar'>LIST</nav></header><div class='breadcrumb'>SAY</div><article class='post'>ARTICLE</article><aside class='sidebar'><div class='widget'>SAY LIST</div><div class='ad'>SAY</div></aside><section id='comments' class='comments'><div class='comment'>SAY</div><div class='comment'>SAY</div></section><footer class='site-footer'>SAY LIST</footer>",
    "<div id='header'><h2>SAY</h2></div><div id='nav' class='menu'>LIST</div><div class='cookie-notice'>SAY<button>SAY</button></div><div id='content' class='entry-content'>ARTICLE</div><div class='share social'>LIST</div><div class='related'>LIST</div><div id='footer'>SAY</div>",
    "<nav role='navigation'>LIST</nav><div class='banner advert'>SAY</div><main>ARTICLE</main><form class='newsletter subscribe'><label>SAY</label><button>SAY</button></form><div id='sidebar'>LIST</div><div class='comment-list'><div class='comment-body'>SAY</div></div><div class='copyright'>SAY</div>",
    "<div class='wrapper'><div class='masthead'>SAY</div><div class='navigation'>LIST</div><div class='alert notice'>SAY</div><div class='main-content'>ARTICLE</div><div class='ads sponsored'>SAY</div><div class='pagination pager'>LIST</div><div class='footer legal'>SAY</div></div>",
    "<div class='container'><ul class='menu'>LIST</ul><div class='search'><form>SAY</form></div><section class='article-body'>ARTICLE</section><div class='promo'>SAY</div><div class='recommended'>LIST</div><div id='respond' class='disqus'>SAY</div><div class='disclaimer'>SAY</div></div>",
    "<div class='page'><div class='topbar toolbar'>LIST</div><div class='popup modal'>SAY</div><div class='login signup'><form>SAY</form></div><div class='story'>ARTICLE</div><dialog class='consent cookies'>SAY</dialog><menu>LIST</menu><fieldset>SAY</fieldset><div class='advertisement'>SAY</div></div>",
    "<header><h1>SAY</h1></header><div class='ad-banner'>SAY</div><article><div class='text'>ARTICLE</div></article><div class='commentlist'><p>SAY</p></div><div class='cookie'>SAY</div><aside>SAY</aside><div class='sponsor advertising'>SAY</div><div class='breadcrumbs'>LIST</div><footer>SAY</footer>",
    "<div class='layout'><div class='notices'>SAY</div><div class='post-content'>ARTICLE</div><div class='nav'>LIST</div><div class='adverts'>SAY</div><div class='header'>SAY</div><div class='aside widgets'>SAY</div><div class='footer'>SAY</div></div>",
)

#: Parameters of the scan: what a word of furniture costs, what a tag costs that main texts hold, and from how rare a tag is there it ends the text.
FURNITURE_WORD, WITHIN, ENDS, TAG_WEIGHT = -0.5, -0.02, 0.004, 6.0
#: A name speaks for furniture from these log odds on; an element holds most of a page from this share of its words on.
LEAST_ODDS, MOST_OF_PAGE = -4.0, 0.5


def labelled_pages(n: int = 400, skeletons: tuple[str, ...] = SKELETONS, seed: int = 11) -> list[tuple[str, str]]:
    """(html, main text) of pages made from skeletons."""
    r = random.Random(seed)
    say = lambda k: " ".join("".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9))) for _ in range(k))
    shapes = ["<p>{}</p>"] * 5 + ["<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", *["<ul><li>{}</li></ul>", "<ol><li>{}</li></ol>", "<div>{}</div>", "<div><div>{}</div></div>"] * 2, "<pre>{}</pre>", "<section>{}</section>", "<figure><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td></tr></table>", "<dl><dd>{}</dd></dl>"]
    out = []
    for p in range(n):
        lines = [say(r.randint(8, 90)) for _ in range(r.randint(3, 12))]
        article = f"<h1>{lines[0]}</h1>" + "".join(r.choice(shapes).format(x) for x in lines[1:])
        fill = {"ARTICLE": lambda a=article: a, "SAY": lambda: r.choice([say(6), f"<p>{say(9)}</p>", say(14)]), "LIST": lambda: "<ul>" + "".join(f"<li><a href='/{i}'>{say(1)}</a></li>" for i in range(5)) + "</ul>"}
        page = re.sub("ARTICLE|SAY|LIST", lambda m, fill=fill: fill[m[0]](), skeletons[p % len(skeletons)])
        out.append((f"<html><head><title>{lines[0]}</title></head><body>{page}</body></html>", "\n".join(lines)))
    return out


@dataclass
class Element:
    name: str
    names: tuple[str, ...]  # of its class, id and so on
    hidden: bool = False
    words: int = 0


@dataclass
class Block:
    text: str
    words: int
    tags: tuple[str, ...]  # before it
    held: tuple[Element, ...] = field(repr=False)  # by what, outermost first


def blocks(page: str) -> list[Block]:
    """The page's blocks of text with what stands between and around them."""
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    tags: list[str] = []

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Block(text, text.count(" ") + 1, tuple(tags), tuple(stack)))
            for x in stack:
                x.words += out[-1].words
            tags.clear()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() in ("title", "select", "textarea"):
                flush()
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if name not in HOLDERS and name not in LINES:
            if name == "br":
                parts.append(" ")
            continue
        end = bool(m["end"] or m["end2"])
        flush()
        inner = name not in MAIN and any(x.name in MAIN for x in stack)  # such a tag is weighed apart
        tags.append("in:" * inner + "/" * end + name)
        if name not in HOLDERS:
            continue
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        if name == "body" or name in (*MAIN, "section") and stack and stack[-1].name == "head":
            stack.clear()  # the head ends here, closed or not
        attrs = m["attrs"] or ""
        names = tuple(t for x in NAMED.findall(attrs) for t in "".join(x).split()) if attrs else ()
        stack.append(Element(name, names, bool(attrs) and bool(HIDDEN.search(attrs))))
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    flush()
    return out


def words_of(name: str) -> list[str]:
    return [p.lower() for p in PART.findall(name)]


COMMENTS = {"comment", "comments", "commentlist", "respond", "disqus"}


@dataclass
class Weights:
    tags: dict[str, float]  # cost of a tag between blocks
    holders: dict[str, float]  # log odds of an element's name, ".name" of a whole class or id, "~word" of a word in one

    def cost(self, block: Block) -> float:
        return sum(self.tags.get(t, WITHIN) for t in block.tags)

    def evidence(self, x: Element, total: int) -> bool:
        """Whether an element is furniture."""
        if x.hidden:
            return True
        most = x.words > MOST_OF_PAGE * total
        if x.name in ("html", "body"):
            return False
        if self.holders.get(x.name, 0.0) <= LEAST_ODDS and not (most and x.name == "form"):
            return True
        found = [self.holders.get("." + n.lower()) for n in x.names]
        if any(o is not None and o > 0 for o in found):
            return False  # one of its names is that of a main text
        if any(o is not None and o <= LEAST_ODDS for o in found):
            return True
        unknown = [n for n, o in zip(x.names, found, strict=True) if o is None]
        return not most and any(self.holders.get("~" + w, 0.0) <= LEAST_ODDS for n in unknown for w in words_of(n))

    def furniture(self, block: Block, total: int, known: dict[int, bool]) -> bool:
        """Whether what holds the block speaks against it; an article or main starts anew, but for readers' comments."""
        held, before = block.held, ()
        for i in range(len(held) - 1, -1, -1):
            if held[i].name in MAIN:
                before, held = held[:i], tuple(x for x in held[i:] if x.name != "header")
                break
        for x in held:
            if id(x) not in known:
                known[id(x)] = self.evidence(x, total)
        return any(known[id(x)] for x in held) or any(x.hidden or x.name not in ("html", "body") and any(COMMENTS & {n.lower(), *words_of(n)[:1]} for n in x.names) for x in before)

    def best(self, page: str) -> list[Block]:
        """The blocks of the maximum-scoring run that aren't furniture."""
        found = blocks(page)
        known: dict[int, bool] = {}
        words = sum(b.words for b in found)
        bad = [self.furniture(b, words, known) for b in found]
        costs, gains = [], []
        for b, x in zip(found, bad, strict=True):
            inside = x and any(e.name in MAIN for e in b.held)  # furniture inside the article doesn't end it
            costs.append(0.0 if inside else self.cost(b))
            gains.append(0.0 if inside else (FURNITURE_WORD if x else 1.0) * b.words)
        a, b = best_run(costs, gains)
        return [x for x, y in zip(found[a:b], bad[a:b], strict=True) if not y]

    def text(self, page: str) -> str:
        return "\n".join(b.text for b in self.best(page))


def best_run(costs: list[float], gains: list[float]) -> tuple[int, int]:
    """The run (from, to) with the highest sum of gains and of the costs between its blocks; the first of those; (0, 0) if none is above 0."""
    best, total, start, run = 0.0, 0.0, 0, (0, 0)
    for i, (cost, gain) in enumerate(zip(costs, gains, strict=True)):
        if total + cost <= 0:
            total, start = 0.0, i
        else:
            total += cost
        total += gain
        if total > best:
            best, run = total, (start, i + 1)
    return run


def fit(pages: list[tuple[str, str]]) -> Weights:
    """Log odds on labelled pages: of the holders of words (inside the main text or not), and of tags within it against tags at or beyond its edges."""
    inside, outside, within, beyond = Counter(), Counter(), Counter(), Counter()
    for page, text in pages:
        lines = Counter(text.split("\n"))
        found = blocks(page)
        good = []
        for b in found:
            good.append(lines[b.text] > 0)
            lines[b.text] -= 1
            marks = {k for x in b.held for k in (x.name, *("." + n.lower() for n in x.names), *("~" + w for n in x.names for w in words_of(n)))}
            (inside if good[-1] else outside).update(dict.fromkeys(marks, 1))
        for b, g, before in zip(found, good, [False, *good], strict=False):
            (within if g and before else beyond).update(b.tags)
    holders = {z: math.log((inside[z] + 0.5) / (outside[z] + 0.5)) for z in {*inside, *outside}}
    tags = {t: WITHIN if within[t] > ENDS * beyond[t] else TAG_WEIGHT * math.log((within[t] + 1) / (within[t] + beyond[t] + 1)) for t in {*within, *beyond}}
    tags = {t: WITHIN if t.startswith("in:") else c for t, c in tags.items()}
    return Weights(tags, holders)


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return fit(labelled_pages())


def extract(pages: DataFrame, weights: Weights | None = None, html_col: str = "html") -> DataFrame:
    """pages with `text` in place of html_col; a column of that name gives way."""
    weights = weights or default_weights()
    df = pages.select(*[c for c in pages.columns if c not in (html_col, "text")], html_col)
    at = len(df.columns) - 1

    def run(batches):
        for x in pieces(batches, at):
            texts = [weights.text(p) if p else "" for p in x.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*list(x.columns)[:at], pa.array(texts, pa.string())], schema=pa.schema([*list(x.schema)[:at], pa.field("text", pa.string())]))

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:at], T.StructField("text", T.StringType())]))


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
