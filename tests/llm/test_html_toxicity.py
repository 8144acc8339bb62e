"""op4 on made pages and labelled pages; op8 by held-out accuracy."""

import os
from collections import Counter

import numpy as np
import pytest

from sextant.llm import html_text, toxicity

SF = "/root/testdata/sf0.01"
BODY = "word " * 30
PAGES = [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<article>only &amp;amp; &eacute;&#233;</article>", "only &amp; éé"),
    (f"<nav>a b c</nav><article><h1> T\n\tt </h1><p>{BODY}<b>x</b>y<br>z<p>short<div class='ad'>buy now</div><p>end</article><footer>f</footer>", "T t\n" + BODY.strip() + " xy z\nshort\nend"),
    (f"<header><h1>Site</h1></header><main><p>{BODY}</p><aside>side</aside><p>more</p></main><section id=comments><p>{BODY}</p><p>{BODY}</p></section>", BODY.strip() + "\nmore"),
    (f"<head><title>t</title><script>var a='<p>no</p>'</script><style>p{{}}</style><body><div class='cookie-notice'>we use {BODY}</div><div><p>{BODY}</p></div><form>mail<input></form>", BODY.strip()),
    (f"<article><p>{BODY}</p><article class='comment'>{BODY * 3}</article></article>", BODY.strip()),
    (f"<article><p>1 < 2 & 3 > 2 {BODY}</p><!-- <p>no</p> --><p title='a>b'>q</p><p>unclosed", f"1 < 2 & 3 > 2 {BODY}".strip() + "\nq\nunclosed"),
    (f"<nav>menu<article><p>{BODY}</p></article>", BODY.strip()),
    (f"<article><p>{BODY}</p>" + "<p>p</p>" * 20000 + "</article>", BODY.strip() + "\np" * 20000),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, "u", p, "clash") for i, (p, _) in enumerate(PAGES)] + [(4, "u", PAGES[4][0], None)], "page_id long, url string, html string, text string")
    got = html_text.digest(df).collect()
    assert len(got) == len(PAGES) + 1
    for r in got:
        assert r.text == PAGES[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text)
    assert html_text.digest(df.limit(0)).collect() == []


ARTICLE = "<h1>T</h1>" + 2 * f"<p>{BODY}{BODY}</p>"
TEXT = "T" + 2 * f"\n{BODY}{BODY}".rstrip()
WRAPPED = [
    f"<body class='has-sidebar'>{ARTICLE}", f"<body class='page search-enabled'>{ARTICLE}", f"<body><div class='post header-fixed'>{ARTICLE}</div>",
    f"<title-bar>x</title-bar><article>{ARTICLE}</article>".replace("x</title-bar>", "</title-bar>"), f"<article><object-view>{ARTICLE}</object-view></article>", f"<form id=aspnetForm>{ARTICLE}</form>",
    f"<div class='ad'>x</div><div class='site-nav'>a b</div>{ARTICLE}<div class='left-sidebar'>{BODY}</div>", f"<div class='headerFixed noAds'>{ARTICLE}</div><div class='adBanner'>{BODY}</div>",
]


@pytest.mark.parametrize("page", WRAPPED)
def test_names_of_wrappers(page):
    assert html_text.default_weights().text(page) == TEXT


def test_inline_elements():
    assert html_text.default_weights().text("<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <my-tag>be</my-tag></p></article>") == "let x=2 be"


def test_labelled():
    """Weights of half of the skeletons, and pages made from the other half, most of whose names are others: nearly all words are right."""
    w = html_text.fit(html_text.labelled_pages(300, html_text.SKELETONS[::2]))
    pages = html_text.labelled_pages(100, html_text.SKELETONS[1::2], seed=5)
    held = [(w.text(h), t) for h, t in pages]
    assert np.mean([2 * sum((Counter(got.split()) & Counter(t.split())).values()) / len(got.split() + t.split()) for got, t in held]) > 0.9
    w = html_text.default_weights()
    assert sum(w.text(h) == t for h, t in html_text.labelled_pages(200, seed=7)) > 190


def test_best_run():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(0, 9))
        costs, gains = (-r.integers(0, 6, n) * 1.0).tolist(), (r.integers(-4, 6, n) * 1.0).tolist()
        runs = [(a, b) for a in range(n) for b in range(a + 1, n + 1)]
        score = lambda a, b, c=costs, g=gains: sum(g[a:b]) + sum(c[a + 1 : b])
        most = max((score(*x) for x in runs), default=0)
        got = html_text.best_run(costs, gains)
        assert (got == (0, 0)) if most <= 0 else score(*got) == most


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.digest(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 40
    y, p = out.toxic.to_numpy(), out.score.to_numpy()
    auc = ((p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])).mean()
    assert auc > 0.85 and ((out.predicted == y).mean() > 0.93) and ((p >= 0) & (p <= 1)).all()
    assert ((p >= 0.5) == (out.predicted == 1)).all()


def test_edges(spark):
    docs = spark.createDataFrame([(i, "you idiot worthless clown " * (i % 3 + 1) if i % 2 else "the fine day " * (i + 1), "x") for i in range(120)] + [(200, None, "x"), (201, "", "x"), (None, "you", "x"), (5, "a", None), (300, "W0RTHLESS " * 9000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == 125
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 120]) > 0.95
    assert {r.predicted for r in got if r.doc_id in (200, 201)} == {0}
    assert toxicity.clean(docs, labels).columns == docs.columns
    for few in (labels.limit(0), labels.where("toxic = 1")):
        assert len({r.score for r in toxicity.digest(docs, few).collect()}) == 1
    assert toxicity.digest(docs.limit(0), labels).collect() == []


def test_sample_is_bounded_by_rows(spark):
    """A labelled document that stands in many rows is one row of the sample; the model is the same in whatever order rows come."""
    rows = [(i, "you idiot worthless clown " * (i % 3 + 1) if i % 2 else "the fine day " * (i % 9 + 1)) for i in range(120)]
    docs = spark.createDataFrame(rows + [rows[7]] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    one, many = toxicity.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string"), labels), toxicity.fit(docs.repartition(5), labels)
    assert one.weights == many.weights and one.mean == many.mean
    assert all((a == b).all() for x, y in zip(one.trees.trees, many.trees.trees, strict=True) for a, b in zip(x, y, strict=True))


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and x[0] == 1
    x, y = toxicity.isotonic(np.array([1.0, 1, 1, 1, 2, 2]), np.array([0.0, 0, 0, 1, 1, 1]))
    assert np.interp(1.0, x, y) < 0.3 and np.interp(2.0, x, y) > 0.9
