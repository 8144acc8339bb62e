"""Postings are counted where texts are read: the same terms as the expressions', nothing shuffled, texts tokenised once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sextant.functions import fixed, text, tokens
from sextant.operators import lexical
from sextant.plans import search
from sextant.queries import ORACLES, QUERIES
from sextant.queries.base import rounded

WORDS = "parseHTTPResponseID2Value the THE a_b __ $$ $x fooBar_baz XMLHttp2 x1 A1b2C3 _private snake_case_name Licensed HTTPServer aB AbC the_end 数据库访问 登录".split()
TEXTS = [
    "thation ershed Licensed apache\r\nparseHTTPResponseID2Value fooBar_baz 12 345 a12_34 7 12a a12 00",
    "数据库访问 mentation eau quement 缓存 x",
    None,
    "",
    "\n".join(f"licht {'under ' * 20}version keiten src{i} inonble" for i in range(60)),
    "token " * 300 + "email handler 4111 4111",
    "tokens tokenizer tokken emails mail handlers under_version undr versions licht",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forms_are_the_expressions(spark):
    rows = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = {r.w: r.f for r in rows.select("w", F.expr(text.expand_token("w", fixed.STOP_WORDS)).alias("f")).collect()}
    assert got == {w: list(tokens.forms(w, frozenset(fixed.STOP_WORDS))) for w in WORDS}


def test_han_is_the_script():
    found = duckdb.sql(r"select i from range(1, 1114111) t(i) where i not between 55296 and 57343 and regexp_matches(chr(i::int), '\p{Han}')").fetchall()
    assert {i for (i,) in found} == {i for r in tokens.HAN_RANGES for i in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1)}


def test_nothing_is_shuffled_or_read_again(spark):
    files = spark.createDataFrame([(f"p{i}.md", t) for i, t in enumerate(TEXTS)], "path string, text string")
    cut = lexical.chunks(files, 24, 8)
    assert "Exchange" not in plan(lexical.postings(cut, ["path", "chunk"], unique=not lexical.repeated(files)))
    queries = spark.createDataFrame([(1, "token email"), (2, "licht version")], "qid int, q string")
    assert "body" not in plan(search.hybrid(files, queries, search.Options(24, 8)))


@pytest.mark.parametrize("ids", ["apart", "repeated"])
def test_odd_texts(spark, tmp_path, ids):
    """Nulls, empty texts, Han, numbers and terms beyond 255; and with repeated ids, whose texts are one file's."""
    rows = [(i if ids == "apart" else i // 2, t, "en", "src") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    plain = lambda rows: sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)
    for name in "a1_postings a2_chunk_lengths a3_document_frequencies a4_bm25 a5_vocabulary a6_subword_scores w1_ranked_bm25 m1_chunk_rrf x22_confidence_scores a11_collapse_files".split():
        if ids == "repeated" and name in ("w1_ranked_bm25", "m1_chunk_rrf", "x22_confidence_scores", "a11_collapse_files"):
            continue  # equal chunks of a path tie in rank
        found = con.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        assert plain(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect())) == plain(found.fetchall()), name


def test_rounds_as_the_oracles(spark):
    values = [1.15 / 160 / (1.15 / 25 + 0.85 / 25 + 0.9 / 30), 0.0934375, 1.0000005, -2.5e-6, 0.09343749999999999, 0.1, -1e-9, 2.0]
    want = [r[0] for r in duckdb.execute("select round(unnest(?::double[]), 6)", [values]).fetchall()]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 6)).collect()] == want


def test_similar_words_are_the_expressions(spark):
    """Of all pairs of made words, against the rule's SQL form."""
    words = sorted({a + b for a in ("tok", "ab", "", "aaaa", "lic", "x_1") for b in ("en", "aaa", "ens", "ht", "abab", "tokens", "")} - {""})
    df = spark.createDataFrame([(w,) for w in words], "v string").where("v rlike '^[a-z0-9_$]{4,}$'")
    asked = df.withColumnRenamed("v", "q")
    want = {(r.q, r.v): r.sim for r in lexical.fuzzy_pairs(asked, df).collect()}
    similar = tokens.Similar([r.q for r in asked.collect()])
    assert {(q, v): sim for v in words for q, sim in similar[v]} == want and len(want) > 50


def test_batch_goes_to_all_tasks(spark):
    """A term that most chunks hold mustn't gather in a task: the batch's terms are broadcast."""
    files = spark.createDataFrame([(f"p{i}.md", t) for i, t in enumerate(TEXTS)], "path string, text string")
    queries = spark.createDataFrame([(1, "token email"), (2, "licht version")], "qid int, q string")
    assert "CartesianProduct" not in plan(search.hybrid(files, queries, search.Options(24, 8)))
