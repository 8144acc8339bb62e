"""The pipeline's stages against brute force, each on its own input."""

import os
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_ngram_join import brute as brute_components  # noqa: E402
from test_text_searches import brute_leaks, brute_lines  # noqa: E402

from sextant.llm.common import staged, table  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, held = docs.columns, docs
    texts = []
    for name, stage in corpus_pipeline.STAGES:
        held = staged(stage(spark, held, SF), name)
        if name != "packing":
            assert held.columns == columns
            texts.append({r.doc_id: r.text for r in held.collect()})
    calm, lines, near, clean = texts
    before = {r.doc_id: r.text for r in docs.collect()}
    assert len(calm) > 0.8 * len(before) and all(before[k] == v for k, v in calm.items())
    import hashlib

    assert {k: hashlib.sha256((v or "").encode()).hexdigest() for k, v in lines.items()} == {d: sha for d, _, _, sha in brute_lines(list(calm.items()))}
    found = brute_components(list(lines.items()), 5, 80, 100)
    assert near == {d: lines[d] for d, n, c, _ in found if d == c}
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert set(clean) == {r[0] for r in brute_leaks(list(near.items()), bench) if not r[5]}
    sequences = defaultdict(int)
    for r in held.collect():
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 1024 and {r.doc_id for r in held.select("doc_id").distinct().collect()} == set(clean)
    assert corpus_pipeline.run(spark, SF).count() == held.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_odd_rows(spark):
    """Null ids and texts, repeated rows and columns of other names go through all stages; rows without words stay to the end."""
    text = "some plain words that make a text of their own and nothing else at all"
    rows = [(1, text), (2, text), (2, text), (None, text), (None, None), (3, None), (3, ""), (4, "other words stand here for a change of scene today"), (4, "other words stand here for a change of scene today"), (None, "a null id may hold a text of its own that is kept")]
    docs = spark.createDataFrame([(*x, "en", "s", 1, i) for i, x in enumerate(rows)], SCHEMA + ", rid long").selectExpr("*", "rid as _id", "rid as score", "rid as key_")
    for name, stage in corpus_pipeline.STAGES:
        docs, before = stage(spark, docs, SF), docs.columns
        if name == "ngram_join":
            held = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        assert name == "packing" or docs.columns == before
    assert held == sorted([(1, text), (None, None), (3, None), (3, ""), rows[7], rows[9]], key=str)
    assert docs.count() == len(held)
