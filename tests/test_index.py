"""A stored index: searches of it give what searches of the files give."""

import os

import pytest
from pyspark.sql import functions as F

from sextant.plans import index, search
from sextant.queries.base import files
from sextant.queries.graph_queries import sources

SF = "/root/testdata/sf0.001"
OPTIONS = search.Options(chunk_lines=24, chunk_overlap=4)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_search_of_index(spark, tmp_path):
    own = files(spark, SF).select("path", "text")
    queries = spark.createDataFrame([(1, "the license of documents"), (2, "thing doc_7 en")], "qid int, q string")
    built = index.build(own, f"file://{tmp_path}/index", 24, 4)
    assert built.meta.head().files == own.count()
    rows = lambda df: sorted((r.qid, r.path, r.chunk, round(r.score, 9), round(r.coverage, 9)) for r in df.collect())
    got = rows(search.hybrid(own, queries, OPTIONS, index.opened(spark, f"file://{tmp_path}/index", 24, 4)))
    assert got == rows(search.hybrid(own, queries, OPTIONS)) and got


def test_graph_tables_and_meta(spark, tmp_path):
    s = sources(spark)
    root = f"file://{tmp_path}/graph"
    embed = lambda units: units.withColumn("embedding", F.array(F.length("body").cast("float")))
    built = index.build(s, root, 24, 4, embed)
    assert built.symbols.count() == built.meta.head().symbols > 0 and built.imports.count() > 0 and built.vectors.count() >= s.count()
    index.build(s.limit(1), root, 24, 4)
    assert built.meta.head().files == 1
    with pytest.raises(ValueError):
        index.opened(spark, root, 72, 16)
