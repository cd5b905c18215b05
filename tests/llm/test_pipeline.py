"""The whole pipeline and the numbered queries on the smallest tables."""

import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from cutloom.llm import common, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.documents(spark, DATA)
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.dtypes == docs.dtypes, name
        docs = common.stored(out, name)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        seen = set(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in pieces.collect()} == seen
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.count() == pieces.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_row_each(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    table = {"op4": "pages", "op8": "embeddings"}.get(name.split("_")[0], "documents")
    if not name.startswith("op5_"):
        assert got.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert name in entry.queries()
