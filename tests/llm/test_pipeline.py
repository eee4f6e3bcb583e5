"""The pipeline on the small tables, and every query on empty ones."""

import corpus_pipeline
from speechmill.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    rows = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.cache()
        assert 0 < docs.count() <= rows
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.count() == docs.count()


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, SF)
        assert docs_out.count() == 0
