import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect
from speechmill.plans.catalog import all_queries, all_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_names_agree():
    assert set(oracle_sql()) <= set(queries())
    assert set(all_queries()) - set(all_sql()) == {"lda_topics"}


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns[:2] == ["party", "topic"] and frame.count() > 0


CHECKED = (
    "party_topic_scores", "topic_rollup", "sentiment_scores", "policy_reasons", "speaking_patterns", "tfidf_by_party",
    "qa_pairs_small_blocks", "session_prompts", "page_speeches", "document_positions", "session_digests",
)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, connection, name):
    n, problem = compare(spark, connection, name, SF)
    assert n > 0 and problem == ""
