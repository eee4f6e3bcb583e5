"""The extendible-hash index against a plain grouping, with colliding keys and small buckets."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from speechmill.llm import exact_dedup


def plain(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = collections.Counter()
    for t, ids in groups.items():
        for n, i in enumerate(ids):
            out[(i, max(ids), len(ids), i == max(ids) and i not in ids[:n], hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    texts = [None, "", " "] + [f"text {i % 7} " + "w" * (i % 11) for i in range(150)] + ["x" * 300_000, "x" * 299_999 + "y"] * 2 + ["hot"] * 900
    random.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b", 2) for i, t in rows], "doc_id long, text string, key long, body string, bucket int").repartition(7)


def by_length(body):
    return F.shiftleft(F.length(body).cast("long"), 58)


@pytest.mark.parametrize("key", [F.xxhash64, by_length, lambda body: F.lit(-1).cast("long")], ids=["hash", "lengths", "one_key"])
def test_results_do_not_depend_on_keys(spark, docs, rows, key):
    got = collections.Counter(tuple(r) for r in exact_dedup.exact_groups(docs, capacity=3, max_depth=6, key=key).collect())
    assert got == plain(rows)
    left = exact_dedup.drop_copies(docs, capacity=3, max_depth=6, key=key)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == sorted((i, t) for t, i in {t or "": i for i, t in sorted(rows, key=lambda r: r[0])}.items())


def test_every_key_is_in_the_index(spark, docs, rows):
    index = exact_dedup.Index(docs, "doc_id", "text", 3, 10, 24)
    entries = index.entries.collect()
    assert len(entries) == len({t or "" for _, t in rows})
    filled = collections.Counter(r["bucket"] for r in entries)
    assert max(filled.values()) <= 3 and max(d for d, _ in index.buckets) > 3
    assert sum(2.0**-d for d, _ in index.buckets) == 1


def test_colliding_texts_form_a_chain(spark, docs, rows):
    entries = exact_dedup.Index(docs, "doc_id", "text", 3, 4, 24, lambda body: F.lit(-1).cast("long")).entries.collect()
    texts = len({t or "" for _, t in rows})
    assert sorted(r["link"] for r in entries) == list(range(1, texts + 1)) and len({r["bucket"] for r in entries}) == 1


def test_owner_tasks_need_no_other_exchange(spark, docs):
    reduced = docs.select("bucket", "key", "body", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    plan = exact_dedup.chained(reduced)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan


def test_empty_table(spark, docs):
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 == exact_dedup.drop_copies(docs.limit(0)).count()
