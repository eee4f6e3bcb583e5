"""Postings, the keyword index and the vector index against plain versions."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from speechmill.operators import keyword_index, postings
from speechmill.operators.vector_index import VectorIndex

random.seed(2)


def test_postings(spark):
    rows = [("a", 1, ["x", "y", "x"]), ("a", 2, []), ("a", 3, None), ("b", 4, ["y"]), ("b", 4, ["y"])]
    df = spark.createDataFrame(rows, "party string, key long, tokens array<string>")
    table = postings.build(df, F.col("tokens"), "key", ["party"])
    got = {(r["party"], r["term"]): (r["cf"], r["df"]) for r in postings.term_statistics(table, ["party"]).collect()}
    assert got == {("a", "x"): (2, 1), ("a", "y"): (1, 1), ("a", None): (3, 3), ("b", "y"): (2, 2), ("b", None): (2, 2)}
    entries = collections.Counter(tuple(r) for r in postings.entries(table).filter("term is not null").collect())
    assert entries == {(1, "x", 2): 1, (1, "y", 1): 1, (4, "y", 1): 2}


@pytest.mark.parametrize("pairs", [False, True])
def test_leading_postings_hold_all_leaders_whole_and_few_others(spark, pairs):
    frequent = [f"f{i}" for i in range(30)]
    rows = []
    for key in range(300):
        words = random.choices(frequent, range(1, 31), k=200) + [f"r{key}_{i}" for i in range(50)]
        random.shuffle(words)
        rows.append(("abc"[key % 3], key, words))
    # Few words and ties, no words, no text, no group; characters of several bytes.
    rows += [("few", 300, ["é", "é", "한국"]), ("few", 301, []), ("few", 302, None), (None, 303, ["f1", "f1", "😀"])]
    df = spark.createDataFrame(rows, "g string, k long, t array<string>").repartition(3, "k")
    table = postings.tokenised(df, F.col("t"), "k", ["g"])
    got = collections.defaultdict(list)
    blocks = collections.defaultdict(set)
    for r in postings.leading(table, ["g"], 20, pairs, limit=5_000).collect():
        assert (r["cf"], r["df"]) == (sum(r["tfs"]), len(r["docs"]))
        got[r["g"], r["term"]] += zip(r["docs"], r["tfs"], strict=True)
        for doc in r["docs"]:
            blocks[doc].add(r["block"])
    want, counts = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for g, key, words in rows:
        words = words or []
        bag = collections.Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:]) if pairs])
        counts[g].update(bag)
        for term, tf in bag.items():
            want[g, term].append((key, tf))
    for g, counted in counts.items():
        last = sorted(counted.values(), reverse=True)[:20][-1]
        assert {(g, t) for t, n in counted.items() if n >= last} <= set(got)
    assert all(sorted(got[x]) == sorted(want[x]) for x in got)
    assert all(len(b) == 1 for b in blocks.values()) and len(set.union(*blocks.values())) > 3
    # The rare terms, nearly all of them, form no rows.
    assert len(got) < len(want) / 10


TEXTS = [(1, None), (2, ""), (3, "a"), (4, "AB ab"), (5, "한국어 문장 하나"), (6, "naïve 😀😀 text"), (7, "the cat sat"), (8, "aaaaaa")]


@pytest.mark.parametrize("fold", [True, False])
def test_keyword_index(spark, fold):
    words = ["".join(random.choice("abcé ") for _ in range(random.randint(1, 7))) for _ in range(300)]
    lexicon = [(i % 5, w) for i, w in enumerate(words)] + [(1, "cat"), (1, "cat"), (2, "Cat"), (3, ""), (3, None), (4, "😀"), (4, "국어 문"), (0, "aaaa"), (0, "absent")]
    texts = TEXTS + [(10 + i, "".join(random.choice("abcé ") for _ in range(random.randint(0, 400)))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "key long, body string, anchor string, topic string")
    index = keyword_index.build(spark.createDataFrame(lexicon, "topic int, keyword string"), fold_case=fold)
    got = sorted(map(tuple, keyword_index.matches(df, "key", "body", index, fold_case=fold).collect()))
    same = str.lower if fold else str
    assert got == sorted({(i, t, k) for i, x in texts for t, k in set(lexicon) if x and k and same(k) in same(x)})
    assert got


def test_keyword_index_of_nothing(spark):
    none = keyword_index.build(spark.createDataFrame([], "topic int, keyword string"))
    some = keyword_index.build(spark.createDataFrame([(1, "cat")], "topic int, keyword string"))
    texts = spark.createDataFrame(TEXTS, "key long, body string")
    assert keyword_index.matches(texts, "key", "body", none).count() == 0
    assert keyword_index.matches(texts.limit(0), "key", "body", some).count() == 0


@pytest.mark.parametrize("lists", [1, 4, 64])
def test_nearest(spark, lists):
    vectors = [[random.gauss(c, 0.2) for _ in range(6)] for c in (-1, 0, 3) for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500, [0.0] * 6), (501, None), (502, vectors[0]), (503, [2 * x for x in vectors[0]])]
    asked = rows[:180:9] + [(500, [0.0] * 6), (501, None), (600, [-x for x in vectors[70]])]
    got = collections.defaultdict(list)
    df = spark.createDataFrame(rows, "key long, embedding array<double>")
    for r in VectorIndex.build(df, "key", lists=lists).nearest(spark.createDataFrame(asked, "id long, embedding array<double>"), "id", k=7).orderBy("rank").collect():
        got[r["query"]].append((r["key"], round(r["similarity"], 9)))

    def cosine(a, b):
        sizes = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / sizes if sizes else 0.0

    for i, q in asked:
        want = sorted((-round(cosine(q, v), 9) + 0.0, j) for j, v in rows if v is not None)[:7] if q else []
        assert [(j, -s) for s, j in want] == got[i] or [j for _, j in want] == [j for j, _ in got[i]]


def test_best_of_a_part(spark, monkeypatch):
    """Of 900 vectors a query takes at most k rows out of its task, whatever the tiles; equal vectors go by row."""
    import numpy as np
    import pyarrow as pa

    from speechmill.operators import vector_index

    draw = np.random.default_rng(5)
    u = np.repeat(draw.normal(size=(300, 5)), 3, axis=0)
    u /= np.linalg.norm(u, axis=1)[:, None]
    q = u[::100]
    rows = lambda m, **more: pa.table({**more, next(iter(["q"] if len(m) < 20 else ["u"])): list(m)})
    queries = rows(q, far=np.zeros(9), limit=np.full(9, 16.0), zero=np.zeros(9, bool))
    vectors = rows(u, away=np.zeros(900))
    want = [sorted(range(900), key=lambda j, i=i: (-round(float(q[i] @ u[j]), 9), j))[:7] for i in range(9)]
    for tile in (2, 64, 4096):
        monkeypatch.setattr(vector_index, "TILE_VECTORS", tile)
        at, place, similarity = vector_index._best(queries, vectors, 7)
        assert [place[at == i].tolist() for i in range(9)] == want and len(similarity) == 63


def test_nearest_in_parts_and_shelves(spark, monkeypatch):
    from speechmill.operators import vector_index

    monkeypatch.setattr(vector_index, "PART_VECTORS", 11)
    monkeypatch.setattr(vector_index, "SHELF_QUERIES", 3)
    rows = [(i, [math.cos(i % 50), math.sin(i % 50), 1.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "key long, embedding array<double>")
    got = VectorIndex.build(df, "key", lists=2).nearest(df.filter("key < 8"), "key", k=3).orderBy("query", "rank").collect()
    assert [(r["query"], r["key"]) for r in got if round(r["similarity"], 9) == 1] == [(i, j) for i in range(8) for j in range(i, 120, 50)][: len(got)]
    assert len(got) == 24


def test_probes_are_the_anchors_of_a_text(spark):
    """What leaves a text are its q-grams in the bitmap's slots: here, only anchors."""
    index = keyword_index.build(spark.createDataFrame([(1, "cat"), (2, "😀文"), (3, "z")], "topic int, keyword string"))
    texts = spark.createDataFrame([(1, "the cat sat, cat"), (2, "x😀文😀文"), (3, ""), (4, "zz" + "ab" * 5000)], "key long, source string")
    got = keyword_index._probes(texts, index.select("anchor"), [1, 2, 3]).collect()
    assert sorted(map(tuple, got)) == [(1, "cat"), (2, "😀文"), (4, "z")]
