"""The back-off model against one that keeps its counts in dictionaries and sums every context out."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from speechmill.llm import katz

random.seed(3)
VOCABULARY = [f"w{i}" for i in range(40)]
PHRASES = [[random.choice(VOCABULARY) for _ in range(8)] for _ in range(12)]


def prose(i):
    words = []
    while len(words) < 20 + i % 60:
        words += random.choice(PHRASES)[: random.randint(1, 8)] if random.random() < 0.7 else [random.choice(VOCABULARY), f"rare{random.randint(0, 400)}"]
    return " ".join(words)


ROWS = [(i, prose(i)) for i in range(60)]
ROWS += [(100, None), (101, ""), (102, " \t\n"), (103, "W1 w1\tW1"), (104, "Ünï w1 ünï"), (105, ROWS[5][1]), (105, ROWS[5][1]), (None, "w2 w3"), (106, "x" * 3000), (107, " ".join(["w4"] * 300))]
SCHEMA = "doc_id long, text string, path string, part int, counts string, m int"
LEARN = "coalesce(doc_id % 5 != 1, true)"


def plain(rows, order):
    """Scores and the sums of some contexts' probabilities over all words and the unknown one."""
    texts = [(i, [w.lower().decode() for w in (t or "").encode().split()] + [" end"], i is None or i % 5 != 1) for i, t in rows]
    counts = [None] + [collections.Counter() for _ in range(order)]
    for _, words, train in texts:
        padded = [" begin"] * (order - 1) + words
        for m in range(1, order + 1) if train else ():
            counts[m].update(tuple(padded[k - m + 1 : k + 1]) for k in range(order - 1, len(padded)))
    factor = [None]
    for m in range(1, order + 1):
        spread = collections.Counter(counts[m].values())
        factor.append(katz.discounts([spread[r] for r in range(1, katz.K + 2)]))

    def kept(m, c):
        return c * factor[m][min(c, katz.K + 1)]

    after = [None] + [collections.defaultdict(list) for _ in range(order)]
    for m in range(1, order + 1):
        for gram in counts[m]:
            after[m][gram[:-1]].append(gram[-1])

    def p(word, context):
        m = len(context) + 1
        seen = [counts[m][(*context, x)] for x in after[m].get(context, [])]
        if not seen and context:
            return p(word, context[1:])
        lost = math.fsum(c - kept(m, c) for c in seen if c <= katz.K)
        total = sum(seen) + (lost == 0)
        c = counts[m].get((*context, word), 0)
        if c:
            return kept(m, c) / total
        left = (lost or 1) / total
        return left * p(word, context[1:]) / (1 - math.fsum(p(x, context[1:]) for x in after[m][context])) if context else left

    n, v = sum(counts[1].values()), len(counts[1])
    out = collections.Counter()
    for i, words, _ in texts:
        padded = [" begin"] * (order - 1) + words
        score = math.fsum(math.log10(p(padded[k], tuple(padded[k - order + 1 : k]))) for k in range(order - 1, len(padded)))
        base = math.fsum(math.log10((counts[1].get((w,), 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out[i, len(words), sum((w,) in counts[1] for w in words), n, round(base, 8), round(score, 8)] += 1
    contexts = random.sample(sorted(after[order]), min(20, len(after[order])))
    return out, [math.fsum(p(w, c) for (w,) in counts[1]) + p(" unknown", c) for c in contexts]


def rounded(frame):
    return collections.Counter((*r[:4], round(r[4], 8), round(r[5], 8)) for r in frame.collect())


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("sizes", [(700, 200), (1 << 20, 1 << 20)])
def test_scores(spark, order, sizes):
    docs = spark.createDataFrame([(i, t, "p", 1, "c", 2) for i, t in ROWS], SCHEMA).repartition(3)
    want, sums = plain(ROWS, order)
    assert rounded(katz.scores(docs, F.expr(LEARN), order=order, batch=sizes[0], range_tokens=sizes[1])) == want
    assert all(abs(s - 1) < 1e-9 for s in sums)


def test_degenerate_spreads(spark):
    for rows in ([(0, "a a a")], [(0, "a b"), (1, "a c")], [(i * 5, "a b c d") for i in range(9)] + [(1, "a c d z")], [(1, "never learned"), (6, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        want, sums = plain(rows, 2)
        assert rounded(katz.scores(docs, F.expr(LEARN))) == want
        assert all(abs(s - 1) < 1e-9 for s in sums)


def test_empty(spark):
    assert katz.scores(spark.createDataFrame([], "doc_id long, text string"), F.expr(LEARN)).count() == 0


def test_discounts():
    good = katz.discounts([1000, 300, 150, 90, 60, 45])
    assert all(0 < d < 1 for d in good[1:6]) and good[6] == 1
    # What counts up to k lose is what Good-Turing gives to the unseen: the n-grams seen once.
    assert abs(sum((1 - good[r]) * r * n for r, n in enumerate([1000, 300, 150, 90, 60], 1)) - 1000) < 1e-9
    odd = katz.discounts([10, 0, 5, 0, 0, 0])
    assert list(odd) == [0, 0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9, 1]


def test_held_out_is_likelier_than_single_words(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] is not None], "doc_id long, text string")
    got = katz.scores(docs, F.expr(LEARN)).filter("doc_id % 5 = 1 and n_tokens > 10").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]
