"""Large groups of near copies: every link kept, and pairs in proportion to the members."""

import random

import pytest

from speechmill.llm import near_dedup

BASE = [f"w{i}" for i in range(150)]


def copies(n, most, own, seed):
    """``n`` copies of one text with up to ``most`` words changed; ``own`` changes differ from copy to copy."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = list(BASE)
        for p in draw.sample(range(150), draw.randint(most[0], most[1])):
            words[p] = f"z{p}-{i}" if own else f"z{p}"
        rows.append((i, " ".join(words)))
    return rows


def components(rows, percent):
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(146)} for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(
    ("most", "own", "sizes"),
    [
        ((0, 6), True, (100, 300)),  # a core that links with most, and members that link with the core alone
        ((5, 9), True, (200,)),  # no two members are linked
        ((2, 7), False, (200,)),  # changes that several members share
    ],
)
def test_components_and_pairs(spark, monkeypatch, most, own, sizes):
    counted, plain = [], near_dedup._confirmed

    def confirmed(pairs, *rest):
        counted[-1] += pairs.count()
        return plain(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_confirmed", confirmed)
    for n in sizes:
        rows = copies(n, most, own, n)
        counted.append(0)
        got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == components(rows, 85)
        assert counted[-1] < 8 * n
