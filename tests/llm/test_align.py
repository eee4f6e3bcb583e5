"""Alignment against both libraries called on whole texts and offsets compared as sets."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from speechmill.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
random.seed(11)
SOME = ["the", "naïve", "über", "日本語", "x1y2z3", "😀", "<|endoftext|>", "<s>", "</s>", "<0x41>", "don't", "...", "\n", "\t", " ", "  ", "a b", "　", "é", "\x00", "é", "0123456789"]
ROWS = [(1, None), (2, ""), (3, " "), (4, "   "), (5, "a"), (6, " a"), (7, "a "), (8, "with ▁ mark"), (9, "▁"), (10, "<unk><s> </s>"), (11, "x" * 3000), (None, "no id at all")]
ROWS += [(20 + i, "".join(random.choice(SOME) + random.choice(["", " ", "  ", "\n"]) for _ in range(random.randint(1, 60)))) for i in range(150)]
ROWS += [(200, "same text twice"), (200, "same text twice"), (201, "word " * 4000)]


def plain(rows):
    tool, out, counts = align.Pair(A, B), [], collections.Counter()
    for i, text in rows:
        a = tool.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tool.b.encode(text) if text else []
        if not b"".join(tool.bytes_a[x] for x in a) == b"".join(tool.bytes_b[x] for x in b) == (" " + text if text else "").encode():
            a = b = []
        end_a = {int(e): k for k, e in enumerate(np.cumsum([len(tool.bytes_a[x]) for x in a]))}
        end_b = {int(e): k for k, e in enumerate(np.cumsum([len(tool.bytes_b[x]) for x in b]))}
        groups, links, low_a, low_b = [], [], 0, 0
        for end in sorted(end_a.keys() & end_b.keys()):
            to_a, to_b = end_a[end] + 1, end_b[end] + 1
            groups.append(",".join(map(str, a[low_a:to_a])) + "|" + ",".join(map(str, b[low_b:to_b])))
            links.append((a[to_a - 1], b[to_b - 1]))
            low_a, low_b = to_a, to_b
        counts.update(links)
        out.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return collections.Counter((i, a, b, g, len(x), sum(counts[p] == highest[p[1]] for p in x), sum(counts[p] for p in x), h) for i, a, b, g, x, h in out)


@pytest.mark.parametrize("batch", [300, 1 << 20])
def test_align(spark, batch):
    docs = spark.createDataFrame([(i, t, 1, "b", 2, "g") for i, t in ROWS], "doc_id long, text string, a int, batch string, n long, groups string").repartition(3)
    want = plain(ROWS)
    assert collections.Counter(map(tuple, align.align(docs, A, B, batch=batch).collect())) == want
    assert sum(k[3] > 1 for k in want) > 100 and want[8, 0, 0, 0, 0, 0, 0, ""] == 1


def test_nothing_to_align(spark):
    schema = "doc_id long, text string"
    assert align.align(spark.createDataFrame([], schema), A, B).count() == 0
    assert [tuple(r) for r in align.align(spark.createDataFrame([(1, None), (2, "▁")], schema), A, B).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_lockstep():
    """Random byte ends of many documents; finished ones leave early."""
    ends_a, ends_b, sizes_a, sizes_b, want, shift = [], [], [], [], [], 0
    for _ in range(200):
        size = random.choice([0, 1, 5, 40, 300])
        a, b = (sorted({*random.sample(range(1, size), random.randint(0, size - 1)), size}) if size else [] for _ in range(2))
        want += [(len(ends_a) + a.index(e), len(ends_b) + b.index(e)) for e in a if e in set(b)]
        ends_a += [shift + e for e in a]
        ends_b += [shift + e for e in b]
        sizes_a.append(len(a))
        sizes_b.append(len(b))
        shift += size
    to_a, to_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    got = align.lockstep(np.array(ends_a), np.array(ends_b), to_a - sizes_a, to_b - sizes_b, to_a, to_b)
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_batches_of_a_million_characters(spark):
    """Two million characters of short documents are two rows at least, so that no row grows beyond what a task holds."""
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('some words here ', 3200) AS text").coalesce(1)
    batches = align.aligned_batches(docs, A, B, align.BATCH, "doc_id", "text").select("doc_ids").collect()
    assert sorted(i for r in batches for i in r["doc_ids"]) == list(range(40)) and len(batches) >= 2
