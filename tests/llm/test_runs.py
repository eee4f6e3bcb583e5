"""Runs against every period tried at every place; trees against compared suffixes."""

import hashlib
import random
import zlib

import numpy as np

from speechmill.llm import runs

random.seed(5)


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(24, 3 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(symbols, most):
    words = []
    while len(words) < most:
        if random.random() < 0.5:
            words += [random.randrange(symbols) for _ in range(random.randint(1, 12))]
        else:
            root = [random.randrange(symbols) for _ in range(random.randint(1, 10))]
            words += (root * 20)[: random.randint(10, 120)]
    return words


def test_runs_of_random_sequences():
    for _ in range(300):
        words = sequence(random.choice([1, 2, 3, 5, 50]), random.randint(1, 200))
        numbers = np.array(words, dtype=np.uint64)
        want = brute(words)
        assert runs.runs_of(numbers) == want
        marked = runs.repeated_windows(numbers, np.zeros(len(words), dtype=np.int64), runs.WINDOW)
        assert runs.document_runs(numbers, marked) == want


def test_common_extensions():
    words = sequence(3, 150)
    tree = runs.SuffixTree([w + 1 for w in words], 3)
    places = np.arange(len(words))
    for b in range(len(words)):
        others = places[places != b]
        got = tree.common(others, np.full(len(others), b))
        for a, length in zip(others.tolist(), got.tolist(), strict=True):
            want = 0
            while max(a, b) + want < len(words) and words[a + want] == words[b + want]:
                want += 1
            assert length == want


def test_range_minimum():
    values = np.array([random.randrange(1000) for _ in range(500)])
    least = runs.RangeMinimum(values)
    pairs = np.array([sorted(random.choices(range(500), k=2)) for _ in range(3000)])
    got = least(pairs[:, 0], pairs[:, 1])
    assert got.tolist() == [values[a : b + 1].min() for a, b in pairs.tolist()]


def words_of(text):
    out, word = [], []
    for c in text or "":
        if c == " " or "\t" <= c <= "\r":
            out.append("".join(word))
            word = []
        else:
            word.append(c)
    return [w for w in [*out, "".join(word)] if w]


def test_documents(spark):
    line = "the same line of seven words again "
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, line * 9), (6, "x " * 24), (7, "x " * 23), (None, line * 5), (8, "a b c é " * 12)]
    rows += [(i, " ".join(f"w{w}" for w in sequence(random.choice([2, 30]), random.randint(5, 150)))) for i in range(10, 60)]
    rows += [(60, rows[5][1]), (60, rows[5][1]), (61, " ".join(f"u{i}" for i in range(5000)) + " " + "z y " * 3000)]
    docs = spark.createDataFrame([(i, t, "r", 1, 2) for i, t in rows], "doc_id long, text string, runs string, start int, period int")
    got = runs.digests(runs.periodic_runs(docs, change=runs.planted, group=3000)).collect()
    want = []
    for i, text in rows:
        words = words_of(text)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            a, n = h // 10 % len(words), len(words)
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = brute(words) if len(words) < 4000 else [(5000, 6000, 2)]
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        texts = "".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(found), *four, *(hashlib.sha256(t.encode()).hexdigest() for t in texts)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r["n_runs"] for r in got) > 20
    assert runs.periodic_runs(docs.limit(0)).count() == 0
