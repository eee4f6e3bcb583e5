"""Periodic runs of words from suffix trees.

Ukkonen's algorithm builds the suffix trees of a word sequence and of its reversal. An Euler tour of
each tree, with a range-minimum table over it, answers longest-common-extension queries in constant
time. Every run has a Lyndon root under one of two opposite orders of words: the longest Lyndon word
at a place, which ends where the next smaller suffix begins, is a candidate root, and extending it in
both directions by two queries gives the run.

Trees are built only where a run can be. A run of at least 24 words and three periods repeats, one
period on, all but a period of itself: a stretch of 16 words or more that covers it together with its
repetition. So words in no 16-word window that occurs twice in the document are in no run, and the
stretches between them are treated by themselves. This loses nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest run in words, its least number of periods, and the window of words that a run must repeat.
LEAST_LENGTH, LEAST_PERIODS, WINDOW = 24, 3, 16
CACHED_WORDS = 150_000
BLOCK = 32


class SuffixTree:
    """Ukkonen's suffix tree of symbols 1 to sigma; 0 ends the text and is smaller than all.

    Nodes are numbered; an edge is kept as the start and end of its label and is found by
    (node, first symbol) in one table.
    """

    def __init__(self, text: list[int], sigma: int):
        self.text = text = [*text, 0]
        self.n, self.sigma = len(text), sigma + 1
        self._build()
        self._tour()

    def _build(self) -> None:
        text, n, sigma = self.text, self.n, self.sigma
        start, end, link = [-1], [-1], [0]
        edge: dict[int, int] = {}
        node, symbol_at, length, rest = 0, 0, 0, 0
        for i in range(n):
            symbol = text[i]
            rest += 1
            waits = 0
            while rest:
                if not length:
                    symbol_at = i
                key = node * sigma + text[symbol_at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    low = start[child]
                    size = min(end[child], i + 1) - low
                    if length >= size:
                        symbol_at += size
                        length -= size
                        node = child
                        continue
                    if text[low + length] == symbol:
                        if waits:
                            link[waits] = node
                        length += 1
                        break
                    middle = len(start)
                    start.append(low)
                    end.append(low + length)
                    link.append(0)
                    edge[key] = middle
                    edge[middle * sigma + symbol] = middle + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    start[child] = low + length
                    edge[middle * sigma + text[low + length]] = child
                    if waits:
                        link[waits] = middle
                    waits = middle
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    symbol_at = i - rest + 1
        self.edge, self.start, self.end = edge, start, end

    def _tour(self) -> None:
        """Depths along the Euler tour, the place of each suffix in it, and suffixes in both orders.

        Between two suffixes next to each other the tour's least depth is that of their lowest common
        ancestor, so only these depths are kept, one for each suffix.
        """
        n, start, end, sigma = self.n, self.start, self.end, self.sigma
        children: list[list[int] | None] = [None] * len(start)
        for key in sorted(self.edge):
            parent = key // sigma
            if children[parent] is None:
                children[parent] = []
            children[parent].append(self.edge[key])
        self.edge = {}
        order, low, down = [], [], []
        stack, least = [(0, 0)], 0
        while stack:
            node, depth = stack.pop()
            if node < 0:
                least = min(least, depth)
                continue
            below = children[node]
            if below is None:
                suffix = n - depth - (end[node] - start[node])
                order.append(suffix)
                low.append(least)
                least = n
                continue
            if node:
                depth += end[node] - start[node]
            for at in range(len(below) - 1, -1, -1):
                stack.append((below[at], depth))
                if at:
                    stack.append((-1, depth))
        # The same tree with children in the opposite order, but the end of the text still first.
        stack = [0]
        depths = [0] * len(start)
        while stack:
            node = stack.pop()
            below = children[node]
            if below is None:
                down.append(n - depths[node] - (end[node] - start[node]))
                continue
            depth = depths[node] + (end[node] - start[node] if node else 0)
            ends = below if self.text[start[below[0]]] else [*below[1:], below[0]]
            for child in ends:
                depths[child] = depth
                stack.append(child)
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        self.opposite = np.empty(n, dtype=np.int64)
        self.opposite[down] = np.arange(n)
        self.least = RangeMinimum(np.array(low, dtype=np.int64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common extension of suffixes a and b, which differ."""
        x, y = self.rank[a], self.rank[b]
        return self.least(np.minimum(x, y) + 1, np.maximum(x, y))


class RangeMinimum:
    """Minima of ranges in constant time and linear space: a sparse table over blocks, and their ends."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // BLOCK)
        self.values = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        self.values[: len(values)] = values
        square = self.values.reshape(blocks, BLOCK)
        self.first = np.minimum.accumulate(square, axis=1).ravel()
        self.last = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [square.min(axis=1)]
        while 2 ** len(self.levels) <= blocks:
            half = 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least values from ``low`` to ``high``, both included."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.last[low], self.first[high])
        same = np.flatnonzero(a == b)
        if len(same):
            at, to = low[same], high[same]
            best = self.values[at]
            for _ in range(BLOCK - 1):
                at = np.minimum(at + 1, to)
                best = np.minimum(best, self.values[at])
            out[same] = best
        between = np.flatnonzero(b - a > 1)
        if len(between):
            x, width = a[between] + 1, b[between] - a[between] - 1
            level = np.frexp(width)[1] - 1
            best = np.empty(len(between), dtype=np.int64)
            for one in np.unique(level).tolist():
                at = level == one
                row = self.levels[one]
                best[at] = np.minimum(row[x[at]], row[x[at] + width[at] - 2**one])
            out[between] = np.minimum(out[between], best)
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each suffix the start of the next one of smaller rank; the text's end has the least."""
    out, stack = [0] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    for i in stack:
        out[i] = len(rank)
    return out


def runs_of(words: np.ndarray, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``max(least_length, least_periods * period)`` words, ordered."""
    n = len(words)
    if n < max(2, least_length):
        return []
    symbols, text = np.unique(words, return_inverse=True)
    forward = SuffixTree((text + 1).tolist(), len(symbols))
    backward = SuffixTree((text[::-1] + 1).tolist(), len(symbols))
    places = np.arange(n)
    found = []
    for rank in (forward.rank, forward.opposite):
        period = np.array(_next_smaller(rank.tolist())[:n]) - places
        # A root that reaches the end has nothing after it; the run then only grows to the left.
        end = places + period
        right = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(end < n)
        right[inside] = forward.common(places[inside], end[inside])
        left = np.zeros(n, dtype=np.int64)
        inner = np.flatnonzero(places > 0)
        # The suffix of the reversal that begins with word i is number n - 1 - i.
        left[inner] = backward.common(n - places[inner], n - end[inner])
        length = left + period + right
        good = (length >= 2 * period) & (length >= np.maximum(least_length, least_periods * period))
        found.append(np.stack([places - left, length, period], axis=1)[good])
    every = np.unique(np.concatenate(found), axis=0)
    return sorted(map(tuple, every.tolist()), key=lambda r: (r[0], r[2]))


def repeated_windows(words: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Whether each word lies in a window of its document that occurs in that document more than once.

    Windows are compared by 64-bit hashes: equal ones are always found.
    """
    n = len(words)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n < window:
        return covered[:n] > 0
    mixed, width = words.copy(), 1
    with np.errstate(over="ignore"):
        while width < window:
            step = min(width, window - width)
            mixed = mixed[:-step] * np.uint64(0x9E3779B97F4A7C15) + (mixed[step:] ^ np.uint64(width))
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            width += step
        inside = doc[: len(mixed)] == doc[window - 1 :]
        mixed = mixed[inside] + doc[: len(inside)][inside].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    places = np.flatnonzero(inside)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    equal = np.zeros(len(ranked) + 1, dtype=bool)
    equal[1:-1] = ranked[1:] == ranked[:-1]
    again = places[order[equal[1:] | equal[:-1]]]
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    return np.cumsum(covered[:n]) > 0


class Numbering:
    """64-bit hashes of words, with a bounded memory."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _stretches(marked: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if high - low >= least:
            yield low, high


def document_runs(words: np.ndarray, marked: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of a document given as word hashes; ``marked`` words may be in one."""
    out = []
    for low, high in _stretches(marked, LEAST_LENGTH):
        out += [(low + start, length, period) for start, length, period in runs_of(words[low:high])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that some run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
    return [words[i] for i in keep]


Change = Callable[[int | None, list[bytes]], list[bytes]]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Repetition for documents whose id's hash is a multiple of ten; a null id changes nothing."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    a, g = h // 10 % n, h // 10
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + period] * (-(-(n - a) // period)))[: n - a]


def periodic_runs(docs: DataFrame, change: Change | None = None, doc_id: str = "doc_id", text: str = "text", group: int = 1 << 20) -> DataFrame:
    """One row per input row: its runs, the strongest of them, and the text without repeated periods.

    Words lie between spaces and the control characters 9 to 13; ``change`` may alter a document's words
    first. A run is a maximal stretch with smallest period q of at least ``max(24, 3 * q)`` words.
    Columns: ``doc_id, n_runs``; ``start, length, period, exponent_milli`` of the run with the greatest
    length/period (ties: smallest start, then period), null without runs; ``runs`` (array of start, length,
    period), and ``collapsed`` (text of the words that no run repeats). Null and empty texts have no words: no
    runs and an empty text. Repeated rows and equal ids give a row each; null ids stay null; an empty
    table gives an empty result; other columns are ignored. A text is handled whole in one task: words
    outside windows that repeat cost a hash, the others about 600 bytes each while their stretch's trees stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbering()
        for ids, texts in _documents(batches, group):
            split = [t.encode().split() for t in texts]
            if change:
                split = [change(i, w) for i, w in zip(ids, split, strict=True)]
            sizes = np.array([len(w) for w in split])
            hashes = np.concatenate([number(w) for w in split])
            marked = repeated_windows(hashes, np.repeat(np.arange(len(split)), sizes), WINDOW)
            ends = np.cumsum(sizes)
            rows, best, kept = [], [], []
            for words, low, high in zip(split, (ends - sizes).tolist(), ends.tolist(), strict=True):
                some = marked[low:high]
                runs = document_runs(hashes[low:high], some) if some.any() else []
                rows.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                best.append(_strongest(runs))
                kept.append(b" ".join(collapsed(words, runs)).decode())
            columns = [pa.array(ids, pa.int64()), pa.array([len(r) for r in rows], pa.int64())]
            columns += [pa.array([b[i] if b else None for b in best], pa.int64()) for i in range(3)]
            columns.append(pa.array([1000 * b[1] // b[2] if b else None for b in best], pa.int64()))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns += [pa.array(rows, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def _documents(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and whole texts, about ``most`` characters at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` with hashes in place of the runs and the text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    written = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    return found.select(*columns, F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
