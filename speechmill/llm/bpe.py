"""Byte-level BPE with a two-tier lookup.

A minimal perfect hash over the vocabulary resolves pre-tokens that are one token. The others are
merged with a heap over linked bytes, lowest rank first and leftmost among equals.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces in each of the two generations that a codec remembers.
CACHED_PIECES = 150_000
LONGEST_CACHED = 64
#: A space before something that is not white space always begins a pre-token, so texts may be cut there.
CUT = re.compile(r" (?=\S)")


class PerfectHash:
    """A minimal perfect hash: level by level, keys that are alone in their slot keep it.

    Slots are numbered over all levels by their rank among taken ones, so n keys get 0 to n - 1.
    """

    def __init__(self, keys: list[bytes], spare: float = 1.5):
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys have one hash")
        base, left, level = 0, hashes, 0
        while len(left):
            width = max(1, int(len(left) * spare))
            slot = self._slot(left, level, width)
            alone = np.bincount(slot, minlength=width) == 1
            self.levels.append((width, base, alone, np.cumsum(alone) - 1))
            base += int(alone.sum())
            left = left[~alone[slot]]
            level += 1
        self.size = base

    @staticmethod
    def _slot(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = hashes ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
            return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(width)).astype(np.int64)

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key; for strangers any number or -1, so the caller compares keys."""
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (width, base, alone, rank) in enumerate(self.levels):
            if not len(todo):
                break
            slot = self._slot(hashes[todo], level, width)
            hit = alone[slot]
            out[todo[hit]] = base + rank[slot[hit]]
            todo = todo[~hit]
        return out


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: pairs wait in a heap, parts are linked by their borders."""
    n = len(piece)
    after = list(range(1, n + 2))  # the end of the part that starts here; 0 once it is swallowed
    before = list(range(-1, n))
    rank = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if j == 0 or j >= n or after[j] != end:
            continue
        after[i], after[j] = end, 0
        if end < n:
            before[end] = i
            far = after[end]
            if (r := rank(piece[i:far])) is not None:
                heapq.heappush(heap, (r, i, far))
        left = before[i]
        if left >= 0 and (r := rank(piece[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary; a bounded memory of recent pieces stands before both tiers."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(pattern)
        tokens = list(self.ranks)
        self.hash = PerfectHash(tokens)
        self.keys: list[bytes] = [b""] * len(tokens)
        self.ids = np.zeros(len(tokens), dtype=np.int64)
        for token, slot in zip(tokens, self.hash.numbers(tokens).tolist(), strict=True):
            self.keys[slot], self.ids[slot] = token, self.ranks[token]
        self.vocabulary = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.vocabulary))]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _packed(self, parts: list[str]) -> dict[str, bytes]:
        """Little-endian ids of distinct pre-tokens: the perfect hash first, the heap for the rest."""
        raw = [p.encode("utf-8", "surrogatepass") for p in parts]
        out = {}
        for part, data, slot in zip(parts, raw, self.hash.numbers(raw).tolist(), strict=True):
            if slot >= 0 and self.keys[slot] == data:
                out[part] = self.packed[self.ids[slot]]
            else:
                out[part] = b"".join([self.packed[i] for i in merged(data, self.ranks)])
        return out

    def _recall(self, wanted: set[str]) -> set[str]:
        """Bring pieces of the older generation back into the recent one; returns those that neither has."""
        missing = wanted.difference(self.recent)
        kept = missing.intersection(self.older)
        self.recent.update((p, self.older[p]) for p in kept)
        return missing - kept

    def _fill(self, pieces: set[str]) -> None:
        """Remember the ids of all ``pieces``; a piece is one or more whole pre-tokens."""
        split = {p: self.pattern.findall(p) for p in self._recall(pieces)}
        self.recent |= self._packed(list(self._recall({x for parts in split.values() for x in parts})))
        known = self.recent
        known.update((p, b"".join([known[x] for x in parts])) for p, parts in split.items() if parts != [p])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        When the recent generation is full it becomes the older one, so frequent pieces, which are
        recalled, outlast rare ones.
        """
        cut = [CUT.split(t) for t in texts]
        for parts in cut:
            parts[1:] = [" " + p for p in parts[1:]]
        self._fill(set().union(*cut))
        out = [b"".join(map(self.recent.__getitem__, parts)) for parts in cut]
        if len(self.recent) > CACHED_PIECES:
            self.older = {p: ids for p, ids in self.recent.items() if len(p) <= LONGEST_CACHED}
            self.recent = {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def batches_of(texts: Iterator[str], most: int) -> Iterator[list[str]]:
    """Whole texts in groups of about ``most`` characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, with ``ids`` as binary if asked for.

    Ids are hashed as little-endian 32-bit integers; the decoded bytes come from those ids. Null
    counts as empty, which has no ids. Repeated rows and ties give equal rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
        for batch in batches:
            start = 0
            for group in batches_of((t.as_py() or "" for t in batch.column(1)), 1 << 20):
                ids = tool.encode(group)
                columns = [
                    batch.column(0).slice(start, len(group)),
                    pa.array([len(data) // 4 for data in ids], pa.int64()),
                    pa.array([hashlib.sha256(data).hexdigest() for data in ids]),
                    pa.array([hashlib.sha256(tool.decode(data)).hexdigest() for data in ids]),
                    *([pa.array(ids, pa.binary())] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                start += len(group)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
