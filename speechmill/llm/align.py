"""Two tokenizations of one text aligned by byte ranges, all documents of a batch in lockstep.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model with byte fallback. Both
encode space + text, so their token ends are offsets into the same bytes. One NumPy state vector
holds an A and a B pointer for every document of a batch; each step advances the pointer whose
token ends first, or both, which links the two tokens and cuts the document there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import stored

#: Characters of text in a batch, and pieces of text that a worker remembers.
BATCH, CACHED_PIECES, LONGEST_CACHED = 1 << 20, 150_000, 64
#: Pieces of a document that one pair of pointers goes through.
LANE = 64
#: No token of either side reaches over a single space between two characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Texts:
    """Tokens of some documents: ids of either side, token counts of their pieces, pieces of each document."""

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray], pieces: np.ndarray):
        self.ids, self.counts, self.pieces = ids, counts, pieces

    @staticmethod
    def joined(parts: list[Texts]) -> Texts:
        both = range(2)
        return Texts([np.concatenate([p.ids[i] for p in parts]) for i in both], [np.concatenate([p.counts[i] for p in parts]) for i in both], np.concatenate([p.pieces for p in parts]))

    def tokens(self, side: int) -> np.ndarray:
        """Tokens of each document."""
        total = np.concatenate([[0], np.cumsum(self.counts[side])])
        ends = np.cumsum(self.pieces)
        return total[ends] - total[ends - self.pieces]


class Pair:
    """Both tokenizers: ids of pieces of text in two pools, remembered up to a bound."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(path_a, encoding="utf-8") as source:
            entries = json.load(source)["model"]["vocab"]
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Texts may be cut where no piece holds a space after something else.
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self._forget()

    def _forget(self) -> None:
        """Number 0 stands for all pieces whose bytes a side does not give back."""
        self.known: dict[str, int] = {}
        self.pools = [np.empty(0, "<u4"), np.empty(0, "<u4")]
        self.counts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _encoded(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids on either side of one text that holds all pieces, and the ids in each; None if bytes differ."""
        text = " " + " ".join(pieces)
        want, ends = text.encode(), np.cumsum([len(p.encode()) + 1 for p in pieces])
        out = []
        many_a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        many_b = self.b.encode(text[1:], num_threads=1)
        for ids, vocabulary, size in ((many_a, self.bytes_a, self.size_a), (many_b, self.bytes_b, self.size_b)):
            if b"".join(map(vocabulary.__getitem__, ids)) != want:
                return None
            packed = np.array(ids, "<u4")
            out.append((packed, np.diff(np.searchsorted(np.cumsum(size[packed]), ends) + 1, prepend=0)))
        return out

    def _learn(self, pieces: list[str]) -> None:
        clean = [p for p in pieces if not (self.whole or p[0].isspace() or p[-1].isspace() or len(p) > LONGEST_CACHED or "▁" in p)]
        groups = [clean[i : i + 1000] for i in range(0, len(clean), 1000)] + [[p] for p in set(pieces).difference(clean)]
        found = [(group, self._encoded(group)) for group in groups]
        # Of a group that fails as a whole each piece is tried by itself.
        found = [x for group, both in found for x in ([(group, both)] if both or len(group) == 1 else [([p], self._encoded([p])) for p in group])]
        for group, both in found:
            self.known.update(dict.fromkeys(group, 0) if both is None else zip(group, range(len(self.counts[0]), len(self.counts[0]) + len(group)), strict=True))
            for side in range(2) if both else ():
                self.counts[side] = np.append(self.counts[side], both[side][1])
        for side in range(2):
            self.pools[side] = np.concatenate([self.pools[side], *[both[side][0] for _, both in found if both]])

    def __call__(self, texts: list[str]) -> Texts:
        """Both sides' tokens of each text; none for texts that a side does not give back."""
        if len(self.known) > CACHED_PIECES or len(self.pools[0]) > 16 * CACHED_PIECES:
            self._forget()
        cut = [([t] if self.whole else CUT.split(t)) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        fresh = list(set(flat).difference(self.known))
        self._learn(fresh)
        number = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        for piece in fresh:
            if len(piece) > LONGEST_CACHED:
                del self.known[piece]
        pieces = np.array([len(parts) for parts in cut], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), pieces)
        bad = np.bincount(doc[number == 0], minlength=len(texts)) > 0
        number = number[~bad[doc]]
        ids, counts = [], []
        for side in range(2):
            count = self.counts[side]
            first, n = (np.cumsum(count) - count)[number], count[number]
            ids.append(self.pools[side][np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
            counts.append(n)
        return Texts(ids, counts, np.where(bad, 0, pieces))


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B tokens that end together, in order.

    ``ends`` are byte ends; lane d, a document or a part of one, has the places ``from[d]`` up to ``to[d]``.
    Finished lanes leave the state vector, so a step costs what is still open.
    """
    alive = np.flatnonzero((from_a < to_a) & (from_b < to_b))
    a, b, last_a, last_b = from_a[alive], from_b[alive], to_a[alive], to_b[alive]
    linked_a, linked_b = [], []
    while len(a):
        x, y = ends_a[a], ends_b[b]
        step_a, step_b = x <= y, y <= x
        both = step_a & step_b
        linked_a.append(a[both])
        linked_b.append(b[both])
        a = a + step_a
        b = b + step_b
        open_ = (a < last_a) & (b < last_b)
        if not open_.all():
            a, b, last_a, last_b = a[open_], b[open_], last_a[open_], last_b[open_]
    if not linked_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Places grow with the document and within it, on both sides alike.
    return np.sort(np.concatenate(linked_a)), np.sort(np.concatenate(linked_b))


def _decimals(most: int) -> np.ndarray:
    """Digits of 0 to ``most`` as rows of characters, zero where a number is shorter."""
    width = len(str(most))
    table = np.zeros((most + 1, width), dtype=np.uint8)
    numbers = np.arange(most + 1)
    for i in range(width):
        table[:, width - 1 - i] = np.where((numbers >= 10**i) | (i == 0), numbers // 10**i % 10 + 48, 0)
    return table


def written_groups(ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, digits: np.ndarray, rows: int = 1 << 18) -> Iterator[bytes]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups in order, some groups at a time; every group ends with a semicolon."""
    start = 0
    while start < len(cut_a):
        low_a, low_b = (cut_a[start - 1] + 1, cut_b[start - 1] + 1) if start else (0, 0)
        end = max(start + 1, int(np.searchsorted(cut_a, low_a + rows)))
        a, b = ids_a[low_a : cut_a[end - 1] + 1], ids_b[low_b : cut_b[end - 1] + 1]
        last_a, last_b = cut_a[start:end] - low_a, cut_b[start:end] - low_b
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        at_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
        at_b = np.arange(len(b)) + (last_a + 1)[group_b]
        out = np.empty((len(a) + len(b), digits.shape[1] + 1), dtype=np.uint8)
        for at, ids, last, mark in ((at_a, a, last_a, b"|"), (at_b, b, last_b, b";")):
            out[at, :-1] = digits[ids]
            out[at, -1] = ord(",")
            out[at[last], -1] = ord(mark)
        yield out[out != 0].tobytes()
        start = end


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


def _tokens(tool: Pair, texts: list[str]) -> Texts:
    """All texts, about a megabyte at a time: a group shares its distinct pieces."""
    out, group, size = [], [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= 1 << 20:
            out.append(tool(group))
            group, size = [], 0
    return Texts.joined([*out, tool(group)] if group else out)


def _lanes(texts: Texts, pieces: int = LANE) -> list[np.ndarray]:
    """Where the lanes of all documents begin and end on side A and B.

    Both sides end at the end of every piece, so a long document may take several lanes.
    """
    ends = np.cumsum(texts.pieces)
    n = -(-texts.pieces // pieces)
    begin = np.repeat(ends - texts.pieces, n) + pieces * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    end = np.minimum(begin + pieces, np.repeat(ends, n))
    totals = [np.concatenate([[0], np.cumsum(c)]) for c in texts.counts]
    return [t[at] for at in (begin, end) for t in totals]


def aligned_batches(docs: DataFrame, path_a: str, path_b: str, most: int, doc_id: str, text: str) -> DataFrame:
    """One row per batch: its documents' digests and sizes, its links, and the distinct id pairs among them.

    Lists run over the documents; ``links`` (packed 32-bit places in ``pairs``) run over the links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pair(path_a, path_b)
        width = len(tool.bytes_b)
        digits = _decimals(max(len(tool.bytes_a), width))
        for k, (ids, texts) in enumerate(_documents(batches, most)):
            some = _tokens(tool, texts)
            (ids_a, ids_b), count_a, count_b = some.ids, some.tokens(0), some.tokens(1)
            # Both sides of a document have the same bytes, so ends counted over the whole batch agree too.
            cut_a, cut_b = lockstep(np.cumsum(tool.size_a[ids_a]), np.cumsum(tool.size_b[ids_b]), *_lanes(some))
            to_a = np.cumsum(count_a)
            to_cut = np.searchsorted(cut_a, to_a)
            n_groups = np.diff(to_cut, prepend=0)
            digests, parts, left = [], written_groups(ids_a, ids_b, cut_a, cut_b, digits), b""
            sizes = _group_sizes(ids_a, ids_b, count_a, count_b)
            for size in sizes.tolist():
                if not size:
                    digests.append("")
                    continue
                digest, last = hashlib.sha256(), b""
                while size:
                    if not left:
                        left = memoryview(next(parts))
                    piece, left = left[:size], left[size:]
                    size -= len(piece)
                    digest.update(last)
                    last = piece
                digest.update(last[:-1])
                digests.append(digest.hexdigest())
            codes = ids_a[cut_a].astype(np.int64) * width + ids_b[cut_b]
            pairs, n = np.unique(codes, return_counts=True)
            links = np.searchsorted(pairs, codes)
            columns = {
                "batch": pa.array([(TaskContext.get().partitionId() << 32) + k], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "n_a": pa.array([count_a], pa.list_(pa.int64())),
                "n_b": pa.array([count_b], pa.list_(pa.int64())),
                "n_groups": pa.array([n_groups], pa.list_(pa.int64())),
                "groups": pa.array([digests], pa.list_(pa.string())),
                "links": pa.array([links.astype("<u4").tobytes()], pa.binary()),
                "ids_a": pa.array([pairs // width], pa.list_(pa.int64())),
                "ids_b": pa.array([pairs % width], pa.list_(pa.int64())),
                "n": pa.array([n], pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    lists = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"batch long, {lists}, links binary, ids_a array<long>, ids_b array<long>, n array<long>")


def _group_sizes(ids_a: np.ndarray, ids_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> np.ndarray:
    """Characters that each document's groups take when written: digits and one mark for each token."""
    out = np.zeros(len(count_a), dtype=np.int64)
    for ids, count in ((ids_a, count_a), (ids_b, count_b)):
        digits = np.searchsorted([10**i for i in range(1, 10)], ids, side="right") + 2
        total = np.concatenate([[0], np.cumsum(digits)])
        ends = np.cumsum(count)
        out += total[ends] - total[ends - count]
    return out


def pair_counts(batches: DataFrame) -> DataFrame:
    """``a, b, total, best`` of every id pair: its links in the corpus, and whether no pair of its B id has more.

    A batch sends each of its distinct pairs once, so a frequent pair is no more rows than batches.
    """
    rows = batches.select(F.explode(F.arrays_zip("ids_a", "ids_b", "n")).alias("p")).select(F.col("p.ids_a").alias("a"), F.col("p.ids_b").alias("b"), "p.n")
    totals = stored(rows.groupBy("a", "b").agg(F.sum("n").alias("total")), "align-totals")
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    return totals.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, batch: int = BATCH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A and B tokens that end at the same byte are linked and end a group; the groups' ids are written as
    ``a1,a2|b1;a3|b2,b3`` and hashed. ``count_sum`` adds up, over the document's links, how many links
    of the corpus have the same two ids; ``n_best`` counts links whose number is the highest of their
    B id, ties included. Null and empty texts, and texts that a side does not give back byte for byte
    (such as those with U+2581), have no tokens: zeros and ''. Special tokens' strings are plain text.
    Repeated rows give equal rows and count each time; null ids stay null; an empty table gives an empty
    result; other columns are ignored, whatever their names. A very long text is one row of a batch of
    its own: it is held whole, in many lanes of the state vector.
    """
    batches = stored(aligned_batches(docs, path_a, path_b, batch, doc_id, text), "align-batches")
    wanted = batches.select("batch", F.posexplode(F.arrays_zip("ids_a", "ids_b")).alias("at", "p"))
    wanted = wanted.select("batch", "at", F.col("p.ids_a").alias("a"), F.col("p.ids_b").alias("b"))
    answers = wanted.join(pair_counts(batches), ["a", "b"]).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("at", "total", "best"))).alias("known"))
    answers = answers.select("batch", F.col("known.total").alias("total"), F.col("known.best").alias("best"))
    each = batches.select("batch", "doc_ids", "n_a", "n_b", "n_groups", "groups", "links").join(answers, "batch", "left")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r.slice(i, 1) for r in rows for i in range(r.num_rows)):
            doc_ids, n_a, n_b, n_groups, groups, links, total, best = (row.column(i)[0] for i in range(1, 9))
            links = np.frombuffer(links.as_py(), "<u4")
            total, best = (np.zeros(0, np.int64) if x.values is None else np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (total, best))
            ends = np.cumsum(n_groups.values.to_numpy())
            starts = ends - n_groups.values.to_numpy()
            sums = [np.concatenate([[0], np.cumsum(x[links].astype(np.int64))]) for x in (best, total)]
            columns = [doc_ids.values, n_a.values, n_b.values, n_groups.values, n_groups.values, *(pa.array(s[ends] - s[starts]) for s in sums), groups.values]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return each.mapInArrow(run, schema)
