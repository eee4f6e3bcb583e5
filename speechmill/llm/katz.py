"""Katz back-off language model: counts in tables by key range, texts scored from the tables' answers.

Texts are read once into batches of word numbers, kept as files in the shared folder. A batch sends
its distinct n-grams with their training counts to the tasks that own the key ranges; these add up
over all batches and answer every batch in the order of its request, so the largest exchange is one
entry for each n-gram of a batch, however frequent it is. Of the batches that hold an n-gram in
training text one owns it; the owners add, context by context, the discounted mass and the lower-order
probability of what follows, which makes the back-off weights exact.

An n-gram is known by a 64-bit hash of its words.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import shared_path, stored

#: Characters of text in a batch, and tokens of the corpus for each key range.
BATCH, RANGE_TOKENS = 10 << 20, 1 << 20
#: Counts above this are taken as they are; those up to it are discounted.
K = 5
END, BEGIN = xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" begin")


def discounts(counted: list[int]) -> np.ndarray:
    """Katz's factors for counts 0 to K and one for all above; ``counted[r - 1]`` n-grams occur r times.

    Good-Turing counts r* = (r + 1) n[r+1] / n[r], renormalised so that what counts up to k lose is the
    mass of n-grams seen once. The largest k up to K is taken whose factors all lie between 0 and 1. If
    there is none (too few or oddly spread counts) counts up to K lose an absolute n1 / (n1 + 2 n2).
    """
    n = [0, *counted]
    for k in range(K, 1, -1):
        if not all(n[1 : k + 2]):
            continue
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            continue
        factors = [((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in factors):
            return np.array([0.0, *factors, *[1.0] * (K + 1 - k)])
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.array([0.0, *[(r - cut) / r for r in range(1, K + 1)], 1.0])


class Level:
    """What all batches know of one order: factors, and for words alone also the total and the rest."""

    def __init__(self, stats: list[int]):
        *self.counted, self.tokens, self.kinds = stats
        self.factor = discounts(self.counted)
        self.loss = (1 - self.factor) * np.arange(K + 2)
        lost = float(np.dot(self.loss[1 : K + 1], self.counted[:K]))
        # Without any discounted count one more observation makes room for unknown words.
        self.total = self.tokens + (lost == 0)
        self.unknown = (lost or 1.0) / self.total

    def discounted(self, counts: np.ndarray) -> np.ndarray:
        return counts * self.factor[np.minimum(counts, K + 1)]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, whose upper bytes are alike."""
    return _pack(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = _unpack(data, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _store(folder: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _fold(context: np.ndarray | int, word: np.ndarray | int) -> np.ndarray:
    """Keys of n-grams from those of their first words and their last word."""
    with np.errstate(over="ignore"):
        mixed = np.asarray(context, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(word, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        return mixed ^ (mixed >> np.uint64(32))


class Batch:
    """Whole documents as numbers of words; ``words[number]`` is a word's hash, number 0 the end."""

    def __init__(self, path: str):
        store, place = _store(path)
        with store.open_input_stream(place, compression=None) as source:
            arrays = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(source.read())))
        self.ids, self.has_id, self.train, self.sizes, tokens, words = (arrays[f"arr_{i}"] for i in range(6))
        self.tokens = words[tokens]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.in_train = np.repeat(self.train, self.sizes)

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order the keys of the contexts and of the n-grams that end at each token."""
        context, begin = np.zeros(len(self.tokens), dtype=np.uint64), np.zeros((), dtype=np.uint64)
        for _ in range(order):
            keys = _fold(context, self.tokens)
            yield context, keys
            begin = _fold(begin, BEGIN)
            context = np.empty_like(keys)
            context[1:] = keys[:-1]
            context[self.starts] = begin

    @staticmethod
    def write(path: str, *arrays: np.ndarray) -> None:
        store, place = _store(path)
        out = io.BytesIO()
        np.savez(out, *arrays)
        with store.open_output_stream(place, compression=None) as sink:
            sink.write(zstandard.ZstdCompressor(level=3).compress(out.getbuffer()))


def _read(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Documents as word numbers, about ``most`` characters at a time."""

    def flush():
        nonlocal group, flat
        many = [w for words in group for w in [*words, b" end"]]
        for w in set(many).difference(known):
            known[w] = len(words_)
            words_.append(xxhash.xxh3_64_intdigest(w))
        flat.append(np.fromiter(map(known.__getitem__, many), dtype=np.uint32, count=len(many)))
        group = []

    known, words_ = {b" end": 0}, [END]
    ids, train, sizes, group, flat, held, size = [], [], [], [], [], 0, 0
    for batch in rows:
        for doc_id, learn, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            body = (text.as_py() or "").encode()
            group.append(body.lower().split())
            ids.append(doc_id.as_py())
            train.append(learn.as_py())
            sizes.append(len(group[-1]) + 1)
            held += len(body)
            size += len(body)
            if held >= 1 << 20 or size >= most:
                flush()
                held = 0
            if size >= most:
                yield ids, train, sizes, flat, words_
                known, words_ = {b" end": 0}, [END]
                ids, train, sizes, flat, size = [], [], [], [], 0
    if ids:
        flush()
        yield ids, train, sizes, flat, words_


def batches(docs: DataFrame, learn: Column, folder: str, most: int, doc_id: str, text: str) -> DataFrame:
    """Write all documents as batches; returns ``path, n_tokens`` of those that count."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, train, sizes, flat, words in _read(rows, most):
            path = f"{folder}/batch-{uuid.uuid4().hex}"
            here = np.array([i is not None for i in ids])
            arrays = np.array([i or 0 for i in ids], np.int64), here, np.array(train), np.array(sizes, np.int64), np.concatenate(flat), np.array(words, np.uint64)
            Batch.write(path, *arrays)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sum(sizes)], pa.int64())], names=["path", "n_tokens"])

    store, place = _store(folder)
    store.create_dir(place, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(run, "path string, n_tokens long"), "katz-batches")


def _ranges(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """Slices of ascending keys by equal ranges of all 64-bit keys."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    ends = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    for part, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
        if low < high:
            yield part, slice(low, high)


def counted(manifest: DataFrame, order: int, ranges: int) -> DataFrame:
    """For each batch, order and key range the training counts of its n-grams, and which of them it owns.

    A row without a path holds the range's statistics: how many n-grams occur 1 to K + 1 times, all
    occurrences and all kinds.
    """

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p.as_py() for r in rows for p in r.column(0)):
            batch = Batch(path)
            for m, (_, keys) in enumerate(batch.grams(order), 1):
                kinds, which = np.unique(keys, return_inverse=True)
                counts = np.bincount(which, weights=batch.in_train, minlength=len(kinds)).astype("<u4")
                parts = [(part, _pack_keys(kinds[s]), _pack(counts[s])) for part, s in _ranges(kinds, ranges)]
                columns = [pa.array([x] * len(parts), t) for x, t in ((m, pa.int32()), (path, pa.string()))]
                columns += [pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["m", "path", "part", "keys", "counts"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = [_unpack_keys(k.as_py()) for k in table.column("keys")]
        counts = np.concatenate([_unpack(c.as_py(), "<u4") for c in table.column("counts")]).astype(np.int64)
        keys, which = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(keys)).astype(np.int64)
        owner = np.full(len(keys), len(counts))
        seen = np.flatnonzero(counts)[::-1]
        owner[which[seen]] = seen
        mine = owner[which] == np.arange(len(counts))
        stats = [*np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist(), int(total.sum()), int((total > 0).sum())]
        ends = np.cumsum([len(a) for a in asked])
        slices = [slice(e - len(a), e) for a, e in zip(asked, ends.tolist(), strict=True)]
        n = len(slices) + 1
        columns = {
            "m": pa.array([key[0].as_py()] * n, pa.int32()),
            "path": pa.array([*table.column("path").to_pylist(), None], pa.string()),
            "part": pa.array([key[1].as_py()] * n, pa.int32()),
            "counts": pa.array([*[_pack(total[which[s]].astype("<u8")) for s in slices], None], pa.binary()),
            "owned": pa.array([*[_pack(mine[s]) for s in slices], None], pa.binary()),
            "stats": pa.array([*[None] * len(slices), stats], pa.list_(pa.int64())),
        }
        return pa.table(columns)

    asked = manifest.select("path").mapInArrow(ask, "m int, path string, part int, keys binary, counts binary")
    kinds = "m int, path string, part int, counts binary, owned binary, stats array<long>"
    return stored(asked.groupBy("m", "part").applyInArrow(answer, kinds), "katz-counts")


def levels(counts: DataFrame, order: int) -> list[Level]:
    """Statistics over all ranges: one row an order reaches the driver."""
    width = K + 3
    sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(width)]
    found = {r["m"]: [r[f"s{i}"] for i in range(width)] for r in counts.filter("path is null").groupBy("m").agg(*sums).collect()}
    return [Level(found.get(m, [0] * width)) for m in range(1, order + 1)]


def _probabilities(batch: Batch, rows: pa.Table, known: list[Level], order: int, n_train: int) -> Iterator[tuple]:
    """Order by order the probability of each token after its context, and what it came from.

    An n-gram seen in training has its discounted share of its context. For another the next lower
    order's probability is weighted with what the context's seen n-grams left. Contexts never seen
    leave the lower order as it is. A context that discounts nothing counts one observation more.
    """
    answers: dict[tuple[int, bool], list[dict]] = {}
    for row in rows.sort_by("part").to_pylist():
        answers.setdefault((row["m"], row["rest"] is not None), []).append(row)
    joined = lambda m, rest, name, kind: np.concatenate([_unpack(r[name], kind) for r in answers[m, rest]])
    lower, before = None, None
    for m, (context, keys) in enumerate(batch.grams(order), 1):
        kinds, first, which = np.unique(keys, return_index=True, return_inverse=True)
        total = joined(m, False, "counts", "<u8").astype(np.int64)
        count = total[which]
        level = known[m - 1]
        if m == 1:
            lower = np.where(count > 0, level.discounted(count) / level.total, level.unknown)
            yield m, lower, count, None
        else:
            size = np.empty_like(count)
            size[1:] = before[:-1]
            size[batch.starts] = n_train
            contexts, at = np.unique(context, return_inverse=True)
            yield m, lower, count, (contexts, at, first, joined(m, False, "owned", "?") & (total > 0), total, (size > 0) & (count == 0))
            if (m, True) not in answers:
                return
            lost = joined(m, True, "lost", "<f8")[at]
            rest = joined(m, True, "rest", "<f8")[at]
            share = size + (lost == 0)
            weight = np.where(lost == 0, 1.0, lost) / np.maximum(share, 1) / rest
            backed = np.where(size > 0, weight * lower, lower)
            lower = np.where(count > 0, level.discounted(count) / np.maximum(share, 1), backed)
            yield m, lower, count, None
        before = count


def _answers(counts: DataFrame, weights: DataFrame | None) -> DataFrame:
    rows = counts.filter("path is not null").select("path", "m", "part", "counts", "owned", F.lit(None).cast("binary").alias("lost"), F.lit(None).cast("binary").alias("rest"))
    return rows if weights is None else rows.unionByName(weights, allowMissingColumns=True)


def back_off(counts: DataFrame, weights: DataFrame | None, known: list[Level], m: int, ranges: int, n_train: int) -> DataFrame:
    """For each batch and key range the mass that its contexts of order ``m`` leave, and the rest to share it."""

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        path = key[0].as_py()
        batch = Batch(path)
        for at_m, lower, count, found in _probabilities(batch, rows, known, m, n_train):
            if at_m != m:
                continue
            contexts, at, first, owned, total, unseen = found
            place = first[owned]
            lost = np.bincount(at[place], weights=known[m - 1].loss[np.minimum(total[owned], K + 1)], minlength=len(contexts))
            taken = np.bincount(at[place], weights=lower[place], minlength=len(contexts))
            wanted = np.bincount(at[unseen], minlength=len(contexts)) > 0
            parts = [(p, _pack_keys(contexts[s]), _pack(lost[s]), _pack(taken[s]), _pack(wanted[s])) for p, s in _ranges(contexts, ranges)]
            kinds = pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
            columns = [pa.array([path] * len(parts)), *(pa.array([p[i] for p in parts], t) for i, t in enumerate(kinds))]
            return pa.Table.from_arrays(columns, names=["path", "part", "keys", "lost", "taken", "wanted"])
        raise ValueError("a batch without its counts")

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = [_unpack_keys(k.as_py()) for k in table.column("keys")]
        keys, which = np.unique(np.concatenate(asked), return_inverse=True)
        lost, taken = (np.bincount(which, weights=np.concatenate([_unpack(c.as_py(), "<f8") for c in table.column(n)]), minlength=len(keys)) for n in ("lost", "taken"))
        rest = np.maximum(1 - taken, known[0].unknown if m == 2 else 1e-12)
        out_lost, out_rest, start = [], [], 0
        for a, want in zip(asked, table.column("wanted"), strict=True):
            at = which[start : start + len(a)]
            start += len(a)
            wanted = _unpack(want.as_py(), "?")
            # Where nothing backs off it only matters whether the context discounts at all.
            out_lost.append(_pack(np.where(wanted, lost[at], lost[at] > 0)))
            out_rest.append(_pack(np.where(wanted, rest[at], 1.0)))
        n = len(asked)
        columns = [table.column("path").combine_chunks(), pa.array([m] * n, pa.int32()), pa.array([key[0].as_py()] * n, pa.int32()), pa.array(out_lost, pa.binary()), pa.array(out_rest, pa.binary())]
        return pa.Table.from_arrays(columns, names=["path", "m", "part", "lost", "rest"])

    asked = _answers(counts, weights).groupBy("path").applyInArrow(ask, "path string, part int, keys binary, lost binary, taken binary, wanted binary")
    return stored(asked.groupBy("part").applyInArrow(answer, "path string, m int, part int, lost binary, rest binary"), f"katz-weights-{m}")


def scores(
    docs: DataFrame, learn: Column, order: int = 2, batch: int = BATCH, range_tokens: int = RANGE_TOKENS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows for which ``learn`` holds (null: it does not). A-Z are lower-cased, words lie
    between spaces and the control characters 9 to 13, and an end follows the last; null and empty
    texts hold the end alone. ``score`` is the log10 probability of the text under a Katz model of
    ``order`` words, in which all words outside the training text share one unknown word; ``base_score``
    is that of single words with 0.5 added to every count. Without training text both are zero. Repeated
    rows count each time; null ids stay null; an empty table gives an empty result; other columns are ignored.
    A very long text is a batch of its own and is held whole in one task.
    """
    folder = shared_path(docs.sparkSession, "katz-texts")
    manifest = batches(docs, learn, folder, batch, doc_id, text)
    size = manifest.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    ranges = max(1, -(-size // range_tokens))
    counts = counted(manifest, order, ranges)
    known = levels(counts, order)
    n_train = docs.filter(F.coalesce(learn, F.lit(False))).count()
    weights = None
    for m in range(2, order + 1):
        more = back_off(counts, weights, known, m, ranges, n_train)
        weights = more if weights is None else weights.unionByName(more)

    def score(key: tuple, rows: pa.Table) -> pa.Table:
        one = Batch(key[0].as_py())
        base = words = last = None
        for m, probability, count, found in _probabilities(one, rows, known, order, n_train):
            if m == 1:
                base = np.log10((count + 0.5) / (known[0].tokens + 0.5 * (known[0].kinds + 1)))
                words = count > 0
            if found is None:
                last = probability
        sums = [np.add.reduceat(x, one.starts) for x in (words.astype(np.int64), base, np.log10(last))]
        n = len(one.ids)
        columns = [pa.array(one.ids, mask=~one.has_id), pa.array(one.sizes), pa.array(sums[0]), pa.array([known[0].tokens] * n, pa.int64()), pa.array(sums[1]), pa.array(sums[2])]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _answers(counts, weights).groupBy("path").applyInArrow(score, schema)
