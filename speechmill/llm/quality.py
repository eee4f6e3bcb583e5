"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents and flattened into arrays; scoring
walks all rows of an Arrow batch down all levels with numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 12_000
FEATURES = (
    "log_bytes", "log_words", "mean_word", "deviation_word", "longest_word", "upper", "digit", "space", "non_ascii",
    "letter", "comma_stop", "bar", "bang", "hash", "star", "percent", "dollar", "ampersand", "at", "angle", "brace", "slash",
    "quote", "control", "other_mark", "log_lines", "mean_line", "repeated_lines", "repeated_words", "top_word", "top_two_words",
    "same_as_last", "capital_words", "all_upper_words", "mark_end_words", "no_letter_words", "entropy", "distinct_bytes", "short_words",
)
_MARKS = {"bar": b"|", "bang": b"!", "hash": b"#", "star": b"*", "percent": b"%", "dollar": b"$", "ampersand": b"&", "at": b"@"}
_GROUPS = {"angle": b"<>", "brace": b"{}[]()", "slash": b"/\\", "quote": b"'\"`", "comma_stop": b".,;:?"}


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of one whole text; null and empty texts give zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    lines = data.split(b"\n")
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    common = sorted(seen.values())[-2:]
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    f = {
        "log_bytes": np.log1p(n),
        "log_words": np.log1p(len(words)),
        "mean_word": lengths.mean(),
        "deviation_word": lengths.std(),
        "longest_word": np.log1p(lengths.max()),
        "upper": count[65:91].sum() / n,
        "digit": count[48:58].sum() / n,
        "space": (count[32] + count[9:14].sum()) / n,
        "non_ascii": count[128:].sum() / n,
        "letter": letters / n,
        "control": (count[:9].sum() + count[14:32].sum() + count[127]) / n,
        "log_lines": np.log1p(len(lines)),
        "mean_line": np.log1p(n / len(lines)),
        "repeated_lines": 1 - len(set(lines)) / len(lines),
        "repeated_words": 1 - len(seen) / w,
        "top_word": common[-1] / w if common else 0.0,
        "top_two_words": sum(common) / w,
        "same_as_last": sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        "capital_words": sum(65 <= x[0] <= 90 for x in words) / w,
        "all_upper_words": sum(map(bytes.isupper, words)) / w,
        "mark_end_words": sum(x[-1] in b"!#$%&*|@~^" for x in words) / w,
        "no_letter_words": sum(not x.lower().islower() and x[0] < 128 for x in words) / w,
        "distinct_bytes": np.count_nonzero(count) / 256,
        "short_words": (lengths <= 3).mean(),
    }
    share = count[count > 0] / n
    f["entropy"] = -(share * np.log2(share)).sum()
    f |= {name: count[mark[0]] / n for name, mark in _MARKS.items()}
    f |= {name: count[list(marks)].sum() / n for name, marks in _GROUPS.items()}
    named = sum(count[m[0]] for m in _MARKS.values()) + sum(count[list(m)].sum() for m in _GROUPS.values())
    f["other_mark"] = max(0.0, (count[33:127].sum() - count[65:91].sum() - count[97:123].sum() - count[48:58].sum() - named) / n)
    return [float(f[name]) for name in FEATURES]


@dataclass
class Forest:
    """Complete binary trees as arrays: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    border: np.ndarray  # goes left if value <= border
    value: np.ndarray  # trees x leaves
    base: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(rows), self.base)
        line = np.arange(len(rows))
        for feature, border, value in zip(self.feature, self.border, self.value, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[line, feature[node]] > border[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, l2: float = 1.0) -> Forest:
    """Boosted trees on binned statistics with logistic loss.

    Gradients of a level are summed by (node, statistic, bin); the best split of every node is read
    from the running sums. One label only, or no rows, gives the smoothed share of label 1.
    """
    n, width = rows.shape
    share = (labels.sum() + 1) / (n + 2)
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(share / (1 - share))), depth)
    if n == 0 or labels.min() == labels.max():
        return forest
    borders = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(b, rows[:, j], side="left") for j, b in enumerate(borders)], axis=1)
    cell = binned + np.arange(width) * bins
    total = np.full(n, forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = labels - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            many, start = 2**level, 2**level - 1
            place = ((node - start)[:, None] * (width * bins) + cell).ravel()
            size = many * width * bins
            g = np.bincount(place, np.repeat(gradient, width), size).reshape(many, width, bins).cumsum(2)
            h = np.bincount(place, np.repeat(weight, width), size).reshape(many, width, bins).cumsum(2)
            whole_g, whole_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + l2) + (whole_g - g) ** 2 / (whole_h - h + l2) - whole_g**2 / (whole_h + l2)
            gain[(h < 1.0) | (whole_h - h < 1.0)] = -1
            best = gain.reshape(many, -1).argmax(1)
            j, b = np.divmod(best, bins)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            for i in range(many):
                if good[i] and b[i] < len(borders[j[i]]):
                    forest.feature[t, start + i], forest.border[t, start + i] = j[i], borders[j[i]][b[i]]
            node = 2 * node + 1 + (rows[np.arange(n), forest.feature[t, node]] > forest.border[t, node])
        leaf = node - inner
        forest.value[t] = rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, weight, leaves) + l2)
        total += forest.value[t][leaf]
    return forest


def held_out(doc_id: str = "doc_id"):
    """A fifth of all ids, told by the checksum of the id as text; their labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, quality, text`` of at most ``sample`` labelled documents, by hash of the id.

    Rows held out, without a label, or with an id that has both labels are left out.
    """
    one = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out()).groupBy("doc_id")
    sure = one.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    # The labels' order by hash is a bounded top list; it is sample rows of two numbers.
    chosen = sure.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def _measured(df: DataFrame, keep: str, schema: str, forest: Forest | None) -> DataFrame:
    """``keep`` columns, then the statistics as an array (no forest) or the score; text comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)], dtype=np.float64).reshape(-1, len(FEATURES))
            out = pa.array(list(rows), pa.list_(pa.float64())) if forest is None else pa.array(forest.score(rows), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "out"])

    return df.select(*keep.split(), "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **settings) -> Forest:
    """Fit on the bounded sample; only its statistics reach the driver."""
    measured = _measured(training_rows(docs, labels, sample), "doc_id quality", "doc_id long, quality int, out array<double>", None)
    got = sorted(measured.collect(), key=lambda r: r["doc_id"])
    rows = np.array([r["out"] for r in got], dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(rows, np.array([r["quality"] for r in got], dtype=np.float64), **settings)


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts are scored from zero statistics."""
    return _measured(docs.select("doc_id", "text"), "doc_id", "doc_id long, out double", forest).withColumnRenamed("out", "score")


def drop_low_quality(docs: DataFrame, forest: Forest, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score below ``least``; all columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            rows = np.array([statistics(t.as_py()) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(forest.score(rows) >= least))

    return docs.mapInArrow(run, docs.schema)


def checksum_fold(doc_id: int) -> int:
    """The fold of an id in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
