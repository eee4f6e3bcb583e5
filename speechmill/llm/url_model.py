"""URL filter from two character language models.

Accepted and rejected URLs each train a variable-order Markov model: the estimate after a context is
mixed with that after the context without its first character, down to no context at all, in shares
that depend on how many different characters were seen after it. A URL is judged by the mean
difference of its log-likelihoods against a threshold calibrated on URLs kept out of training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import stored

ORDER = 3
#: Characters that the models tell apart; 0 stands for the start of a URL and 1 for any other.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789/.:-_?=&%#+~"
SIZE = len(SYMBOLS) + 2
CELLS = SIZE ** (ORDER + 1)
SCORE_BINS, SCORE_MOST = 4000, 10.0
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("''")
    after = F.when(known, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(rest)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    tail = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), tail


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits, else null; of equals the first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later ones override: longer rules come later, and among equals the first in the list comes last.
    for rule in sorted(reversed(rules), key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.host + rule.path).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


_CODES = np.ones(128, dtype=np.int64)
for _i, _c in enumerate(SYMBOLS):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _i + 2


def symbols(url: str | None) -> np.ndarray:
    data = np.frombuffer((url or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return _CODES[np.minimum(data, 127)]


def cells(url: str | None) -> np.ndarray:
    """The cell of each character with its ``ORDER`` characters before it."""
    codes = np.concatenate([np.zeros(ORDER, dtype=np.int64), symbols(url)])
    n = len(codes) - ORDER
    cell = np.zeros(n, dtype=np.int64)
    for i in range(ORDER + 1):
        cell = cell * SIZE + codes[i : i + n]
    return cell


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log-probability of every cell from its counts.

    An order's estimate weighs the shorter context by the number of different characters seen.
    """
    table = counts.reshape((SIZE,) * (ORDER + 1)).astype(np.float64)
    estimate = np.full(SIZE, 1 / SIZE)
    for order in range(ORDER + 1):
        seen = table.sum(axis=tuple(range(ORDER - order)))
        total, kinds = seen.sum(-1, keepdims=True), (seen > 0).sum(-1, keepdims=True)
        estimate = np.where(total > 0, (seen + kinds * estimate) / np.maximum(total + kinds, 1), estimate)
    return np.log(estimate).ravel()


def count_cells(urls: DataFrame, url: str, label: str) -> DataFrame:
    """``label, cell, n`` over all rows; a task adds up its own cells before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [[], []]
            for text, which in zip(batch.column(0), batch.column(1), strict=True):
                codes[which.as_py()].append(cells(text.as_py()))
            for which, found in enumerate(codes):
                cell, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), which), pa.int32()), pa.array(cell), pa.array(n.astype(np.int64))], names=["label", "cell", "n"])

    counted = urls.select(url, F.col(label).cast("int")).mapInArrow(run, "label int, cell long, n long")
    return counted.groupBy("label", "cell").agg(F.sum("n").alias("n"))


@dataclass
class UrlModel:
    """Difference of log-likelihoods by cell (fixed size), and the calibrated threshold."""

    difference: np.ndarray
    threshold: float = 0.0

    def score(self, url: str | None) -> float:
        """Mean over the characters; 0 for an empty URL."""
        cell = cells(url)
        return float(self.difference[cell].mean()) if len(cell) else 0.0


def scored(df: DataFrame, url: str, model: UrlModel, name: str = "score") -> DataFrame:
    """``df`` with the score of its URL column. The model has a fixed size and is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(urls):
        return urls.map(shared.value.score)

    return df.withColumn(name, judge(F.coalesce(F.col(url), F.lit(""))))


def train(urls: DataFrame, url: str, accepted: str) -> UrlModel:
    """Fit on four fifths of the labelled URLs (by checksum) and calibrate on the rest.

    ``accepted`` is a boolean column. What reaches the driver is at most one count for each of the
    model's cells and one for each score bin. The threshold gives the best balanced accuracy, the
    middle of equals; it is 0 where a label has no URL to calibrate with, and so are all scores
    where a label has none to learn from.
    """
    rows = urls.select(F.col(url).alias("url"), F.col(accepted).cast("int").alias("label")).filter("label is not null")
    aside = F.crc32(F.coalesce(F.col("url"), F.lit("")).cast("binary")) % 5 == 0
    counts = np.zeros((2, CELLS), dtype=np.int64)
    for row in count_cells(rows.filter(~aside), "url", "label").toLocalIterator():
        counts[row["label"], row["cell"]] = row["n"]
    if not counts.any(axis=1).all():
        return UrlModel(np.zeros(CELLS, dtype=np.float32))
    model = UrlModel((smoothed(counts[1]) - smoothed(counts[0])).astype(np.float32))
    step = 2 * SCORE_MOST / SCORE_BINS
    bin_of = F.least(F.greatest(F.floor((F.col("score") + SCORE_MOST) / step), F.lit(0)), F.lit(SCORE_BINS - 1))
    kept = scored(rows.filter(aside), "url", model).groupBy("label", bin_of.alias("bin")).count().collect()
    seen = np.zeros((2, SCORE_BINS), dtype=np.float64)
    for row in kept:
        seen[row["label"], row["bin"]] = row["count"]
    if seen.any(axis=1).all():
        below = np.cumsum(seen / seen.sum(axis=1, keepdims=True), axis=1)
        gain = below[0] - below[1]  # rejected URLs below the threshold, less accepted ones
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        model.threshold = float((best[len(best) // 2] + 1) * step - SCORE_MOST)
    return model


def judged(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    The longest rule that fits decides; other URLs are allowed if their score reaches the threshold of
    the models trained on the URLs that rules decide. Without enough of those (empty tables, one
    verdict only) undecided URLs are allowed. Null and odd URLs have empty host and path and are
    judged alike; repeated rows give equal rows.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = stored(rows.select("*", rule.alias("rule"), verdict.alias("ruled")), "urls")
    model = train(rows.withColumn("accepted", F.col("ruled") == ALLOW), "url", "accepted")
    out = scored(rows, "url", model)
    by_model = F.when(F.col("score") >= model.threshold, ALLOW).otherwise(BLOCK)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
