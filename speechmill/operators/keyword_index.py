"""Containment of very many keywords in texts, through an index of their rarest q-grams.

A text that contains a keyword contains every q-gram of it. The index files each keyword under the one
of its q-grams that fewest keywords share, its anchor; a text meets the keywords filed under its own
distinct q-grams, and only those are tested for containment. The work follows the texts and the hits,
not texts times keywords.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from speechmill.functions.expr import let
from speechmill.session import kept

# The search for q-grams travels with the plan, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Length of a q-gram; shorter keywords are filed whole. Six characters leave few candidates that a text does not contain. Tasks that the texts of one anchor are spread over.
Q, SALTS = 6, 8
#: Bits of the bitmap that tells q-grams which are no anchor, and q-grams returned at a time.
BITS, RETURNED = 22, 100_000


def grams(text: Column, q: int) -> Column:
    """The distinct q-grams of a text, in code points."""
    return let(
        F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
        lambda c: F.array_distinct(
            F.when(F.size(c) >= q, F.transform(F.sequence(F.lit(0), F.size(c) - q), lambda i: F.concat(*[F.get(c, i + j) for j in range(q)]))).otherwise(
                F.array().cast("array<string>")
            )
        ),
    )


def build(lexicon: DataFrame, topic: str = "topic", keyword: str = "keyword", fold_case: bool = True, q: int = Q) -> DataFrame:
    """``anchor, topic, keyword, folded`` of every distinct (topic, keyword), written to the shared folder.

    Null and empty keywords are left out; they match nothing. Ties between q-grams go to the smaller one.
    """
    folded = F.lower(F.col(keyword)) if fold_case else F.col(keyword)
    rows = lexicon.select(F.col(topic).alias("topic"), F.col(keyword).alias("keyword"), folded.alias("folded")).filter("keyword <> ''").distinct()
    words = rows.select("folded").distinct()
    pieces = F.when(F.length("folded") < q, F.array("folded")).otherwise(grams(F.col("folded"), q))
    filed = words.select("folded", F.explode(pieces).alias("anchor"))
    shared = filed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    rarest = filed.join(shared, "anchor").groupBy("folded").agg(F.min_by("anchor", F.struct("n", "anchor")).alias("anchor"))
    return kept(rarest.join(rows, "folded").select("anchor", "topic", "keyword", "folded"), "keyword-index")


def _slots(points: np.ndarray, n: int) -> np.ndarray:
    """Place in the bitmap of every ``n`` successive code points."""
    h = np.zeros(len(points) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(1_000_003) + points[i : len(points) - n + 1 + i]
    return (h ^ (h >> np.uint64(BITS))) & np.uint64((1 << BITS) - 1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """Which slots some anchor has: at most ``2 ** (BITS - 6)`` rows reach the driver, however many anchors there are."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [int(_slots(p, len(p))[0]) for p in map(_points, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["slot"])

    marks = anchors.select("anchor").mapInArrow(slots, "slot long").select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    rows = marks.groupBy("word").agg(F.bit_or("bit").alias("mask")).collect()
    words = np.zeros(1 << (BITS - 6), dtype="<i8")
    words[[r["word"] for r in rows]] = [r["mask"] for r in rows]
    return words.view(np.uint8)


def _probes(texts: DataFrame, anchors: DataFrame, lengths: list[int]) -> DataFrame:
    """``key, anchor``: the distinct q-grams of each text that may be an anchor; a bitmap of fixed size leaves out most others."""
    packed = _bitmap(anchors)
    schema = StructType([texts.schema["key"], StructField("anchor", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(packed, bitorder="little").astype(bool)
        for batch in batches:
            at, grams = [], []
            for i, text in enumerate(batch.column("source")):
                text = text.as_py()
                points, found = _points(text), set()
                for n in lengths:
                    if len(points) >= n:
                        found.update(text[p : p + n] for p in np.flatnonzero(marked[_slots(points, n)]).tolist())
                at += [i] * len(found)
                grams += found
                if len(at) >= RETURNED:
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(grams, pa.string())], names=["key", "anchor"])
                    at, grams = [], []
            if at:
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(grams, pa.string())], names=["key", "anchor"])

    return texts.select("key", "source").mapInArrow(run, schema)


def _contained(rows: DataFrame) -> DataFrame:
    """``key, folded``: the candidates that each text contains."""
    schema = StructType([rows.schema["key"], StructField("folded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                hits = [[k for k in c.as_py() if k in s] for s, c in zip(some.column("source").to_pylist(), some.column("candidates"), strict=True)]
                at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
                yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(at)), pa.array([k for h in hits for k in h], pa.string())], names=["key", "folded"])

    return rows.select("key", "source", "candidates").mapInArrow(run, schema)


def matches(df: DataFrame, key: str, text: str, index: DataFrame, fold_case: bool = True, q: int = Q) -> DataFrame:
    """``key, topic, keyword``: the index's keywords that each text contains.

    ``key`` tells rows apart. Candidates are gathered in the row of their text, so each text is
    read twice and travels once, and at most as many candidates meet there as the index has keywords.
    Null texts match nothing.
    """
    source = F.lower(F.col(text)) if fold_case else F.col(text)
    texts = df.select(F.col(key).alias("key"), F.coalesce(source, F.lit("")).alias("source"))
    lengths = sorted(r["n"] for r in index.select(F.least(F.length("anchor"), F.lit(q)).alias("n")).distinct().collect())
    anchors = index.select("anchor", "folded").distinct()
    salted = _probes(texts, anchors, lengths).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    copies = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    candidates = salted.join(copies, ["anchor", "salt"]).select("key", "folded")
    gathered = candidates.groupBy("key").agg(F.collect_set("folded").alias("candidates"))
    hits = _contained(texts.join(gathered, "key"))
    return hits.join(index.select("folded", "topic", "keyword"), "folded").select(F.col("key").alias(key), "topic", "keyword")
