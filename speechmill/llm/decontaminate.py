"""Benchmark decontamination by spaced seeds.

A seed hashes the words of a window under a fixed mask; ignored places may differ. Seeds of the
documents are joined with those of the benchmark items, and the words around every hit are compared
place by place, so a copied passage is found although single words were replaced in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import bitmap, possibly_in, stored

#: Least words of a run, most of them that may differ, and masks (places that count) of which at
#: least one then fits between any differing places. Places 0 and last count, so a seed lies within
#: the document. Tests enumerate all patterns; what is not listed here falls back to plain runs.
FAMILIES = (
    (5, 1, ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))),
    (10, 2, ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))),
    (15, 3, ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))),
    (20, 4, ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5))),
)


def masks_of(width: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """Masks that leave a seed in every run of ``width`` words of which ``percent`` are equal."""
    differing = width - max(1, -(-percent * width // 100))
    known = [masks for least, most, masks in FAMILIES if width >= least and 0 < differing <= most]
    # One of the stretches between the differing places has this many words; without any it is the whole run.
    return known[-1] if known else (tuple(range(-(-(width - differing) // (differing + 1)))),)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeded(df: DataFrame, keep: list[str], at: str, masks: dict[tuple[int, ...], Column]) -> DataFrame:
    """``keep`` columns, ``at`` and ``seed`` for each window of ``hashes`` and mask whose condition holds.

    Rows carry the window alone, not the whole text. The outer form keeps the optimizer from
    computing the words once more for a filter below the generator.
    """
    hashes, spans = F.col("hashes"), [1 + mask[-1] for mask in masks]
    shifted = [F.slice(hashes, 1 + i, F.size(hashes)).alias(f"w{i}") for i in range(max(spans))]
    asked = [condition.alias(f"m{i}") for i, condition in enumerate(masks.values())]
    windows = df.select(*keep, *asked, F.posexplode_outer(F.arrays_zip(*shifted)).alias(at, "window"))
    whole = windows.filter(F.col(f"window.w{min(spans) - 1}").isNotNull())
    seeds = [
        F.when(F.col(f"m{i}") & F.col(f"window.w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"window.w{p}") for p in mask]))
        for i, mask in enumerate(masks)
    ]
    return whole.select(*keep, at, F.explode_outer(F.array(*seeds)).alias("seed")).filter("seed is not null")


def item_words(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, item_words`` of every item; repeated rows count once."""
    return benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(text)).alias("item_words")).distinct()


def best_window(doc: Column, item: Column, shift: Column, block: Column, window: int) -> Column:
    """Most equal words in a run of ``window`` places of the item that holds a place of the block.

    Place p of the item is held against place p + ``shift`` of the document; a block is ``window``
    places. The run is the whole item if that is shorter; places outside the document count as different.
    """
    width = F.least(F.size(item), F.lit(window))
    first = F.greatest(block * window + 1 - width, F.lit(0))
    last = F.least(block * window + window - 1, F.size(item) - width)
    place = lambda p: F.when((p + shift >= 0) & (p + shift < F.size(doc)) & (doc[p + shift] == item[p]), 1).otherwise(0)
    # Equal words from the first place that any run holds.
    equal = F.transform(F.sequence(first, last + width - 1), place)
    at = F.sequence(F.lit(0), last - first)
    sums = F.transform(at, lambda k: F.aggregate(F.slice(equal, k + 1, width), F.lit(0), lambda a, x: a + x))
    return F.array_max(sums)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 20,
    percent: int = 80,
    broadcast_seeds: int = 500_000,
    bits: int = 24,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, matched, width`` for every document that holds a passage of an item.

    A document holds a passage if ``percent`` of ``window`` successive words of the item (of all its
    words, if fewer) stand at the same distances in the document; so items of up to four words must
    stand there whole. ``matched`` is the most over all places. Every such passage has a seed: the
    masks are those of the widths that items have. Null and empty texts match nothing; repeated rows
    give one result; empty tables give none; null ids are kept as such.

    Of the scan only hits are shuffled. Item seeds are broadcast up to ``broadcast_seeds`` rows, which
    are counted first; beyond that the same join is left to Spark. The words of documents with a hit
    are then read once more and compared around each hit.
    """
    items = stored(item_words(benchmark), "items")
    # Items may share an id, so a hit names the item by id and words.
    items = items.withColumn("item_key", F.xxhash64("item_id", "item_words"))
    width = F.least(F.size("item_words"), F.lit(window))
    widths = [r["width"] for r in items.select(width.alias("width")).distinct().filter("width > 0").collect()] or [window]
    asked = {}
    for n in sorted(widths):
        for mask in masks_of(n, percent):
            asked.setdefault(mask, []).append(n)
    of_width = {mask: width.isin(some) for mask, some in asked.items()}
    seeds = _seeded(items.withColumn("hashes", F.col("item_words")), ["item_key"], "item_at", of_width)
    seeds = stored(seeds, "item-seeds")
    few = seeds.count() <= broadcast_seeds
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"), F.xxhash64(doc_id, text).alias("row_key"))
    hashed = rows.select("row_key", word_hashes(F.col("body")).alias("hashes"))
    hits = _seeded(hashed, ["row_key"], "doc_at", dict.fromkeys(asked, F.lit(True))).join(F.broadcast(seeds) if few else seeds, "seed")
    # Hits of one alignment are compared once for each block of the item.
    shift, block = (F.col("doc_at") - F.col("item_at")).alias("shift"), F.expr(f"cast(item_at div {window} as int)").alias("block")
    hits = stored(hits.select("row_key", "item_key", shift, block).distinct(), "seed-hits")

    keys = stored(bitmap(hits.select("row_key").distinct(), "row_key", bits), "hit-bits")
    suspects = possibly_in(rows, "row_key", keys, bits).select("doc_id", "row_key", word_hashes(F.col("body")).alias("hashes"))
    words_of = F.broadcast(items) if few else items
    around = suspects.join(hits, "row_key").join(words_of, "item_key")
    matched = best_window(F.col("hashes"), F.col("item_words"), F.col("shift"), F.col("block"), window)
    found = around.select("doc_id", "item_id", matched.alias("matched"), width.alias("width"))
    close = found.filter(100 * F.col("matched") >= percent * F.col("width"))
    return close.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("width").cast("long").alias("width"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 20, percent: int = 80, bits: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; all columns stay as they are.

    Leaking rows are told by id and text. Rows surely not among them are not shuffled.
    """
    keyed = docs.select(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("row_key"), F.col(f"`{text}`").alias("body"))
    bad = stored(leaks(keyed, benchmark, window, percent, doc_id="row_key", text="body").select(F.col("doc_id").alias("row_key")).distinct(), "leaks")
    keys = stored(bitmap(bad, "row_key", bits), "leak-bits")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("row_key"))
    passed = possibly_in(rows, "row_key", keys, bits, keep=False).select("row")
    cleared = possibly_in(rows, "row_key", keys, bits).join(bad, "row_key", "left_anti").select("row")
    return passed.unionByName(cleared).select("row.*")
