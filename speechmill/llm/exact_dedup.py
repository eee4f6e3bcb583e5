"""Exact deduplication over an extendible-hash index on shared files.

Every text has a 64-bit key. The directory has a slot for each key prefix of its depth and names the
bucket of that slot; a bucket with more distinct keys than its capacity is split, and the directory
doubles when it has to. Every key enters the index. The buckets are laid out as key ranges, each with
one owner task: it chains the texts that share a key, compares their bytes with those before them in
the chain, and writes one entry per text. Rows find their entry by bucket, key and digest. Copies are
reduced inside each task, and then by salted groups, before they reach their owner; a text whose key is
its own sends an entry there but not its bytes, as there is nothing to compare them with.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmill.llm.common import bitmap, possibly_in, shared_path, stored

#: Copies of one text reach their owner task in at most this many partial groups.
SALTS = 64


def normalised(text: Column) -> Column:
    """Texts are compared unchanged; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def prefix(depth: int) -> Column:
    """The first ``depth`` bits of the key."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned("key", 64 - depth)


def directory(keys: DataFrame, capacity: int, max_depth: int) -> list[tuple[int, int]]:
    """Buckets as (depth, prefix), none with more than ``capacity`` distinct keys unless at ``max_depth``.

    ``keys`` has distinct keys. They are counted once, by their prefixes at ``max_depth``: the driver sees
    at most ``2 ** max_depth`` counts, never keys. Each round doubles the directory for the overfull buckets.
    """
    counted = keys.groupBy(prefix(max_depth).alias("p")).count().collect()
    filled = [Counter() for _ in range(max_depth + 1)]
    for row in counted:
        for depth in range(max_depth + 1):
            filled[depth][row["p"] >> (max_depth - depth)] += row["count"]
    buckets, overfull, depth = [], [0], 0
    while overfull:
        split = [p for p in overfull if depth < max_depth and filled[depth][p] > capacity]
        buckets += [(depth, p) for p in overfull if p not in set(split)]
        overfull, depth = [2 * p + side for p in split for side in (0, 1)], depth + 1
    return sorted(buckets)


def bucket_of(buckets: list[tuple[int, int]]) -> Column:
    """Number of the bucket that holds the key, in key order: the directory slot of the key's prefix.

    The directory is one constant array of at most ``2 ** max_depth`` numbers.
    """
    order = sorted(buckets, key=lambda b: b[1] / (1 << b[0]))
    deepest = max(d for d, _ in buckets)
    slots = [str(n) for n, (d, _) in enumerate(order) for _ in range(1 << (deepest - d))]
    return F.get(F.split(F.lit(",".join(slots)), ",").cast("array<int>"), prefix(deepest).cast("int"))


def chained(reduced: DataFrame) -> DataFrame:
    """Entries ``bucket, key, link, sha256, keep_id, group_size`` of the texts that share a key, made by the owner tasks.

    ``reduced`` has ``bucket, key, body, keep_id, group_size``, a text in several partial groups. An owner task
    holds a range of (bucket, key). Along a key's texts in byte order, each is compared with the one before;
    where the bytes differ the chain grows by a link.
    """
    owned = reduced.repartitionByRange("bucket", "key")
    chain = Window.partitionBy("bucket", "key").orderBy("body")
    differs = F.coalesce(F.col("body") != F.lag("body").over(chain), F.lit(True))
    linked = owned.select("bucket", "key", "keep_id", "group_size", F.unhex(F.sha2("body", 256)).alias("sha256"), differs.alias("differs"), "body")
    numbered = linked.withColumn("link", F.sum(F.col("differs").cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy("bucket", "key", "link", "sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


class Index:
    """What the dedup wrote: the key log, the repeated keys as a bitmap, the directory and the entries of all keys."""

    def __init__(
        self, docs: DataFrame, doc_id: str, text: str, capacity: int, max_depth: int, bits: int, key: Callable[[Column], Column] = F.xxhash64
    ):
        self.bits = bits
        body = normalised(F.col(text))
        texts = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), key(body).alias("key"))
        self.log = stored(texts.select("doc_id", "key", F.unhex(F.sha2("body", 256)).alias("sha256")), "dedup-log")
        # A key of one row is its entry already.
        keys = self.log.groupBy("key").agg(F.max("sha256").alias("sha256"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        keys = stored(keys, "dedup-keys")
        self.bitmap = stored(bitmap(keys.filter("group_size > 1"), "key", bits), "dedup-bitmap")
        self.buckets = directory(keys, capacity, max_depth)
        self.bucket = bucket_of(self.buckets)
        # A hot text is one row of each task before this shuffle, and of each salt after it.
        salted = possibly_in(texts, "key", self.bitmap, bits).withColumn("salt", F.spark_partition_id() % SALTS)
        reduced = salted.groupBy("key", "body", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        chains = chained(reduced.drop("salt").withColumn("bucket", self.bucket))
        alone = possibly_in(keys, "key", self.bitmap, bits, keep=False).select(
            self.bucket.alias("bucket"), "key", F.lit(1).alias("link"), "sha256", "keep_id", "group_size"
        )
        self.path = shared_path(docs.sparkSession, "dedup-index")
        entries = chains.unionByName(alone).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "link")
        entries.write.parquet(self.path)
        self.entries = docs.sparkSession.read.schema(entries.schema).parquet(self.path)

    def lookup(self) -> DataFrame:
        """The entries that rows have to look up: those of repeated keys."""
        return possibly_in(self.entries, "key", self.bitmap, self.bits)

    def groups(self) -> DataFrame:
        """``doc_id, sha256, keep_id, group_size, copy`` for every row; ``copy`` numbers equal rows."""
        # The entry of a key without a second row is the row's result.
        alone = possibly_in(self.entries, "key", self.bitmap, self.bits, keep=False).select(
            F.col("keep_id").alias("doc_id"), "sha256", "keep_id", "group_size", F.lit(1).alias("copy")
        )
        rows = possibly_in(self.log, "key", self.bitmap, self.bits).groupBy("key", "sha256", "doc_id").count().withColumn("bucket", self.bucket)
        known = rows.join(self.lookup(), ["bucket", "key", "sha256"])
        each = F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy")
        return known.select("doc_id", "sha256", "keep_id", "group_size", each).unionByName(alone)


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 50_000, max_depth: int = 16, bits: int = 24, key: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; null ids lose to any id and are kept alone
    if the group has no other. Of equal rows (same id and text) one stays. Null text counts as empty.
    An empty table gives an empty result; long texts are compared whole; other columns are ignored, whatever
    their names. ``key`` makes the 64-bit key of a text; results do not depend on it.
    """
    rows = Index(docs, doc_id, text, capacity, max_depth, bits, key).groups()
    return rows.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 50_000, max_depth: int = 16, bits: int = 24, key: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; all columns stay as they are.

    Rows without a repeated key pass without a shuffle.
    """
    index = Index(docs, doc_id, text, capacity, max_depth, bits, key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), key(normalised(F.col(text))).alias("key"))
    passed = possibly_in(rows, "key", index.bitmap, bits, keep=False).select("row")
    suspects = possibly_in(rows, "key", index.bitmap, bits).select(
        "row", "key", F.unhex(F.sha2(normalised(F.col(f"row.`{text}`")), 256)).alias("sha256"), index.bucket.alias("bucket")
    )
    winners = index.lookup().select("bucket", "key", "sha256", "keep_id")
    same = (
        (suspects["bucket"] == winners["bucket"])
        & (suspects["key"] == winners["key"])
        & (suspects["sha256"] == winners["sha256"])
        & suspects[f"row.{doc_id}"].eqNullSafe(winners["keep_id"])
    )
    kept = suspects.join(winners, same, "left_semi").groupBy("key", "sha256").agg(F.min("row").alias("row")).select("row")
    return passed.unionByName(kept).select("row.*")
