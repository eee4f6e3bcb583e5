"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles; its sketch keeps the ``k``
smallest. Inverted lists of retained values generate candidates, the union sketch of a candidate
pair estimates its similarity, and the exact Jaccard similarity of the whole sets confirms it.

Equal sets are one class throughout, so exact copies cost nothing beyond the first. Within a class
of links only the components count, which keeps large groups linear: first every list is compared with
one hub. Members of lists that this leaves in several components get lists once more, now from their
whole sets, where rare values come first and far fewer places suffice. There one member of each
component of a list is compared with a hub drawn anew each turn, and linked components become one, as
long as that gains; then the smaller components of a list are compared with all members of other
components. No list is cut short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmill.llm.common import bitmap, possibly_in, stored

CACHED_WORDS = 150_000
#: Rows that a task holds the sets of at once.
ROWS_AT_ONCE = 256
#: Buckets of the table that orders values by how common they are, as a power of two.
ORDER_BITS = 20
#: 64-bit words of a set's parity bits.
PARITY = 8
#: Turns of comparing components through hubs, at most, and the share of open entries above which the exact
#: comparison takes over. Both change the work only: what hubs leave open is compared in full.
HUB_ROUNDS, LEAST_GAIN = 12, 0.8


class Shingler:
    """Hash sets of texts: A-Z lower-cased, words between spaces and the control characters 9 to 13."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}
        # Odd 64-bit factors; one for each place of a word in its shingle.
        self.factors = np.array([xxhash.xxh3_64_intdigest(b"place %d" % i) | 1 for i in range(words)], dtype=np.uint64)

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; fewer words than a shingle has are one shingle."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.int64)
        hashes = self._word_hashes(words)
        width = min(self.words, len(words))
        n = len(words) - width + 1
        mixed = np.full(n, np.uint64(width), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                mixed += hashes[i : i + n] * self.factors[i]
            for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9FB21C651E98DF25)):
                mixed ^= mixed >> np.uint64(shift)
                mixed *= np.uint64(factor)
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed.view(np.int64))


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("body"), F.xxhash64(F.col(doc_id).cast("long"), text).alias("row_key"))


def sketches(docs: DataFrame, k: int, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row_key, n_shingles, digest`` and ``sketch`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in _slices(batches):
            sizes, digests, kept = [], [], []
            for body in batch.column(1):
                values = shingler(body.as_py())
                sizes.append(len(values))
                digests.append(_digest(values))
                kept.append(values[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(kept)],
                names=["doc_id", "row_key", "n_shingles", "digest", "sketch"],
            )

    schema = "doc_id long, row_key long, n_shingles long, digest binary, sketch array<long>"
    return _rows(docs, doc_id, text).mapInArrow(run, schema)


def full_sets(docs: DataFrame, keys: DataFrame, words: int, bits: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``digest, members`` of the documents whose row key is in ``keys``; others may pass too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in _slices(batches):
            sets = [shingler(body.as_py()) for body in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), _lists(sets)], names=["digest", "members"])

    wanted = possibly_in(_rows(docs, doc_id, text), "row_key", keys, bits)
    return wanted.select("body").mapInArrow(run, "digest binary, members array<long>")


def least_overlap(k: int, threshold: float, deviations: float = 5.0) -> int:
    """Retained values that two sketches of size ``k`` share at the threshold, less five deviations.

    The chance that a pair at the threshold shares fewer is about one in a million.
    """
    return max(1, math.floor(k * threshold - deviations * math.sqrt(k * threshold * (1 - threshold))))


def inverted_lists(classes: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """``value, digest, n, shared`` for the rarest retained values of each class, singletons left out.

    If two sketches share at least ``m`` values, the rarest ``size - m + 1`` of either have one in
    common, for any common order of values; rarest first keeps common passages out of the lists.
    A set below the sketch size is retained whole, so its overlap with a similar one is exact.
    ``shared`` counts the class's retained values that occur elsewhere.
    """
    share = least_overlap(k, percent / 100)
    values = classes.select("digest", F.col("n_shingles").alias("n"), F.explode("sketch").alias("value"))
    frequency = stored(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "near-frequency")
    # Most values occur once and are left out before anything is shuffled.
    known = stored(bitmap(frequency, "value", bits), "near-value-bits")
    shared = possibly_in(values, "value", known, bits).join(frequency, "value")
    shared = shared.groupBy("digest", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("ranked"))
    size = F.least(F.col("n"), F.lit(k))
    needed = F.least(F.lit(share), F.ceil(size * percent / 100))
    # Values of one document alone come first in the order and match nothing.
    room = size - needed + 1 - (size - F.size("ranked"))
    entries = shared.select("digest", "n", F.size("ranked").alias("shared"), F.slice("ranked", 1, F.greatest(room, F.lit(0)).cast("int")).alias("ranked"))
    return entries.select("digest", "n", "shared", F.explode(F.col("ranked.value")).alias("value"))


def bucket_counts(sets: DataFrame, bits: int) -> np.ndarray:
    """How often values of each bucket occur; a table of fixed size, whatever the number of sets."""
    bucket = F.col("value").bitwiseAND(F.lit((1 << bits) - 1))
    found = sets.select(F.explode("members").alias("value")).groupBy(bucket.cast("int").alias("bucket")).count().toArrow()
    counts = np.zeros(1 << bits, dtype=np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("count").to_numpy()
    return counts


def exact_lists(sets: DataFrame, percent: int, bits: int) -> DataFrame:
    """``value, digest, n, at, p0, ...``: the first values of each whole set, those of rare buckets first.

    Sets of sizes n and m at the threshold share at least ``percent / (100 + percent) * (n + m)``
    values, so among the first ``n - that + 1`` of either is a common one. A list holds what the
    smallest possible partner needs; ``at`` lets a pair use what its own sizes need. The words ``p0`` and on
    tell of each bit whether an odd number of values falls on it: two sets differ in at least
    as many values as in bits.
    """
    parity = [f"p{i}" for i in range(PARITY)]
    shared = sets.sparkSession.sparkContext.broadcast(bucket_counts(sets, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for digest, members in zip(batch.column(0), batch.column(1), strict=True):
                values = members.values.to_numpy()
                n = len(values)
                first = values[np.lexsort((values, counts[values & (len(counts) - 1)]))][: n - -(-n * percent // 100) + 1]
                odd = np.bincount((values >> 20) & (64 * PARITY - 1), minlength=64 * PARITY).astype(np.uint8) & 1
                columns = [pa.array(first), pa.array([digest.as_py()] * len(first), pa.binary()), pa.array([n] * len(first), pa.int64()), pa.array(np.arange(1, len(first) + 1))]
                columns += [pa.array([w] * len(first), pa.int64()) for w in np.packbits(odd).view(np.int64).tolist()]
                yield pa.RecordBatch.from_arrays(columns, names=["value", "digest", "n", "at", *parity])

    return sets.select("digest", "members").mapInArrow(run, "value long, digest binary, n long, at long, " + ", ".join(f"{p} long" for p in parity))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct unordered pairs whose sizes allow the threshold."""
    sized = rows.filter("a != b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that pass the union-sketch estimate and then the exact similarity."""
    sketch = classes.select("digest", "sketch")
    both = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    met = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    t = percent / 100
    likely = met >= F.size(union) * t - 5 * F.sqrt(F.size(union) * t * (1 - t))
    close = both.filter(likely).select("a", "b")
    full = close.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b")
    shared = F.size(F.array_intersect("ma", "mb"))
    counted = full.select("a", "b", shared.alias("shared"), (F.size("ma") + F.size("mb")).alias("total"))
    return counted.filter(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``digest, root`` for every node of ``links`` (a, b): contraction to the least neighbour.

    Every round hooks a node to its neighbour (or itself) of least rank and contracts the graph;
    ranks are drawn anew each round, so chains shrink by a constant share too.
    """
    edges, labels, turn = links.select("a", "b"), None, 0
    while True:
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.least(F.min(rank("b")), rank("a"))["v"].alias("to")), "near-hooks")
        if labels is None:
            labels = hooks.toDF("digest", "root")
        else:
            moved = labels.join(hooks.toDF("root", "to"), "root", "left")
            labels = moved.select("digest", F.coalesce("to", "root").alias("root"))
        to = lambda c, n: hooks.toDF(c, n)
        edges = stored(
            edges.join(to("a", "x"), "a").join(to("b", "y"), "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "near-edges",
        )
        if edges.isEmpty():
            return stored(labels, "near-labels")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``digest, root`` after components that ``links`` join became one."""
    name = lambda c, r: roots.select(F.col("digest").alias(c), F.col("root").alias(r))
    between = links.join(name("a", "x"), "a").join(name("b", "y"), "b").filter("x != y")
    joined = components(stored(between.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "near-between"))
    moved = roots.join(joined.toDF("root", "to"), "root", "left")
    return moved.select("digest", F.coalesce("to", "root").alias("root"))


def _open(lists: DataFrame, roots: DataFrame, settled: int = 2) -> DataFrame:
    """Entries of lists that hold several components, lists of ``settled`` entries left out."""
    placed = stored(lists.join(roots, "digest"), "near-entries")
    several = placed.groupBy("value").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    return stored(placed.join(several.filter(f"c > {settled} and low != high").select("value"), "value", "left_semi"), "near-open")


def _side(entries: DataFrame, x: str) -> DataFrame:
    """Entries of exact lists as the side ``a`` or ``b`` of pairs."""
    words = [F.col(f"p{i}").alias(f"p{x}{i}") for i in range(PARITY)]
    return entries.select("value", F.col("digest").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"), F.col("at").alias(f"at_{x}"), *words)


def _may_link(percent: int) -> Column:
    """Whether the sizes, places and parity bits of a pair of different components allow the threshold."""
    least = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    within = (F.col("at_a") <= F.col("na") - least + 1) & (F.col("at_b") <= F.col("nb") - least + 1)
    differ = F.bit_count(F.col("pa0").bitwiseXOR(F.col("pb0")))
    for i in range(1, PARITY):
        differ = differ + F.bit_count(F.col(f"pa{i}").bitwiseXOR(F.col(f"pb{i}")))
    return (F.col("ra") != F.col("rb")) & within & (differ <= F.col("na") + F.col("nb") - 2 * least)


def _hub_pairs(open_: DataFrame, turn: int, percent: int) -> DataFrame:
    """The first member of each component of a list with the list's hub of this turn.

    A member that holds fewer rarer values before the list's own comes closer to all others of the list,
    so it speaks for its component. The hub is the first of them all, in later turns one drawn by hash;
    lists with the same members have the same hub, so a group of g classes gives about g pairs a turn.
    """
    place = F.struct("at", "n", "digest")
    entry = F.struct(*open_.columns)
    own = open_.groupBy("value", "root").agg(F.min_by(entry, place).alias("own")).select("own.*")
    drawn = place if turn == 1 else F.struct(F.xxhash64("digest", F.lit(turn)), "digest")
    hub = own.groupBy("value").agg(F.min_by(entry, drawn).alias("hub")).select("hub.*")
    return _side(own, "a").join(_side(hub, "b"), "value").filter(_may_link(percent))


def linked_classes(docs: DataFrame, rows: DataFrame, k: int, percent: int, words: int, bits: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The links between classes of equal sets, and their components."""
    first = F.min(F.struct("doc_id", "row_key"))["row_key"].alias("row_key")
    classes = rows.filter("n_shingles > 0").groupBy("digest", "n_shingles", "sketch").agg(first)
    lists = stored(inverted_lists(classes, k, percent, bits), "near-lists")
    listed = stored(classes.join(lists.select("digest").distinct(), "digest", "left_semi"), "near-classes")
    keys = stored(bitmap(listed, "row_key", bits), "near-bitmap")
    sets = full_sets(docs, keys, words, bits, doc_id, text).groupBy("digest").agg(F.first("members").alias("members"))
    sets = stored(sets.join(listed.select("digest"), "digest", "left_semi"), "near-sets")

    # The hub is the most ordinary member: most of its values occur elsewhere.
    hub = lists.groupBy("value").agg(F.min(F.struct((-F.col("shared")).alias("r"), "digest", "n")).alias("hub"))
    star = lists.join(hub, "value").select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("hub.digest").alias("b"), F.col("hub.n").alias("nb"))
    tested = stored(_pairs(star, percent), "near-pairs")
    links = stored(_confirmed(tested, listed, sets, k, percent), "near-links")
    roots = stored(_merged(listed.select("digest", F.col("digest").alias("root")), links), "near-placed")
    left = _open(lists, roots).groupBy("digest").agg(F.first("root").alias("root"))
    left = stored(left, "near-unsettled")
    exact = exact_lists(stored(sets.join(left.select("digest"), "digest", "left_semi"), "near-unsettled-sets"), percent, ORDER_BITS)
    exact = stored(exact, "near-exact-lists")
    open_ = _open(exact, roots, 1)
    for turn in range(1, HUB_ROUNDS + 1):
        before = open_.select("value", "root").distinct().count()
        if not before:
            break
        fresh = stored(_pairs(_hub_pairs(open_, turn, percent), percent).join(tested, ["a", "b"], "left_anti"), "near-pairs")
        found = stored(_confirmed(fresh, listed, sets, k, percent), "near-links")
        tested, links = tested.unionByName(fresh), links.unionByName(found)
        if found.isEmpty():
            break
        roots = stored(_merged(roots, found), "near-placed")
        open_ = _open(exact, roots, 1)
        if open_.select("value", "root").distinct().count() > LEAST_GAIN * before:
            break
    # The smaller components of a list against all members of others; the largest is settled within itself.
    by_root = open_.groupBy("value", "root").count().groupBy("value")
    main = by_root.agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    rest = _side(open_.join(main, "value").filter("root != main"), "a")
    across = stored(rest, "near-rest").join(_side(open_, "b"), "value").filter(_may_link(percent))
    late = stored(_pairs(across, percent).join(tested, ["a", "b"], "left_anti"), "near-late")
    links = links.unionByName(stored(_confirmed(late, listed, sets, k, percent), "near-late-links"))
    return links, components(links)


def near_groups(
    docs: DataFrame, percent: int = 80, words: int = 5, k: int = 32, bits: int = 24, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``, and ``row_key``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets; a group is
    what links reach, named after its smallest doc_id. Null and empty texts and texts without words
    have an empty set and stand alone. Of equal rows (same id and text) one is kept. A null id is
    smaller than none: it names a group only of null ids. An empty table gives an empty result.
    """
    return _placed(docs, percent, words, k, bits, doc_id, text).drop("first_key")


def _placed(docs: DataFrame, percent: int, words: int, k: int, bits: int, doc_id: str, text: str) -> DataFrame:
    """``near_groups`` and ``first_key``, the key of the first row of the group by (doc_id, row_key)."""
    rows = stored(sketches(docs, k, words, doc_id, text), "near-sketches")
    _, roots = linked_classes(docs, rows, k, percent, words, bits, doc_id, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    least = rows.filter("n_shingles > 0").groupBy("digest").agg(first)
    rooted = least.join(roots, "digest", "left").select("digest", "first", F.coalesce("root", "digest").alias("root"))
    rooted = stored(rooted, "near-roots")
    # Only linked classes need a look at their component; the rest are one already.
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = named.select("root", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("first_key"))
    classes = stored(rooted.join(named, "root").select("digest", "component_id", "first_key"), "near-names")
    copies = rows.groupBy("doc_id", "row_key", "digest", "n_shingles").count()
    placed = copies.join(classes, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    each = placed.select("doc_id", "row_key", "n_shingles", F.coalesce("first_key", "row_key").alias("first_key"), component.alias("component_id"), F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "row_key", "first_key")


def keep_one_of_each(docs: DataFrame, percent: int = 80, words: int = 5, k: int = 32, bits: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates; all columns stay as they are.

    Of several rows with the group's smallest id, or of a group whose ids are all null, the one with
    the smallest row key stays.
    Rows that are surely not dropped (their key is in no bitmap of dropped rows) are not shuffled.
    """
    one = (F.col("kept") & (F.col("row_key") == F.col("first_key"))).alias("kept")
    groups = stored(_placed(docs, percent, words, k, bits, doc_id, text).select("row_key", one), "near-groups")
    dropped = groups.groupBy("row_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1")
    dropped = stored(dropped, "near-dropped")
    keys = stored(bitmap(dropped, "row_key", bits), "near-dropped-bits")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).alias("row_key"))
    passed = possibly_in(rows, "row_key", keys, bits, keep=False).select("row")
    suspects = possibly_in(rows, "row_key", keys, bits).join(dropped.select("row_key", "kept"), "row_key", "left")
    stay = suspects.filter("kept is null").select("row")
    repeated = suspects.filter("kept").groupBy("row_key").agg(F.min("row").alias("row")).select("row")
    return passed.unionByName(stay).unionByName(repeated).select("row.*")
