"""Exact nearest vectors by cosine through inverted lists.

Vectors of length one lie in the list of their nearest centroid. Distances between them obey the triangle
inequality, so a list whose centroid is farther from the query than the k-th best distance plus the
list's radius holds nothing better, and neither does a vector whose own distance to the centroid
differs too much. Lists that may hold something are searched; the result is that of a full search.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from speechmill.operators.incremental import unit
from speechmill.operators.rollups import top_k
from speechmill.session import kept

# The search function travels with the plan, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most lists, vectors of a list that meet a task together, queries that meet them together.
LISTS, PART_VECTORS, SHELF_QUERIES = 256, 1 << 16, 1 << 15
#: Queries and vectors compared by one product.
TILE_QUERIES, TILE_VECTORS = 256, 4096
#: Squared distances closer than this are taken as equal: similarities are compared in nine digits.
SLACK = 1e-8
#: The list of vectors of length zero; its radius lets every query in.
ZERO, EVERYWHERE = -1, 4.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _distance(similarity: Column) -> Column:
    return F.sqrt(F.greatest(2 - 2 * similarity, F.lit(0.0)))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    values = pa.concat_arrays(c.flatten() for c in table.column(name).chunks)
    return values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(table), -1)


def _best(queries: pa.Table, vectors: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of vectors and similarities of each query's ``k`` best, by nine digits and then by the row of the vector.

    Left out are vectors whose distance to the centroid differs too much from the query's, and those below the query's limit.
    """
    q, u = _matrix(queries, "q"), _matrix(vectors, "u")
    far, limit, zero = (queries.column(c).to_numpy() for c in ("far", "limit", "zero"))
    away = vectors.column("away").to_numpy().astype(float)
    found = []
    for i in range(0, len(q), TILE_QUERIES):
        tile = slice(i, i + TILE_QUERIES)
        most, reach = limit[tile, None], np.sqrt(limit[tile, None])
        rows, places, ranked, scores = [], [], [], []
        for j in range(0, len(u), TILE_VECTORS):
            gone = away[None, j : j + TILE_VECTORS]
            near = np.isnan(gone) | zero[tile, None] | (np.abs(far[tile, None] - gone) <= reach)
            if not near.any():
                continue
            s = q[tile] @ u[j : j + TILE_VECTORS].T
            near &= 2 - 2 * s <= most
            if k < s.shape[1] and near.sum() > 8 * k * len(s):
                # What is below a query's k-th best by more than the rounding cannot be among its best.
                near &= s >= np.partition(np.where(near, s, -np.inf), -k, axis=1)[:, -k, None] - 2e-9
            a, b = np.nonzero(near)
            s = s[a, b]
            # Smaller is better; a vector's row breaks ties. Of each tile, only a query's k best go on.
            order = np.lexsort((b, -np.rint(s * 1e9), a))
            a, b, s = a[order], b[order], s[order]
            first = _places(a) < k
            rows.append(a[first])
            places.append(b[first] + j)
            scores.append(s[first])
        if rows:
            a, b, s = np.concatenate(rows), np.concatenate(places), np.concatenate(scores)
            order = np.lexsort((b, -np.rint(s * 1e9), a))
            order = order[_places(a[order]) < k]
            found.append((a[order] + i, b[order], s[order]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _places(groups: np.ndarray) -> np.ndarray:
    """Place of each row in its group; rows of a group follow one another."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, np.int64)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


class VectorIndex:
    """``entries`` (list, key, u, away) and ``lists`` (list, centroid, radius, n) in the shared folder."""

    def __init__(self, entries: DataFrame, lists: DataFrame):
        self.entries, self.lists = entries, lists

    @classmethod
    def build(cls, vectors: DataFrame, key: str, vector: str = "embedding", lists: int = LISTS) -> VectorIndex:
        """Centroids are ``lists`` vectors drawn by hash; every vector is filed. Null vectors are left out."""
        rows = vectors.select(F.col(key).alias("key"), unit(F.col(vector)).alias("u")).filter(F.col("u").isNotNull())
        rows = rows.withColumn("zero", ~F.exists("u", lambda x: x != 0))
        drawn = rows.filter("not zero").orderBy(F.xxhash64("key"), "key").limit(lists)
        gathered = drawn.agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("key").alias("h"), "u"))).alias("c"))
        # A table of fixed size, read by every task.
        centroids = kept(gathered.select(F.posexplode(F.col("c.u")).alias("list", "centroid")), "centroids")
        table = centroids.agg(F.sort_array(F.collect_list(F.struct("list", "centroid"))).alias("t")).scalar()
        best = F.array_max(F.transform("t", lambda c: F.struct(dot(F.col("u"), c["centroid"]).alias("s"), (-c["list"]).alias("order"))))
        filed = rows.select("*", table.alias("t")).select("key", "u", F.when(~F.col("zero"), best).alias("best"))
        entries = filed.select(
            F.coalesce(-F.col("best.order"), F.lit(ZERO)).alias("list"),
            "key",
            "u",
            _distance(F.col("best.s")).alias("away"),
        )
        entries = kept(entries, "vector-lists")
        sizes = entries.groupBy("list").agg(F.coalesce(F.max("away"), F.lit(EVERYWHERE)).alias("radius"), F.count(F.lit(1)).alias("n"))
        return cls(entries, kept(sizes.join(centroids, "list", "left"), "vector-list-sizes"))

    def _scored(self, probes: DataFrame, k: int, shelves: int) -> DataFrame:
        """``query, key, similarity``: each query's ``k`` best in every part of the probed lists, within its ``limit``.

        A task holds at most about ``PART_VECTORS`` vectors of a list and ``SHELF_QUERIES`` queries, so the pairs
        that are compared are neither rows nor shuffled.
        """
        parts = F.ceil(F.col("n") / PART_VECTORS).cast("int")
        # One row a list.
        sized = self.entries.join(F.broadcast(self.lists.select("list", "n")), "list")
        vectors = sized.withColumn("part", F.pmod(F.xxhash64("key", "u"), parts).cast("int")).withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
        queries = probes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("shelf", F.pmod(F.xxhash64("query"), F.lit(shelves)).cast("int"))

        def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
            if not len(queries) or not len(vectors):
                return pa.table({"query": queries.column("query").slice(0, 0), "key": vectors.column("key").slice(0, 0), "similarity": pa.array([], pa.float64())})
            vectors = vectors.sort_by("key")
            at, place, similarity = _best(queries, vectors, k)
            return pa.table({"query": queries.column("query").take(pa.array(at)), "key": vectors.column("key").take(pa.array(place)), "similarity": similarity})

        groups = ["list", "part", "shelf"]
        left = queries.select(*groups, "query", "q", "zero", "far", F.col("limit").cast("double").alias("limit")).groupBy(*groups)
        right = vectors.select(*groups, "key", "u", "away").groupBy(*groups)
        schema = StructType([probes.schema["query"], self.entries.schema["key"], StructField("similarity", DoubleType())])
        return left.cogroup(right).applyInArrow(best, schema)

    def nearest(self, queries: DataFrame, query: str, vector: str = "embedding", k: int = 5) -> DataFrame:
        """``query, key, similarity, rank``: the ``k`` most similar vectors of any number of queries, ties by key.

        First the nearest lists that hold ``k`` vectors give a distance that is reached; then all lists
        that may come below it are searched. ``query`` tells queries apart; null vectors find nothing.
        """
        rows = queries.select(F.col(query).alias("query"), unit(F.col(vector)).alias("q")).filter(F.col("q").isNotNull())
        rows = rows.withColumn("zero", ~F.exists("q", lambda x: x != 0))
        shelves = max(1, -(-rows.count() // SHELF_QUERIES))
        table = self.lists.agg(F.collect_list(F.struct("list", "radius", "n", "centroid"))).scalar()
        each = rows.select("query", "q", "zero", F.explode(table).alias("l")).select("query", "q", "zero", "l.*")
        far = F.coalesce(_distance(dot(F.col("q"), F.col("centroid"))), F.lit(0.0))
        # One row for each query and list; their number does not depend on the vectors.
        met = kept(each.select("query", "q", "zero", "list", "radius", "n", far.alias("far")), "query-lists")
        before = Window.partitionBy("query").orderBy("far", "list").rowsBetween(Window.unboundedPreceding, -1)
        first = met.withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("held") < k)
        reached = top_k(self._scored(first.withColumn("limit", F.lit(EVERYWHERE * EVERYWHERE)), k, shelves), ["query"], [F.desc("similarity"), F.asc("key")], k)
        limits = kept(reached.groupBy("query").agg((2 - 2 * F.min("similarity") + SLACK).alias("limit")), "query-limits")
        lowest = F.greatest(F.col("far") - F.col("radius"), F.lit(0.0))
        open_ = met.join(limits, "query").filter(F.col("zero") | (F.col("list") == ZERO) | (lowest * lowest <= F.col("limit")))
        return top_k(self._scored(open_, k, shelves), ["query"], [F.desc(F.round("similarity", 9)), F.asc("key")], k)
