"""What changed since the last run, keyed upserts and deletes, and stored vectors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechmill.functions.expr import let
from speechmill.operators.rollups import top_k


def run_version(at: datetime) -> str:
    """Version text of a run. The caller fixes the time, so that a repeated run keeps its version."""
    return at.strftime("analysis-%Y%m%d%H%M%S")


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's columns in name order, nulls told apart from empty text."""
    parts = []
    for name in sorted(columns):
        parts += [F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit("\u0000"))]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def session_digests(df: DataFrame, session: str, columns: Sequence[str]) -> DataFrame:
    """One digest per session over all its rows.

    The four 64-bit words of the row hashes are added up exactly, so the digest is formed by
    partial sums like any count: no session is ever collected or sorted in one place. Row order is
    part of the content when ``columns`` hold the file and order columns.
    """
    hashed = df.select(session, row_hash(columns).alias("_h"))

    def word(i: int) -> Column:
        return F.conv(F.substring("_h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")

    sums = hashed.groupBy(session).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(word(i)).cast("decimal(38,0)").alias(f"_w{i}") for i in range(4)]
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(4)])
    return sums.select(session, "rows", F.sha2(text, 256).alias("hash_digest"))


def sessions_to_process(
    incoming: DataFrame, stored: DataFrame, version: str, session: str = "session_name", force: bool = False
) -> DataFrame:
    """Incoming sessions with the reason to process them, or ``unchanged``."""
    old = stored.select(
        session, F.col("hash_digest").alias("_hash"), F.col("analysis_version").alias("_version"), F.lit(True).alias("_known")
    )
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("_known").isNull(), "new")
        .when(F.coalesce(F.col("hash_digest"), F.lit("")) == "", "no_hash")
        .when(~F.col("hash_digest").eqNullSafe(F.col("_hash")), "content_changed")
        .when(~F.col("_version").eqNullSafe(F.lit(version)), "version_changed")
        .otherwise("unchanged")
    )
    return incoming.join(old, session, "left").select(incoming[session], "hash_digest", reason.alias("reason"))


def changed_rows(df: DataFrame, worklist: DataFrame, session: str = "session_name") -> DataFrame:
    """Rows of the sessions to process; every later stage runs once with the session as a key."""
    names = worklist.filter(F.col("reason") != "unchanged").select(session)
    return df.join(names, session, "left_semi")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace stored rows of the same key; other stored rows stay."""
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def delete_keys(existing: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return existing.join(keys.select(*on), list(on), "left_anti")


def delete_where(existing: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or unknown."""
    return existing.filter(~F.coalesce(condition, F.lit(False)))


def in_session(metadata: Column, session_name: str) -> Column:
    """Whether a JSON metadata text belongs to a session."""
    return F.get_json_object(metadata, "$.session_name") == session_name


def session_record(table: DataFrame, session_name: str) -> DataFrame:
    return table.filter(F.col("session_name") == session_name).limit(1)


def agenda_ids(table: DataFrame, session_id: str) -> DataFrame:
    return table.filter(F.col("session_id") == session_id).select("agenda_id")


def attach_vectors(rows: DataFrame, vectors: DataFrame, on: str = "content_hash", vector: str = "embedding") -> DataFrame:
    """Rows with the stored vector of their content; of several vectors of one content the smallest."""
    one = vectors.groupBy(on).agg(F.min(vector).alias(vector))
    return rows.join(one, on, "left")


def missing_vectors(rows: DataFrame, vectors: DataFrame, on: str = "content_hash") -> DataFrame:
    """Hashes of the contents still without a stored vector, each once; copies collapse before the shuffle."""
    return rows.select(on).distinct().join(vectors.select(on), on, "left_anti")


def unit(vector: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    return let(
        wide,
        lambda v: let(
            F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)),
            lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))),
        ),
    )


def query_list(queries: DataFrame, query: str, vector: str = "embedding", limit: int = 1000) -> Column:
    """A small table of query vectors as one array; more than ``limit`` of them is an error."""
    gathered = queries.limit(limit + 1).agg(
        F.collect_list(F.struct(F.col(query).alias("query"), unit(F.col(vector)).alias("v"))).alias("q")
    )
    checked = gathered.select(
        F.when(F.size("q") <= limit, F.col("q")).otherwise(F.raise_error(F.lit(f"more than {limit} query vectors")))
    )
    return checked.scalar()


def nearest(vectors: DataFrame, queries: Column, key: str, vector: str = "embedding", k: int = 5) -> DataFrame:
    """Rows most similar to each query vector by cosine.

    ``queries`` comes from :func:`query_list`. The vectors are read once and never shuffled as a
    whole: each task keeps its best ``k`` rows per query.
    """
    scored = vectors.select(key, unit(F.col(vector)).alias("_u")).select(key, "_u", F.explode(queries).alias("_q"))
    dot = F.aggregate(F.zip_with("_u", F.col("_q.v"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    rows = scored.select(F.col("_q.query").alias("query"), key, dot.alias("similarity"))
    return top_k(rows, ["query"], [F.desc(F.round("similarity", 9)), F.asc(key)], k)
