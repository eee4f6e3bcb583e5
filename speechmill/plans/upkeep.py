"""Digests, work lists, upserts, deletes and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill.operators import chunks, incremental, retractable
from speechmill.operators.vector_index import VectorIndex
from speechmill.plans import dataset as ds
from speechmill.plans import refresh, scores
from speechmill.plans.scores import r
from speechmill.session import run_folder

DIGEST_COLUMNS = ("session", "meeting_no", "speech_order", "agenda_item_titles", "speech_text")


def digests(spark, sf):
    return incremental.session_digests(ds.texts(spark, sf), "session_name", DIGEST_COLUMNS)


def session_digests(spark, sf):
    return digests(spark, sf)


def worklist(spark, sf):
    """Sessions to process against a store where some are absent, stale or of another version."""
    incoming = digests(spark, sf)
    number = F.regexp_extract("session_name", r"(\d+)", 1).cast("int")
    stored = incoming.filter(number % 4 != 0).select(
        "session_name",
        F.when(number % 4 == 1, F.lit("stale")).otherwise(F.col("hash_digest")).alias("hash_digest"),
        F.when(number % 4 == 2, F.lit("v0")).otherwise(F.lit("v1")).alias("analysis_version"),
    )
    return incremental.sessions_to_process(incoming, stored, "v1")


def sessions_to_process(spark, sf):
    return worklist(spark, sf).select("session_name", "reason")


def changed_speeches(spark, sf):
    rows = ds.texts(spark, sf).select("session_name", "speech_key")
    return incremental.changed_rows(rows, worklist(spark, sf)).groupBy("session_name").agg(
        F.count(F.lit(1)).alias("speeches")
    )


def keyed_upsert(spark, sf):
    stored = ds.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("value"))
    incoming = ds.table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("value"))
    return incremental.upsert(stored, incoming, ["doc_id"])


def keyed_delete(spark, sf):
    stored = ds.table(spark, sf, "documents").select("doc_id", "lang")
    gone = ds.table(spark, sf, "labels").filter(F.col("toxic") == 1)
    return incremental.delete_keys(stored, gone, ["doc_id"])


def stored_chunks(spark, sf):
    rows = ds.texts(spark, sf).select(
        F.col("speech_key").cast("string").alias("source_id"),
        F.col("speech_text").alias("text"),
        F.create_map(F.lit("source_type"), F.lit("transcript"), F.lit("session_name"), F.col("session_name")).alias("metadata"),
    )
    return chunks.rag_rows(chunks.chunk_rows(rows))


def session_chunks_deleted(spark, sf):
    """Chunks left per session after one session's chunks were deleted by their metadata."""
    left = incremental.delete_where(stored_chunks(spark, sf), incremental.in_session(F.col("metadata"), "제418회"))
    return left.groupBy(F.get_json_object("metadata", "$.session_name").alias("session_name")).agg(
        F.count(F.lit(1)).alias("chunks")
    )


def session_lookup(spark, sf):
    return incremental.session_record(digests(spark, sf), "제419회").select("session_name", "rows")


def vectors(spark, sf):
    """Stored vectors by content hash, one per content."""
    named = ds.table(spark, sf, "embeddings").join(
        ds.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.sha2("text", 256).alias("content_hash")),
        "vec_id",
    )
    return named.groupBy("content_hash").agg(F.min_by("embedding", "vec_id").alias("embedding"))


def contents(spark, sf):
    return ds.texts(spark, sf).select("speech_key", F.sha2("speech_text", 256).alias("content_hash"))


def attached_vectors(spark, sf):
    rows = incremental.attach_vectors(contents(spark, sf), vectors(spark, sf))
    return rows.select(
        "speech_key",
        F.when(F.col("embedding").isNull(), 0).otherwise(F.size("embedding")).alias("dims"),
        F.round(F.coalesce(F.get("embedding", F.lit(0)).cast("double"), F.lit(0.0)), 5).alias("first"),
    )


def missing_vectors(spark, sf):
    return incremental.missing_vectors(contents(spark, sf), vectors(spark, sf))


def nearest_to_labels(spark, sf):
    """Vectors nearest to the mean vector of every label."""
    e = ds.table(spark, sf, "embeddings")
    means = (
        e.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))
    )
    found = incremental.nearest(e, incremental.query_list(means, "label"), "vec_id", k=5)
    return found.select(F.col("query").alias("label"), "vec_id", r("similarity"), "rank")


def nearest_by_index(spark, sf):
    """The vectors nearest to every fiftieth vector, through inverted lists."""
    e = ds.table(spark, sf, "embeddings")
    found = VectorIndex.build(e, "vec_id").nearest(e.filter(F.col("vec_id") % 50 == 0), "vec_id", k=5)
    return found.select(F.col("query").alias("asked"), F.col("key").alias("vec_id"), r("similarity"), "rank")


def retracted_topic_rollup(spark, sf):
    """Topic scores of all sessions after an update: some were stored before with fewer speeches, some not at all, and one is gone."""
    root = run_folder(spark, "topic-tables")
    rows, incoming = scores.counted(spark, sf), digests(spark, sf).select("session_name", "hash_digest")
    number = F.regexp_extract("session_name", r"(\d+)", 1).cast("int")
    another = F.lit("제1회").alias("session_name")
    first = rows.filter((number % 4 != 0) & ((number % 4 != 1) | (F.col("speech_key") % 3 != 0)))
    first = first.unionByName(rows.filter(number % 4 == 2).withColumn("session_name", another))
    before = incoming.filter(number % 4 != 0).withColumn("hash_digest", F.when(number % 4 == 1, F.lit("stale")).otherwise(F.col("hash_digest")))
    before = before.unionByName(before.limit(1).select(another, "hash_digest"))
    refresh.update_topics(first, before, root, ds.TOPICS, "v1")
    refresh.update_topics(rows, incoming, root, ds.TOPICS, "v1")
    cells, sums = refresh.topic_table(spark, "topic_cells", root), refresh.topic_table(spark, "topic_totals", root)
    levels = {
        "session": retractable.session_scores(cells),
        "month": retractable.group_scores(sums, ["month"]),
        "party_month": retractable.group_scores(sums, ["month", "party"]),
    }
    out = None
    for level, df in levels.items():
        names = [(F.col(c) if c in df.columns else F.lit("")).alias(c) for c in ("session_name", "month", "party")]
        part = df.select(F.lit(level).alias("level"), *names, "topic", *scores.rounded_scores())
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        session_digests, sessions_to_process, changed_speeches, keyed_upsert, keyed_delete, session_chunks_deleted,
        session_lookup, attached_vectors, missing_vectors, nearest_to_labels, nearest_by_index,
        retracted_topic_rollup,
    )
}

# --- the same in SQL ------------------------------------------------------------------------------

_S = f"WITH {ds.SPEECH_SQL}"
_ROW = " || chr(31) || ".join(
    f"'{c}' || chr(31) || coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(DIGEST_COLUMNS)
)
_WORD = " || ':' || ".join(f"CAST(sum(CAST(('0x' || substring(h, {16 * i + 1}, 16)) AS UBIGINT)) AS VARCHAR)" for i in range(4))
_REASON = """w AS (SELECT session_name, CASE session % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'content_changed' WHEN 2 THEN 'version_changed' ELSE 'unchanged' END AS reason
  FROM (SELECT DISTINCT session_name, session FROM speech))"""
_VEC = """v AS (SELECT sha256(d.text) AS content_hash, arg_min(e.embedding, e.vec_id) AS embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY 1)"""

SQL = {
    # A full recomputation.
    "retracted_topic_rollup": scores.SQL["topic_rollup"],
    "session_digests": f"""{_S}, x AS (SELECT session_name, sha256({_ROW}) AS h FROM speech)
SELECT session_name, count(*) AS rows, sha256(count(*) || ':' || {_WORD}) AS hash_digest FROM x GROUP BY session_name""",
    "sessions_to_process": f"{_S}, {_REASON} SELECT * FROM w",
    "changed_speeches": f"{_S}, {_REASON} SELECT session_name, count(*) AS speeches FROM speech JOIN w USING (session_name) WHERE reason <> 'unchanged' GROUP BY 1",
    "keyed_upsert": "SELECT d.doc_id, coalesce('q' || l.quality, d.lang) AS value FROM documents d LEFT JOIN labels l USING (doc_id)",
    "keyed_delete": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "session_chunks_deleted": f"""{_S}, t AS (SELECT session_name, length({ds.strip_sql('speech_text')}) AS n FROM speech WHERE session_name <> '제418회')
SELECT session_name, CAST(sum(CASE WHEN n = 0 THEN 0 WHEN n <= 800 THEN 1 ELSE (n - 1) // 700 + 1 END) AS BIGINT) AS chunks FROM t GROUP BY 1""",
    "session_lookup": f"{_S} SELECT session_name, count(*) AS rows FROM speech WHERE session_name = '제419회' GROUP BY 1",
    "attached_vectors": f"""WITH {_VEC} SELECT doc_id AS speech_key, coalesce(len(embedding), 0) AS dims, round(coalesce(CAST(embedding[1] AS DOUBLE), 0), 5) AS first
FROM documents LEFT JOIN v ON v.content_hash = sha256(text)""",
    "missing_vectors": f"WITH {_VEC} SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT content_hash FROM v)",
    "nearest_to_labels": """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY ALL), q AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY label),
s AS (SELECT q.label, e.vec_id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS c FROM q CROSS JOIN embeddings e),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s)
SELECT label, vec_id, round(c, 6) AS similarity, rank FROM k WHERE rank <= 5""",
    "nearest_by_index": """WITH s AS (SELECT q.vec_id AS asked, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY round(c, 9) DESC, vec_id) AS rank FROM s)
SELECT asked, vec_id, round(c, 6) AS similarity, rank FROM k WHERE rank <= 5""",
}
