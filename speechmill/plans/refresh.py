"""Bring the stored result tables up to date for the sessions that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.fields import natural_key
from speechmill.operators import answers, chunks, dialogue, filters, incremental, retractable, sentiment
from speechmill.operators.lexicon import Lexicon, issue_mentions
from speechmill.session import ensure_checkpoint_dir
from speechmill.sources import speeches as sp
from speechmill.sources import snapshots, tables

SENTIMENT = Lexicon.of(values.CONVERSATION_SENTIMENT, weights={"neutral": 0.5})
ISSUES = Lexicon.of(values.ISSUES, fold_case=False)


def changed_sessions(speeches: DataFrame, stored: DataFrame, version: str, force: bool = False) -> DataFrame:
    """Digest and reason of every incoming session."""
    columns = [c for c in (*sp.SPEECH_COLUMNS, "party", "file_name") if c in speeches.columns]
    digests = incremental.session_digests(speeches, "session_name", columns)
    return incremental.sessions_to_process(digests, stored, version, force=force)


def prompts(
    speeches: DataFrame, worklist: DataFrame, instructions: str = "", session_cut: int = 300, agenda_cut: int = 400
) -> dict[str, DataFrame]:
    """Text blocks for the changed sessions, to be answered by an outside service.

    A sampled speech is shown up to ``session_cut`` characters in a session's block and ``agenda_cut`` in an agenda's.
    """
    rows = incremental.changed_rows(speeches, worklist).filter(filters.is_substantive(F.col("speech_text")))
    # The longer of the two is all that the samples have to carry.
    rows = rows.withColumn("speech_text", F.substring("speech_text", 1, max(session_cut, agenda_cut))).withColumn(
        "speech_key", natural_key(F.col("session_name"), F.col("file_name"), F.col("speech_order"))
    )
    agenda = dialogue.agenda_payload(
        dialogue.agenda_sample(rows, dialogue.leading_agendas(rows)),
        "session_name", "agenda_item_titles", "party", "speech_text", agenda_cut,
    )
    return {
        "session": dialogue.session_prompt(rows, dialogue.session_sample(rows), cut=session_cut, instructions=instructions),
        "agenda": dialogue.agenda_prompt(agenda, "session_name", "agenda_item_titles", instructions),
        "pairs": dialogue.qa_prompt(pairs(speeches, worklist), instructions=instructions),
    }


def pairs(speeches: DataFrame, worklist: DataFrame) -> DataFrame:
    """Question-answer pairs of the changed sessions."""
    rows = incremental.changed_rows(speeches, worklist)
    return dialogue.qa_pairs(rows.filter(filters.is_substantive(F.col("speech_text"))))


def issue_trend_records(speeches: DataFrame, issues: Lexicon = ISSUES, mood: Lexicon = SENTIMENT) -> DataFrame:
    """Rows of the issue table."""
    judged = speeches.withColumn("_s", sentiment.sentiment(F.col("speech_text"), mood)).withColumn("score", F.col("_s.score"))
    found = issue_mentions(judged, issues, "speech_text", ["session_name", "speaker_name", "score"])
    return sentiment.issue_trend(found).select(
        natural_key(F.lit("session"), F.col("session_name")).alias("session_id"),
        "session_name",
        F.col("issue").alias("issue_keyword"),
        "sentiment_score",
        F.col("frequency").cast("int").alias("frequency"),
        "notes",
        F.to_json(F.struct(F.col("notes").alias("top_speakers"))).alias("metadata"),
    )


def with_vectors(rows: DataFrame, vectors: DataFrame, **columns: str) -> DataFrame:
    """Add the stored vector of each text column, ``vector=text``; null where there is none."""
    for out, text in columns.items():
        hashed = rows.withColumn("content_hash", F.sha2(F.col(text), 256))
        rows = incremental.attach_vectors(hashed, vectors).withColumnRenamed("embedding", out).drop("content_hash")
    return rows


#: Vector columns of the stored tables and the texts they stand for.
VECTORS = {
    "sessions": {"summary_embedding": "summary_text"},
    "agenda_items": {"summary_embedding": "summary_text"},
    "party_positions": {"stance_embedding": "summary_text"},
    "qa_interactions": {"question_embedding": "question_text", "answer_embedding": "answer_text"},
}


def texts_without_vectors(spark: SparkSession, root: str) -> DataFrame:
    """``content_hash, content`` of the stored texts that still lack their vector, each once."""
    found = None
    for table, columns in (VECTORS | {"documents_rag": {"embedding": "content"}}).items():
        rows = tables.read_table(spark, table, root)
        for vector, text in columns.items():
            lacking = rows.filter(F.col(vector).isNull() & (F.col(text) != "")).select(F.sha2(F.col(text), 256).alias("content_hash"), F.col(text).alias("content"))
            found = lacking if found is None else found.unionByName(lacking)
    return found.groupBy("content_hash").agg(F.min("content").alias("content"))


def store(
    speeches: DataFrame,
    worklist: DataFrame,
    session_answers: DataFrame,
    agenda_answers: DataFrame,
    vectors: DataFrame,
    root: str,
    version: str,
    qa_answers: DataFrame | None = None,
) -> DataFrame:
    """Replace the rows of all changed sessions in every table.

    Sessions with an answer that cannot be read are set aside: their stored rows stay as they were, so
    the next run takes them up again. They are returned with the number of such answers.

    Each stage runs once for all of them with the session as a key. All tables take effect together by one
    snapshot, so a run that stops leaves the old rows, and running this again stores the same rows. The work list, one row per
    session, is checkpointed first: it is used by every stage and may come from the stored sessions.
    """
    ensure_checkpoint_dir(worklist.sparkSession)
    aside = answers.unreadable_sessions(session_answers, agenda_answers, *([qa_answers] if qa_answers is not None else []))
    aside = aside.join(worklist.filter(F.col("reason") != "unchanged"), "session_name", "left_semi").checkpoint()
    worklist = worklist.join(aside, "session_name", "left_anti").checkpoint()
    rows = incremental.changed_rows(speeches, worklist)
    totals = rows.groupBy("session_name").agg(
        F.count(F.lit(1)).alias("total_speeches"),
        F.count_if(filters.is_substantive(F.col("speech_text"))).alias("quality_speeches"),
    )
    summaries = answers.summary_rows(incremental.changed_rows(session_answers, worklist))
    given = incremental.changed_rows(agenda_answers, worklist)
    agendas = answers.agenda_records(answers.agenda_rows(given))
    positions = answers.position_rows(given)
    # Three tables are made from the pairs.
    found = pairs(speeches, worklist).checkpoint()
    digests = worklist.select("session_name", "hash_digest")
    metrics = None if qa_answers is None else answers.qa_metric_rows(incremental.changed_rows(qa_answers, worklist), found)
    sessions = answers.session_records(summaries, totals, digests, version, metrics, whole=True)
    documents = (
        chunks.summary_documents(summaries)
        .unionByName(chunks.position_documents(positions, agendas))
        .unionByName(chunks.qa_documents(found, agendas))
    )
    retrieval = incremental.attach_vectors(chunks.rag_rows(chunks.chunk_rows(documents)), vectors)
    run, changed = snapshots.Run(worklist.sparkSession, root), worklist.filter(F.col("reason") != "unchanged")
    for table, frame in (
        ("agenda_items", agendas),
        ("party_positions", answers.position_records(positions, agendas)),
        ("qa_interactions", answers.qa_records(found, agendas)),
        ("issue_trends", issue_trend_records(rows)),
        ("documents_rag", retrieval.withColumn("session_name", F.get_json_object("metadata", "$.session_name"))),
        ("sessions", sessions),
    ):
        full = with_vectors(frame, vectors, **VECTORS.get(table, {}))
        run.write(table, tables.conform(full, table), "session_name", changed)
    run.commit()
    return aside


#: Topic scores kept up to date by :func:`update_topics`: the digest of each session, its cells, and sums over sessions.
_CELL = "topic string, topic_ord int, weight double, speeches bigint, hits bigint, covered bigint"
TOPIC_TABLES = {
    "topic_sessions": ("session_name string, hash_digest string, analysis_version string", "session_name"),
    "topic_cells": (f"session_name string, month string, party string, first_date date, last_date date, {_CELL}", "session_name"),
    "topic_totals": (f"month string, party string, {_CELL}", "month"),
}


def topic_table(spark: SparkSession, table: str, root: str) -> DataFrame:
    return snapshots.read(spark, root, table, *TOPIC_TABLES[table])


def update_topics(counted: DataFrame, digests: DataFrame, root: str, lexicon: Lexicon, version: str) -> DataFrame:
    """Bring topic scores up to date by the sessions that changed, and return those with their reason.

    ``counted`` has ``session_name, month, party, d, topic_counts``, ``digests`` the digest of every session. Spark
    takes the changed sessions before it counts; another lexicon needs another ``version``. The stored
    cells of changed sessions, and of those that are ``gone``, leave the totals and the new ones join them; months
    that they do not touch keep their files. All tables take effect together.
    """
    spark = counted.sparkSession
    ensure_checkpoint_dir(spark)
    known, cells, totals = (topic_table(spark, t, root) for t in TOPIC_TABLES)
    work = incremental.sessions_to_process(digests, known, version)
    gone = known.join(digests, "session_name", "left_anti").select("session_name", F.lit(None).cast("string").alias("hash_digest"), F.lit("gone").alias("reason"))
    work = work.unionByName(gone).filter(F.col("reason") != "unchanged").checkpoint()

    run = snapshots.Run(spark, root)

    def shaped(df: DataFrame, table: str) -> DataFrame:
        schema = spark.createDataFrame([], TOPIC_TABLES[table][0]).schema
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    fresh = run.write("topic_cells", shaped(retractable.session_cells(incremental.changed_rows(counted, work), lexicon), "topic_cells"), "session_name", work)
    old = incremental.changed_rows(cells, work)
    months = old.select("month").unionByName(fresh.select("month")).distinct()
    touched = totals.join(months, totals["month"].eqNullSafe(months["month"]), "left_semi")
    run.write("topic_totals", shaped(retractable.advanced(touched, old, fresh), "topic_totals"), "month", months)
    stored = work.filter(F.col("reason") != "gone").withColumn("analysis_version", F.lit(version))
    run.write("topic_sessions", shaped(stored, "topic_sessions"), "session_name", work)
    run.commit()
    return work.select("session_name", "reason")
