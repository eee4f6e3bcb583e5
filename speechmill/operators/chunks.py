"""Overlapping text chunks and the documents they are cut from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.expr import join_lines, let, unnest_numbered
from speechmill.functions.fields import natural_key
from speechmill.functions.text import strip

LABEL = values.DOCUMENT


def chunk_array(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Pieces of ``size`` characters, each starting ``size - overlap`` after the one before.

    A text that fits is one chunk; a blank text has none. Starts run to the end of the text, so the
    last chunk may lie inside the previous one.
    """
    step = max(size - overlap, 1)

    def cut(t: Column) -> Column:
        n = F.length(t)
        return (
            F.when(n == 0, F.array().cast("array<string>"))
            .when(n <= size, F.array(t))
            .otherwise(F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: F.substring(t, s + 1, F.lit(size))))
        )

    return let(strip(F.coalesce(text, F.lit(""))), cut)


def chunk_rows(
    df: DataFrame, text: str = "text", source_id: str = "source_id", metadata: str | None = "metadata",
    size: int = 800, overlap: int = 100,
) -> DataFrame:
    """One row per chunk: source, index from 0, record id, content and metadata."""
    keep = [source_id] + ([metadata] if metadata else [])
    return unnest_numbered(df, keep, chunk_array(F.col(text), size, overlap), "chunk_index", "content").withColumn(
        "record_id", F.concat_ws(":", F.col(source_id).cast("string"), F.col("chunk_index").cast("string"))
    )


def _metadata(**fields: Column | str) -> Column:
    pairs = [x for k, v in fields.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v.cast("string"))]
    return F.create_map(*pairs).alias("metadata")


def _section(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(title + "\n"), F.array_join(lines, "\n")))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def summary_documents(summaries: DataFrame) -> DataFrame:
    """One document per session summary: summary, issues, conflicts, events."""
    issues = F.transform(
        "key_issues",
        lambda i: F.concat(
            F.lit("- "), _text(i["issue"]), F.lit(" ("), _text(i["importance"]), F.lit(") : "), _text(i["description"])
        ),
    )
    conflicts = F.transform(
        "major_conflicts",
        lambda c: F.concat(
            F.lit("- "), _text(c["topic"]), F.lit(LABEL["parties"]), F.array_join(c["parties_involved"], ", ")
        ),
    )
    events = F.transform(
        "key_events",
        lambda e: F.concat(
            F.lit("- "), _text(e["event"]), F.lit(" : "), _text(e["description"]), F.lit(LABEL["response"]), _text(e["response"])
        ),
    )
    return summaries.select(
        F.concat(F.lit("session::"), F.col("session_name")).alias("source_id"),
        join_lines(
            F.col("raw_summary"),
            _section(LABEL["issues"], issues),
            _section(LABEL["conflicts"], conflicts),
            _section(LABEL["events"], events),
        ).alias("text"),
        _metadata(source_type="session_summary", session_name=F.col("session_name")),
    )


def position_documents(positions: DataFrame, agenda_ids: DataFrame) -> DataFrame:
    """One document per party position; an agenda without an id keeps an empty one."""
    rows = positions.join(
        agenda_ids.select("session_name", "agenda_title", "agenda_id"), ["session_name", "agenda_title"], "left"
    )

    def bullets(items: str) -> Column:
        return _section(LABEL[items], F.transform(items, lambda p: F.concat(F.lit("- "), p)))

    return rows.select(
        F.concat_ws(
            "::", F.lit("session"), "session_name", F.lit("agenda"), "agenda_title", F.lit("party"), "party_name"
        ).alias("source_id"),
        join_lines(
            F.concat(F.lit(LABEL["agenda"]), F.col("agenda_title")),
            F.concat(F.lit(LABEL["party"]), F.col("party_name")),
            F.concat(F.lit(LABEL["stance"]), _text(F.col("stance_label"))),
            F.col("summary_text"),
            join_lines(
                bullets("key_points"),
                bullets("concerns"),
                bullets("suggestions"),
                sep="\n\n",
            ),
        ).alias("text"),
        _metadata(
            source_type="party_position",
            agenda_title=F.col("agenda_title"),
            agenda_id=F.coalesce("agenda_id", F.lit("")),
            session_name=F.col("session_name"),
            party_name=F.col("party_name"),
            stance_label=F.col("stance_label"),
        ),
    )


def numbered_pairs(pairs: DataFrame, session: str = "session_name", block: int = 65_536) -> DataFrame:
    """Pairs with their index from 0 inside the session.

    The index is a count of earlier blocks plus a rank inside the block, so a session that holds
    most of the pairs is still numbered by many tasks.
    """
    place = [session, "question_file", "_block"]
    rows = pairs.withColumn("_block", F.floor(F.col("question_order") / block))
    sizes = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(session).orderBy("question_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*place, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*place).orderBy("question_order")
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, place)
        .withColumn("pair_index", (F.col("_offset") + F.col("_rn") - 1).cast("bigint"))
        .drop("_block", "_rn", "_offset")
    )


def qa_documents(pairs: DataFrame, agenda_ids: DataFrame) -> DataFrame:
    """One document per question-answer pair, named by the pair's index in its session."""
    ids = agenda_ids.select(
        "session_name", F.col("agenda_title").alias("question_agenda_item_titles"), "agenda_id"
    )
    rows = numbered_pairs(pairs).join(ids, ["session_name", "question_agenda_item_titles"], "left")

    def who(side: str) -> Column:
        return F.concat(_text(F.col(f"{side}_speaker_name")), F.lit(" ("), _text(F.col(f"{side}_party")), F.lit(")"))

    return rows.select(
        F.concat_ws("::", F.lit("session"), "session_name", F.lit("qa"), F.col("pair_index").cast("string")).alias(
            "source_id"
        ),
        F.concat(
            F.lit(LABEL["questioner"]), who("question"), F.lit(f"\n{LABEL['question']}\n"), F.col("question"),
            F.lit(f"\n\n{LABEL['respondent']}"), who("answer"), F.lit(f"\n{LABEL['answer']}\n"), F.col("answer"),
        ).alias("text"),
        _metadata(
            source_type="qa_pair",
            agenda_title=F.col("question_agenda_item_titles"),
            agenda_id=F.coalesce("agenda_id", F.lit("")),
            session_name=F.col("session_name"),
            questioner=F.col("question_speaker_name"),
            respondent=F.col("answer_speaker_name"),
        ),
    )


def rag_rows(chunks: DataFrame) -> DataFrame:
    """Rows of the retrieval table, keyed by source and chunk so that a re-run replaces them."""
    return chunks.select(
        natural_key(F.col("source_id"), F.col("chunk_index")).alias("document_id"),
        F.col("metadata")["source_type"].alias("source_type"),
        "source_id",
        "chunk_index",
        "content",
        F.to_json("metadata").alias("metadata"),
        F.sha2("content", 256).alias("content_hash"),
    )
