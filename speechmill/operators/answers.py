"""Analysis answers: from nested JSON to relational rows and chart-ready tables.

Answers arrive as a table with one JSON text per session or agenda. Field names that changed over
time are read through one schema that holds both and coalesced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmill.functions.expr import blank_to_null, join_lines, unnest, unnest_map, unnest_numbered
from speechmill.functions.fields import importance, list_or_empty, natural_key, number, parsed, stance
from speechmill.functions.text import preview

ISSUE = "struct<issue:string,importance:string,description:string,mentioned_parties:array<string>>"
CONFLICT = "struct<topic:string,parties_involved:array<string>,nature:string>"
EVENT = "struct<event:string,description:string,response:string>"
PARTY_VIEW = "struct<main_concerns:array<string>,key_statements:string,stance:string>"
DETAILS = (
    "struct<position:string,stance:string,key_points:array<string>,concerns:array<string>,"
    "suggestions:array<string>,key_statements:string>"
)
SUMMARY_ANSWER = (
    f"session_name string, key_issues array<{ISSUE}>, overall_sentiment double, session_characteristics string, "
    f"party_positions map<string,{PARTY_VIEW}>, major_conflicts array<{CONFLICT}>, key_events array<{EVENT}>"
)
POSITION_ANSWER = (
    f"agenda string, agenda_title string, party_positions map<string,{DETAILS}>, consensus_points array<string>, "
    "conflict_points array<string>, cooperation_level string, summary string"
)
QA_ANSWER = (
    "session_name string, total_qa_pairs int, qa_pairs_count int, quality_distribution map<string,string>, "
    "question_types map<string,string>, answer_quality map<string,string>, "
    "key_issues array<struct<issue:string,qa_count:string,quality:string>>, improvement_suggestions array<string>"
)
# ``party_positions`` is a map by agenda in older documents and a list in newer ones; it is kept as
# text and parsed with whichever shape it has. The same goes for the session summary.
RESULT_DOCUMENT = (
    "session_name string, total_speeches int, quality_speeches int, analysis_timestamp string, "
    "session_summary string, party_positions string, qa_analysis string"
)
STORED_SUMMARY = (
    SUMMARY_ANSWER + ", raw_summary string, metadata struct<"
    f"party_positions_overview:map<string,{PARTY_VIEW}>,"
    f"major_conflicts:array<{CONFLICT}>,key_events:array<{EVENT}>>"
)
LISTED_POSITION = (
    "struct<party_name:string,stance_label:string,key_points:array<string>,concerns:array<string>,"
    "suggestions:array<string>,summary_text:string>"
)


def is_readable(answer: Column) -> Column:
    """Whether an answer is a whole JSON object."""
    return F.json_object_keys(answer).isNotNull()


def unreadable_sessions(*answers: DataFrame, session: str = "session_name", answer: str = "answer") -> DataFrame:
    """``session_name, answers`` of the sessions with answers that cannot be read, and how many of theirs."""
    bad = [a.filter(~is_readable(F.col(answer))).select(F.col(session).alias("session_name")) for a in answers]
    rows = bad[0]
    for more in bad[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("session_name").agg(F.count(F.lit(1)).alias("answers"))


def summary_rows(answers: DataFrame, session: str = "session_name", answer: str = "answer") -> DataFrame:
    """One row per session summary, with defaults for what the answer lacks."""
    rows = answers.select(F.col(session).alias("_asked"), parsed(F.col(answer), SUMMARY_ANSWER).alias("a"))
    return rows.select(
        F.coalesce("a.session_name", "_asked").alias("session_name"),
        list_or_empty(F.col("a.key_issues"), ISSUE).alias("key_issues"),
        F.col("a.overall_sentiment").alias("overall_sentiment"),
        F.col("a.session_characteristics").alias("raw_summary"),
        F.col("a.party_positions").alias("party_views"),
        list_or_empty(F.col("a.major_conflicts"), CONFLICT).alias("major_conflicts"),
        list_or_empty(F.col("a.key_events"), EVENT).alias("key_events"),
    )


def agenda_rows(
    answers: DataFrame, session: str = "session_name", agenda: str = "agenda_title", answer: str = "answer"
) -> DataFrame:
    """One row per agenda answer."""
    rows = answers.select(session, agenda, parsed(F.col(answer), POSITION_ANSWER).alias("a"))
    return rows.select(
        F.col(session).alias("session_name"),
        F.col(agenda).alias("agenda_title"),
        list_or_empty(F.col("a.consensus_points")).alias("consensus_points"),
        list_or_empty(F.col("a.conflict_points")).alias("conflict_points"),
        F.col("a.cooperation_level").alias("cooperation_level"),
        F.col("a.summary").alias("summary"),
    )


def position_rows(
    answers: DataFrame, session: str = "session_name", agenda: str = "agenda_title", answer: str = "answer"
) -> DataFrame:
    """One row per agenda and party named in the answer."""
    rows = answers.select(session, agenda, parsed(F.col(answer), POSITION_ANSWER).alias("a"))
    keep = [F.col(session).alias("session_name"), F.col(agenda).alias("agenda_title")]
    return _positions(unnest_map(rows, keep, F.col("a.party_positions"), "party_name", "d"))


def _positions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "session_name",
        "agenda_title",
        "party_name",
        F.coalesce("d.stance", "d.position", F.lit("")).alias("stance_label"),
        list_or_empty(F.col("d.key_points")).alias("key_points"),
        list_or_empty(F.col("d.concerns")).alias("concerns"),
        list_or_empty(F.col("d.suggestions")).alias("suggestions"),
        F.col("d.key_statements").alias("summary_text"),
    )


def qa_metric_rows(answers: DataFrame, pairs: DataFrame, session: str = "session_name", answer: str = "answer") -> DataFrame:
    """One row of question-answer metrics per session; the pair count falls back to the pairs at hand."""
    counted = pairs.groupBy(session).agg(F.count(F.lit(1)).alias("_pairs"))
    rows = answers.join(counted, session, "left").select(
        session, "_pairs", parsed(F.col(answer), QA_ANSWER).alias("a")
    )
    empty_map = F.create_map().cast("map<string,string>")
    return rows.select(
        F.coalesce(blank_to_null(F.col("a.session_name")), F.col(session)).alias("session_name"),
        F.coalesce("a.total_qa_pairs", F.col("_pairs").cast("int"), F.lit(0)).alias("total_qa_pairs"),
        F.coalesce("a.quality_distribution", empty_map).alias("quality_distribution"),
        F.coalesce("a.question_types", empty_map).alias("question_types"),
        F.coalesce("a.answer_quality", empty_map).alias("answer_quality"),
        F.coalesce("a.key_issues", F.array().cast("array<struct<issue:string,qa_count:string,quality:string>>")).alias(
            "key_issues"
        ),
        list_or_empty(F.col("a.improvement_suggestions")).alias("improvement_suggestions"),
    )


# --- texts to store -------------------------------------------------------------------------------


def session_summary_text(raw_summary: Column, key_issues: Column) -> Column:
    """The summary, else one ``issue - description`` line per issue."""
    lines = F.transform(
        key_issues,
        lambda i: F.concat(
            F.coalesce(i["issue"], F.lit("None")), F.lit(" - "), F.coalesce(i["description"], F.lit("None"))
        ),
    )
    return F.coalesce(blank_to_null(raw_summary), F.array_join(lines, "\n"))


def agenda_summary_text(summary: Column, consensus: Column, conflict: Column) -> Column:
    """The summary, else the consensus lines followed by the conflict lines."""
    return F.coalesce(blank_to_null(summary), F.array_join(F.concat(consensus, conflict), "\n"))


def position_summary_text(summary: Column, key_points: Column, concerns: Column, suggestions: Column) -> Column:
    """The summary, else all bullets."""
    return F.coalesce(blank_to_null(summary), F.array_join(F.concat(key_points, concerns, suggestions), "\n"))


# --- rows to store --------------------------------------------------------------------------------


def session_records(
    summaries: DataFrame, totals: DataFrame, digests: DataFrame, version: str, metrics: DataFrame | None = None, whole: bool = False
) -> DataFrame:
    """Rows of the session table.

    The metadata tell the counts; ``whole`` adds the summary, and ``metrics`` (of
    :func:`qa_metric_rows`) the question-answer metrics, of the sessions that have them.
    """
    text = session_summary_text(F.col("raw_summary"), F.col("key_issues"))
    details = []
    rows = totals.join(digests, "session_name").join(summaries.withColumn("_summary", F.lit(True)), "session_name", "left")
    if whole:
        others = F.struct(F.col("party_views").alias("party_positions_overview"), "major_conflicts", "key_events")
        summary = F.struct("session_name", "key_issues", "overall_sentiment", "raw_summary", others.alias("metadata"))
        details.append(F.when(F.col("_summary"), summary).alias("session_summary"))
    if metrics is not None:
        given = metrics.select("session_name", F.struct(*metrics.columns).alias("qa_metrics"))
        rows = rows.join(given, "session_name", "left")
        details.append(F.col("qa_metrics"))
    return (
        rows.select(
            natural_key(F.lit("session"), F.col("session_name")).alias("session_id"),
            "session_name",
            "hash_digest",
            F.lit(version).alias("analysis_version"),
            blank_to_null(text).alias("summary_text"),
            F.to_json(
                F.struct("total_speeches", "quality_speeches", F.lit(version).alias("analysis_version"), *details)
            ).alias("metadata"),
        )
    )


def agenda_records(agendas: DataFrame) -> DataFrame:
    """Rows of the agenda table."""
    return agendas.select(
        natural_key(F.lit("agenda"), F.col("session_name"), F.col("agenda_title")).alias("agenda_id"),
        natural_key(F.lit("session"), F.col("session_name")).alias("session_id"),
        "session_name",
        "agenda_title",
        agenda_summary_text(F.col("summary"), F.col("consensus_points"), F.col("conflict_points")).alias("summary_text"),
        F.to_json(F.struct("consensus_points", "conflict_points", "cooperation_level")).alias("metadata"),
    )


def position_records(positions: DataFrame, agendas: DataFrame) -> DataFrame:
    """Rows of the party position table; positions on unknown agendas are skipped."""
    text = position_summary_text(
        F.col("summary_text"), F.col("key_points"), F.col("concerns"), F.col("suggestions")
    )
    return positions.withColumn("summary_text", blank_to_null(text)).join(
        agendas.select("session_name", "agenda_title", "agenda_id"), ["session_name", "agenda_title"]
    ).select(
        "agenda_id", "session_name", "party_name", "stance_label", "key_points", "concerns", "suggestions", "summary_text"
    )


def qa_records(pairs: DataFrame, agendas: DataFrame) -> DataFrame:
    """Rows of the question-answer table; the scores stay empty until an answer fills them."""
    ids = agendas.select(
        "session_name", F.col("agenda_title").alias("question_agenda_item_titles"), "agenda_id"
    )
    return pairs.join(ids, ["session_name", "question_agenda_item_titles"], "left").select(
        natural_key(
            F.lit("qa"), F.col("session_name"), F.col("question_file"), F.col("question_order")
        ).alias("qa_id"),
        "agenda_id",
        "session_name",
        F.col("question_speaker_name").alias("questioner"),
        F.col("answer_speaker_name").alias("respondent"),
        F.col("question").alias("question_text"),
        F.col("answer").alias("answer_text"),
        F.lit(None).cast("double").alias("effectiveness_score"),
        F.lit(None).cast("string").alias("effectiveness_bucket"),
        F.array().cast("array<string>").alias("tags"),
        F.to_json(F.struct("question_party", "answer_party", "session_name")).alias("metadata"),
    )


# --- stored result documents ----------------------------------------------------------------------


def result_documents(doc: DataFrame) -> DataFrame:
    """Both shapes of the stored result document, read into one.

    ``doc`` has the columns of ``RESULT_DOCUMENT``, its nested parts still as JSON text.
    """
    s = parsed(F.col("session_summary"), STORED_SUMMARY).alias("s")
    q = parsed(F.col("qa_analysis"), QA_ANSWER).alias("q")
    return doc.select(
        "session_name", "total_speeches", "quality_speeches", "analysis_timestamp", "party_positions", s, q
    ).select(
        "session_name",
        "total_speeches",
        "quality_speeches",
        "analysis_timestamp",
        list_or_empty(F.col("s.key_issues"), ISSUE).alias("key_issues"),
        F.coalesce("s.raw_summary", "s.session_characteristics").alias("raw_summary"),
        F.coalesce("s.party_positions", "s.metadata.party_positions_overview").alias("party_views"),
        list_or_empty(F.coalesce("s.major_conflicts", "s.metadata.major_conflicts"), CONFLICT).alias("major_conflicts"),
        list_or_empty(F.coalesce("s.key_events", "s.metadata.key_events"), EVENT).alias("key_events"),
        "party_positions",
        F.coalesce(
            F.nullif("q.qa_pairs_count", F.lit(0)), F.nullif("q.total_qa_pairs", F.lit(0)), F.lit(0)
        ).alias("qa_pairs"),
        F.col("q.quality_distribution").alias("quality_distribution"),
        F.col("q.question_types").alias("question_types"),
    )


def assembled_documents(heads: DataFrame, positions: DataFrame, summaries: DataFrame, metrics: DataFrame) -> DataFrame:
    """``session_name, document``: the nested result document of each session as JSON text.

    ``heads`` has ``session_name, total_speeches, quality_speeches, analysis_timestamp`` and ``as_list``, which
    chooses the shape; ``positions`` are the rows of :func:`position_rows`; ``summaries`` and ``metrics`` hold
    the session's ``session_summary`` and ``qa_analysis`` as JSON text. Parties meet in the row of their agenda
    first and turn into text there; a session's row gathers one text for each agenda. Parts that a
    session lacks are left out; a session without positions has an empty list or object.
    """
    # The title as a JSON string: what to_json writes between '{"v":' and '}'.
    title = F.regexp_extract(F.to_json(F.struct(F.coalesce("agenda_title", F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}\z", 1)
    lists = ("key_points", "concerns", "suggestions")
    entry = F.struct("party_name", "stance_label", *lists, "summary_text")
    agendas = positions.groupBy("session_name", "agenda_title").agg(F.sort_array(F.collect_list(entry)).alias("p"))
    older = F.map_from_entries(
        F.transform("p", lambda p: F.struct(p["party_name"], F.struct(p["stance_label"].alias("stance"), *[p[c].alias(c) for c in lists], p["summary_text"].alias("key_statements"))))
    )
    texts = agendas.select(
        "session_name",
        "agenda_title",
        F.concat(title, F.lit(":"), F.to_json(F.struct(older.alias("party_positions")))).alias("older"),
        F.to_json(F.struct("agenda_title", F.col("p").alias("party_positions"))).alias("newer"),
    )
    whole = texts.groupBy("session_name").agg(F.sort_array(F.collect_list(F.struct("agenda_title", "older", "newer"))).alias("a"))
    rows = heads.join(whole, "session_name", "left").join(summaries, "session_name", "left").join(metrics, "session_name", "left")
    joined = lambda name: F.coalesce(F.array_join(F.transform("a", lambda a: a[name]), ","), F.lit(""))
    shape = F.when(F.col("as_list"), F.concat(F.lit("["), joined("newer"), F.lit("]"))).otherwise(F.concat(F.lit("{"), joined("older"), F.lit("}")))
    head = F.regexp_replace(F.to_json(F.struct("session_name", "total_speeches", "quality_speeches", "analysis_timestamp")), r"(?s)\}\z", "")
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in (("session_summary", F.col("session_summary")), ("party_positions", shape), ("qa_analysis", F.col("qa_analysis")))]
    return rows.select("session_name", F.concat(F.concat_ws(",", head, *parts), F.lit("}")).alias("document"))


def document_positions(documents: DataFrame) -> DataFrame:
    """Positions out of result documents, whether the agendas are a map or a list."""
    is_list = F.col("party_positions").startswith("[")
    keyed = F.from_json("party_positions", f"map<string,struct<party_positions:map<string,{DETAILS}>>>")
    agendas = unnest_map(documents.filter(~is_list), ["session_name"], keyed, "agenda_title", "a")
    by_map = unnest_map(agendas, ["session_name", "agenda_title"], F.col("a.party_positions"), "party_name", "d")
    array = F.from_json(
        "party_positions", f"array<struct<agenda_title:string,party_positions:array<{LISTED_POSITION}>>>"
    )
    entries = unnest(documents.filter(is_list), ["session_name"], array, "a")
    listed = unnest(
        entries, ["session_name", F.col("a.agenda_title").alias("agenda_title")], F.col("a.party_positions"), "p"
    ).select(
        "session_name",
        "agenda_title",
        "p.party_name",
        F.coalesce("p.stance_label", F.lit("")).alias("stance_label"),
        list_or_empty(F.col("p.key_points")).alias("key_points"),
        list_or_empty(F.col("p.concerns")).alias("concerns"),
        list_or_empty(F.col("p.suggestions")).alias("suggestions"),
        F.col("p.summary_text").alias("summary_text"),
    )
    return _positions(by_map).unionByName(listed)


# --- chart tables ---------------------------------------------------------------------------------


def tiles(documents: DataFrame) -> DataFrame:
    return documents.select(
        "session_name", "total_speeches", "quality_speeches", F.size("key_issues").alias("issues"), "qa_pairs"
    )


def issue_rows(documents: DataFrame) -> DataFrame:
    """One row per issue: importance as a number, its rank in the session, the parties named."""
    rank = F.row_number().over(Window.partitionBy("session_name").orderBy(F.desc("importance"), F.asc("pos")))
    return unnest_numbered(documents, ["session_name"], F.col("key_issues"), "pos", "i").select(
        "session_name",
        "pos",
        F.col("i.issue").alias("issue"),
        importance(F.col("i.importance")).alias("importance"),
        F.col("i.description").alias("description"),
        list_or_empty(F.col("i.mentioned_parties")).alias("parties"),
    ).withColumn("rank", rank)


def concern_counts(documents: DataFrame) -> DataFrame:
    """Concerns per party and the party's rank in the session."""
    rank = F.row_number().over(Window.partitionBy("session_name").orderBy(F.desc("concerns"), F.asc("party")))
    return unnest_map(documents, ["session_name"], F.col("party_views"), "party", "v").select(
        "session_name",
        "party",
        F.size(list_or_empty(F.col("v.main_concerns"))).alias("concerns"),
        F.coalesce("v.stance", F.lit("")).alias("stance"),
    ).withColumn("rank", rank)


def shares(documents: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    """Values of fixed labels in long form, text such as ``40%`` read as a number, absent 0."""
    return documents.select(
        "session_name", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), F.col(column).alias("_m")
    ).select("session_name", "label", number(F.try_element_at("_m", F.col("label"))).alias("value"))


QUALITY_LABELS = ("high", "medium", "low")
QUESTION_LABELS = ("policy_inquiry", "fact_checking", "criticism", "suggestion")


def stance_matrix(positions: DataFrame) -> DataFrame:
    """Every agenda against every party of the session; no position is an empty label and 0."""
    labels = positions.select("session_name", "party_name").filter(F.col("party_name").isNotNull()).distinct()
    grid = positions.select("session_name", "agenda_title").distinct().join(labels, "session_name")
    keys = ["session_name", "agenda_title", "party_name"]
    return grid.join(positions.select(*keys, "stance_label"), keys, "left").select(
        "session_name",
        preview(F.col("agenda_title"), 30, "...").alias("agenda"),
        "party_name",
        F.coalesce("stance_label", F.lit("")).alias("position"),
        stance(F.col("stance_label")).alias("value"),
    )


def conflict_nodes(documents: DataFrame) -> DataFrame:
    conflicts = unnest(documents, ["session_name"], F.col("major_conflicts"), "c")
    return unnest(conflicts, ["session_name"], F.col("c.parties_involved"), "party").distinct()


def conflict_edges(documents: DataFrame) -> DataFrame:
    """First two parties of each conflict."""
    return unnest(documents, ["session_name"], F.col("major_conflicts"), "c").select(
        "session_name",
        F.get("c.parties_involved", F.lit(0)).alias("source"),
        F.get("c.parties_involved", F.lit(1)).alias("target"),
        F.col("c.nature").alias("nature"),
    )
