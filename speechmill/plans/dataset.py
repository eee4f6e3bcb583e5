"""The given tables seen as speeches, speakers, dialogues and pages.

Text-side and speaker-side columns are kept apart: a query first turns the text into a small
feature and only then joins the speaker, so the join does not move the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmill.operators.lexicon import Lexicon
from speechmill.operators.rollups import attach_group
from speechmill.session import spread

# Words that occur in the given texts; one listed twice and one that never occurs per lexicon.
TOPICS = Lexicon.of(
    {
        "articles": {"keywords": ["The", "der", "la ", "The"], "weight": 1.0},
        "joining": {"keywords": ["and", "und", "et ", "y ", "qwertyuiop"], "weight": 0.5},
        "endings": {"keywords": ["tion", "keit", "ción", "ment"], "weight": 1.0},
        "places": {"keywords": [" in ", " of ", "von", "dans"], "weight": 1.5},
        "rare": {"keywords": ["ouè", "ños", "üte", "whst"], "weight": 2.0},
        "absent": {"keywords": ["zzzzzz"], "weight": 1.0},
    }
)
MOOD = Lexicon.of(
    {
        "positive": ["the", "of ", "and", "tion", "est", "able", "won", "elle", "beau", "der ", "est", "light"],
        "negative": ["not", "und", "ein", "sch", "aux", "eau", "che", "ñ", "dad", "osa", "ado", "aux"],
        "neutral": ["in ", "en ", "re ", "is ", "as ", "an ", "or ", "re ", "le ", "la "],
    }
)
WEIGHTED_MOOD = Lexicon.of({t.name: t.keywords for t in MOOD.topics}, weights={"neutral": 0.5})
ISSUES = Lexicon.of(
    {"whether": ["wh", "Wh"], "street": ["Street", "email", "@"], "licence": ["icense", "Copyright"], "none": ["zzzz"]},
    fold_case=False,
)
# Pairs of letters, and the same pairs followed by "en".
_PAIRS = [a + b for a in "abcdefghijklmno" for b in "aeiourstln"]
LONG = Lexicon.of({"beginnings": _PAIRS, "whole": [p + "en" for p in _PAIRS]})
# More topics than are summed as columns.
MANY = Lexicon.of({p: [p, p + "en"] for p in _PAIRS}, weights={p: 0.5 for p in _PAIRS[::3]})
POLICY = ["the", "and", "tion", "der", "und", "est", "que", "eau", "ment", "de "]
PROCEDURAL = ["thank", "wh", "sch", "oui", "ción"]
FILLERS = ["euh", "the", "ou", "ein", "de"]
PHRASES = [r"of the", r"Tion.*the", r"and|und", r"qwerty\?"]
QUESTIONS = ["qu", "?", "wh", "wie", "ment"]
ANSWERS = ["and", "tion", "und", "ado", "le "]
STOP_WORDS = ["the", "and", "of", "la", "de", "le", "et", "und", "in"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Speeches without their speaker."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 180).cast("int"))
    meeting = F.concat(F.lit("제"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("차"))
    return docs.select(
        F.col("doc_id").alias("speech_key"),
        (415 + F.floor(F.col("doc_id") % 180 / 15)).cast("int").alias("session"),
        F.concat(
            F.lit("제"), (415 + F.floor(F.col("doc_id") % 180 / 15)).cast("string"), F.lit("회")
        ).alias("session_name"),
        meeting.alias("meeting_no"),
        F.concat(meeting, F.lit("_minutes_speeches.csv")).alias("file_name"),
        F.concat(
            F.year(day), F.lit("년 "), F.month(day), F.lit("월 "), F.dayofmonth(day), F.lit("일(목)")
        ).alias("date"),
        (F.col("doc_id") + 1).alias("speech_order"),
        F.col("source").alias("agenda_item_titles"),
        F.col("text").alias("speech_text"),
    )


def speakers(spark: SparkSession, sf: str) -> DataFrame:
    """Speaker, position and party of every speech; some speakers are missing from the dimension."""
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("speech_key"),
        "user_id",
        F.concat(F.lit("u"), F.col("user_id")).alias("speaker_name"),
        F.when(F.col("event_type") == "error", "위원장").otherwise("위원").alias("speaker_position"),
        "event_type",
    )
    dimension = (
        events.filter(F.col("user_id") % 7 != 0)
        .groupBy("speaker_name")
        .agg(F.concat(F.lit("party_"), F.first("user_id") % 5).alias("party"))
    )
    return attach_group(events, dimension, "speaker_name", "party").drop("user_id")


def with_speaker(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Join the speaker by the speech's key.

    Both sides grow with the data, so neither is broadcast; the narrow side is the one hashed, and
    the wide one needs no sort. A partition of the narrow side, a few dozen bytes a speech, has to
    fit in a task's memory.
    """
    return df.join(speakers(spark, sf).hint("shuffle_hash"), "speech_key")


def dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as meetings: turns are speeches, roles are speakers."""
    c = table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("speech_key"),
        F.concat(F.lit("제"), (415 + F.col("conv_id") % 6).cast("string"), F.lit("회")).alias("session_name"),
        F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("file_name"),
        F.col("turn").alias("speech_order"),
        F.col("role").alias("speaker_name"),
        F.concat(F.lit("side_"), F.col("role")).alias("party"),
        F.concat(F.lit("topic_"), (F.col("conv_id") % 5).cast("string")).alias("agenda_item_titles"),
        F.col("text").alias("speech_text"),
    )


SPEECH_SQL = """speech AS (
  SELECT d.doc_id AS speech_key, CAST(415 + (d.doc_id % 180) // 15 AS INTEGER) AS session,
    '제' || (415 + (d.doc_id % 180) // 15) || '회' AS session_name,
    '제' || (d.doc_id % 3 + 1) || '차' AS meeting_no,
    '제' || (d.doc_id % 3 + 1) || '차_minutes_speeches.csv' AS file_name,
    DATE '2024-01-01' + CAST(d.doc_id % 180 AS INTEGER) AS d,
    strftime(DATE '2024-01-01' + CAST(d.doc_id % 180 AS INTEGER), '%Y-%m') AS month,
    d.doc_id + 1 AS speech_order, d.source AS agenda_item_titles, d.text AS speech_text,
    'u' || e.user_id AS speaker_name,
    CASE WHEN e.event_type = 'error' THEN '위원장' ELSE '위원' END AS speaker_position,
    CASE WHEN e.user_id % 7 = 0 THEN '미분류' ELSE 'party_' || (e.user_id % 5) END AS party
  FROM documents d JOIN events e ON d.doc_id = e.event_id)"""

DIALOGUE_SQL = """dialogue AS (
  SELECT conv_id * 1000 + turn AS speech_key, '제' || (415 + conv_id % 6) || '회' AS session_name,
    lpad(CAST(conv_id AS VARCHAR), 12, '0') AS file_name, turn AS speech_order, role AS speaker_name,
    'side_' || role AS party, 'topic_' || (conv_id % 5) AS agenda_item_titles, text AS speech_text
  FROM conversations)"""

# The same Unicode classes as in the column expressions.
SPACE_SQL = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def plain_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def conversation_sql(x: str) -> str:
    fillers = "|".join(FILLERS)
    return (
        rf"array_to_string(list_filter(string_split(regexp_replace(regexp_replace({x}, '({fillers}){SPACE_SQL}*', '', 'g'),"
        rf" '[^\p{{L}}\p{{N}}_.!?]+', ' ', 'g'), ' '), lambda w: length(w) > 2), ' ')"
    )


def words_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def lexicon_sql(lexicon: Lexicon, name: str = "lex") -> str:
    """The lexicon as rows (topic, ord, weight, kw, pos), duplicates kept."""
    rows = [
        f"('{t.name}', {i}, CAST({t.weight} AS DOUBLE), '{k}', {j})"
        for i, t in enumerate(lexicon.topics)
        for j, k in enumerate(t.keywords)
    ]
    return f"{name}(topic, ord, weight, kw, pos) AS (VALUES {', '.join(rows)})"


HIT_SQL = """hit AS (
  SELECT s.speech_key, s.session_name, s.month, s.d, s.party, l.topic, l.ord, l.weight,
    count(*) FILTER (WHERE contains(lower(s.speech_text), lower(l.kw))) AS n
  FROM speech s CROSS JOIN lex l GROUP BY ALL)"""
