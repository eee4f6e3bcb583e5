"""Topic scores, dominant topics, sentiment and issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill.functions import fields
from speechmill.functions.expr import unnest
from speechmill.operators import lexicon as lx
from speechmill.operators import keyword_index, rollups, sentiment
from speechmill.plans import dataset as ds


def r(name: str, out: str | None = None):
    return F.round(name, 6).alias(out or name)


def counted(spark, sf):
    """Topic counts per speech, with speaker and date but without the text."""
    small = ds.texts(spark, sf).select(
        "speech_key",
        "session_name",
        "file_name",
        fields.korean_date(F.col("date")).alias("d"),
        lx.topic_counts(F.col("speech_text"), ds.TOPICS).alias("topic_counts"),
    )
    return ds.with_speaker(small.withColumn("month", fields.month(F.col("d"))), spark, sf)


def rounded_scores():
    return ["speeches", "hits", "covered", r("score"), r("coverage_pct"), r("hits_per_100")]


def party_scores(spark, sf):
    return lx.topic_scores(counted(spark, sf), ds.TOPICS, ["party"])


def party_topic_scores(spark, sf):
    return rollups.top_topics(party_scores(spark, sf), ["party"]).select("party", "topic", *rounded_scores(), "rank")


def group_rank_in_topic(spark, sf):
    return rollups.group_rank(party_scores(spark, sf), "party").select("topic", "party", r("score"), "rank")


def topic_matches(spark, sf):
    df = unnest(ds.texts(spark, sf), ["speech_key"], lx.topic_matches(F.col("speech_text"), ds.TOPICS))
    return df.select("speech_key", "topic", F.size("matched").alias("n"), F.array_join("matched", ",").alias("matched"))


def dominant_topics(spark, sf):
    df = ds.texts(spark, sf).select("speech_key", lx.topic_counts(F.col("speech_text"), ds.TOPICS).alias("c"))
    return df.select("speech_key", lx.dominant_topic(F.col("c"), ds.TOPICS).alias("topic"))


def topic_examples(spark, sf):
    found = ds.texts(spark, sf).select(
        "speech_key",
        lx.topic_matches(F.col("speech_text"), ds.TOPICS).alias("matches"),
        lx.example_preview(F.col("speech_text")).alias("preview"),
    )
    top = rollups.top_topics(party_scores(spark, sf), ["party"], 1)
    rows = ds.with_speaker(found, spark, sf)
    return lx.topic_examples(rows, "party", ["speech_key"], ["speaker_name", "preview"], top).select(
        "party", "topic", "example", "speech_key", "speaker_name", "preview", F.array_join("matched", ",").alias("matched")
    )


def lexicon_table_scores(spark, sf):
    """Scores per agenda with the lexicon read back from a lexicon table, repeated words dropped."""
    stored = ds.TOPICS.to_table(spark, "sample")
    lexicon = lx.Lexicon.from_table(stored, "sample").deduplicated()
    df = ds.texts(spark, sf).select(
        F.col("agenda_item_titles").alias("agenda"),
        lx.topic_counts(F.col("speech_text"), lexicon).alias("topic_counts"),
    )
    return lx.topic_scores(df, lexicon, ["agenda"]).select("agenda", "topic", *rounded_scores())


def long_lexicon_counts(spark, sf):
    """Hits per speech of a lexicon of 300 words, half of them beginnings of the others."""
    counts = lx.topic_counts(F.col("speech_text"), ds.LONG)
    df = ds.texts(spark, sf).select("speech_key", counts.alias("n"))
    return df.select("speech_key", *[F.get("n", F.lit(i)).cast("long").alias(t) for i, t in enumerate(ds.LONG.names)])


def many_topic_scores(spark, sf):
    """Scores by session of 150 topics, most of which a session may lack."""
    df = ds.texts(spark, sf).select("session_name", lx.topic_counts(F.col("speech_text"), ds.MANY).alias("topic_counts"))
    return lx.topic_scores(df, ds.MANY, ["session_name"]).select(
        "session_name", "topic", "speeches", "hits", "covered", r("score"), r("coverage_pct"), r("hits_per_100")
    )


def indexed_keyword_counts(spark, sf):
    """Keywords found in each speech out of a lexicon made of the benchmark's words, in seven topics."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    lexicon = ds.table(spark, sf, "benchmark").select((F.col("item_id") % 7).alias("topic"), F.explode(words).alias("keyword"))
    speeches = ds.texts(spark, sf).select("speech_key", "speech_text")
    found = keyword_index.matches(speeches, "speech_key", "speech_text", keyword_index.build(lexicon))
    counted = found.groupBy("speech_key").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("topic").alias("topics"))
    every = speeches.select("speech_key").join(counted, "speech_key", "left")
    return every.select("speech_key", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("topics", F.lit(0)).alias("topics"))


def rollup(spark, sf):
    return rollups.topic_rollup(counted(spark, sf), ds.TOPICS, "session_name", "month", "party", "d")


def topic_rollup(spark, sf):
    return rollup(spark, sf).select(
        "level",
        F.coalesce("session_name", F.lit("")).alias("session_name"),
        F.coalesce("month", F.lit("")).alias("month"),
        F.coalesce("party", F.lit("")).alias("party"),
        "topic",
        *rounded_scores(),
    )


def session_topic_scores(spark, sf):
    return rollup(spark, sf).filter(F.col("level") == "session").select(
        "session_name",
        F.concat(F.col("first_date").cast("string"), F.lit(" ~ "), F.col("last_date").cast("string")).alias("dates"),
        "topic",
        "speeches",
        r("score"),
        r("hits_per_100"),
    )


def monthly(spark, sf):
    return rollup(spark, sf).filter(F.col("level") == "month")


def party_monthly(spark, sf):
    return rollup(spark, sf).filter(F.col("level") == "party_month")


def month_extremes(spark, sf):
    return rollups.month_extremes(monthly(spark, sf), "month").select(
        "topic", "max_month", r("max_score"), "min_month", r("min_score"), r("mean_score")
    )


def party_topic_means(spark, sf):
    return rollups.mean_topics(party_monthly(spark, sf), "party", 5).select("party", "topic", r("mean_score"), "rank")


def party_month_series(spark, sf):
    months = ds.texts(spark, sf).select(fields.month(fields.korean_date(F.col("date"))).alias("month"))
    return rollups.dense_series(party_monthly(spark, sf), "party", "month", months).select(
        "party", "topic", "month", r("score")
    )


def judged(spark, sf, lexicon=None):
    small = ds.texts(spark, sf).select(
        "speech_key",
        "session_name",
        fields.month(fields.korean_date(F.col("date"))).alias("month"),
        sentiment.sentiment(F.col("speech_text"), lexicon or ds.WEIGHTED_MOOD).alias("s"),
    )
    return small.select("*", "s.label", "s.score").drop("s")


def sentiment_labels(spark, sf):
    return judged(spark, sf, ds.MOOD).select("speech_key", "label")


def sentiment_scores(spark, sf):
    return judged(spark, sf).select("speech_key", "label", r("score"))


def sentiment_overall(spark, sf):
    return sentiment.label_distribution(judged(spark, sf, ds.MOOD)).select("label", "speeches", r("share_pct"))


def sentiment_by_party(spark, sf):
    rows = ds.with_speaker(judged(spark, sf), spark, sf)
    return sentiment.label_distribution(rows, ["party"]).select("party", "label", "speeches", r("share_pct"))


def sentiment_by_month(spark, sf):
    return sentiment.label_distribution(judged(spark, sf), ["month"], more_than=10).select(
        "month", "label", "speeches", r("share_pct")
    )


def sentiment_tone(spark, sf):
    rows = ds.with_speaker(judged(spark, sf), spark, sf)
    return sentiment.tone(rows, ["party"]).select("party", "speeches", r("mean_score"), "tone")


def sentiment_month_matrix(spark, sf):
    return sentiment.label_matrix(judged(spark, sf), "month")


def sentiment_party_matrix(spark, sf):
    return sentiment.label_matrix(ds.with_speaker(judged(spark, sf), spark, sf), "party")


def mentions(spark, sf):
    rows = ds.texts(spark, sf).withColumn("s", sentiment.sentiment(F.col("speech_text"), ds.WEIGHTED_MOOD))
    found = lx.issue_mentions(
        rows.withColumn("score", F.col("s.score")), ds.ISSUES, "speech_text", ["speech_key", "session_name", "score"]
    )
    return ds.with_speaker(found, spark, sf)


def issue_mentions(spark, sf):
    rows = lx.issue_mentions(ds.texts(spark, sf), ds.ISSUES, "speech_text", ["speech_key", "session_name"])
    return ds.with_speaker(rows, spark, sf).select("issue", "speech_key", "session_name", "speaker_name", "party")


def issue_trends(spark, sf):
    return sentiment.issue_trend(mentions(spark, sf)).select(
        "session_name", "issue", "frequency", r("sentiment_score"), "notes"
    )


QUERIES = {
    f.__name__: f
    for f in (
        party_topic_scores, group_rank_in_topic, topic_matches, dominant_topics, topic_examples, lexicon_table_scores, long_lexicon_counts, many_topic_scores, indexed_keyword_counts,
        topic_rollup, session_topic_scores, month_extremes, party_topic_means, party_month_series, sentiment_labels,
        sentiment_scores, sentiment_overall, sentiment_by_party, sentiment_by_month, sentiment_tone,
        sentiment_month_matrix, sentiment_party_matrix, issue_mentions, issue_trends,
    )
}

# --- the same in SQL ------------------------------------------------------------------------------

_HIT = f"WITH {ds.SPEECH_SQL}, {ds.lexicon_sql(ds.TOPICS)}, {ds.HIT_SQL}"
_MEASURES = """count(*) AS speeches, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (WHERE n > 0) AS covered,
  sum(n) * any_value(weight) / count(*) AS score, count(*) FILTER (WHERE n > 0) / count(*) * 100 AS coverage_pct,
  sum(n) / count(*) * 100 AS hits_per_100"""
_ROUNDED = """speeches, hits, covered, round(score, 6) AS score, round(coverage_pct, 6) AS coverage_pct,
  round(hits_per_100, 6) AS hits_per_100"""
_PARTY = f"{_HIT}, c AS (SELECT party, topic, ord, {_MEASURES} FROM hit GROUP BY party, topic, ord)"
_MONTH = f"{_HIT}, c AS (SELECT month, topic, ord, {_MEASURES} FROM hit GROUP BY month, topic, ord)"
_PARTY_MONTH = f"""{_HIT}, c AS (SELECT party, month, topic, ord, {_MEASURES} FROM hit GROUP BY party, month, topic, ord),
  m AS (SELECT party, topic, ord, avg(score) AS mean_score FROM c GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY round(mean_score, 9) DESC, ord) AS rank FROM m)"""
_FIRST_MATCH = """found AS (SELECT s.speech_key, s.party, s.speaker_name, s.speech_text, l.topic, l.ord, l.kw, l.pos
  FROM speech s JOIN lex l ON contains(lower(s.speech_text), lower(l.kw)))"""


def _mood(lexicon, speech: str = ds.SPEECH_SQL) -> str:
    w = [t.weight for t in lexicon.topics]
    return f"""WITH {speech}, {ds.lexicon_sql(lexicon)}, k AS (
  SELECT s.speech_key, s.session_name, s.month, s.party, s.speaker_name, s.speech_text,
    count(*) FILTER (WHERE l.ord = 0 AND contains(lower(s.speech_text), l.kw)) * {w[0]}::DOUBLE AS p,
    count(*) FILTER (WHERE l.ord = 1 AND contains(lower(s.speech_text), l.kw)) * {w[1]}::DOUBLE AS g,
    count(*) FILTER (WHERE l.ord = 2 AND contains(lower(s.speech_text), l.kw)) * {w[2]}::DOUBLE AS u
  FROM speech s CROSS JOIN lex l GROUP BY ALL), j AS (
  SELECT *, CASE WHEN p > g AND p > u THEN 'positive' WHEN g > p AND g > u THEN 'negative' ELSE 'neutral' END AS label,
    CASE WHEN p > g AND p > u THEN p / (p + g + u) WHEN g > p AND g > u THEN -g / (p + g + u) ELSE 0.0::DOUBLE END AS score
  FROM k)"""


_MOOD = _mood(ds.WEIGHTED_MOOD)
_MATRIX = """count(*) FILTER (WHERE label = 'positive') AS positive, count(*) FILTER (WHERE label = 'negative') AS negative,
  count(*) FILTER (WHERE label = 'neutral') AS neutral"""
_DISTINCT = ds.lexicon_sql(ds.TOPICS.deduplicated())

SQL = {
    "party_topic_scores": f"""{_PARTY}, k AS (SELECT *, row_number() OVER (PARTITION BY party ORDER BY score DESC, ord) AS rank FROM c)
SELECT party, topic, {_ROUNDED}, rank FROM k WHERE rank <= 5""",
    "group_rank_in_topic": f"""{_PARTY} SELECT topic, party, round(score, 6) AS score,
  row_number() OVER (PARTITION BY topic ORDER BY score DESC, party) AS rank FROM c""",
    "topic_matches": f"""WITH {ds.SPEECH_SQL}, {ds.lexicon_sql(ds.TOPICS)}, {_FIRST_MATCH}
SELECT speech_key, topic, count(*) AS n, string_agg(kw, ',' ORDER BY pos) AS matched FROM found GROUP BY speech_key, topic""",
    "dominant_topics": f"""{_HIT}, k AS (SELECT *, row_number() OVER (PARTITION BY speech_key ORDER BY n * weight DESC, ord) AS rn FROM hit)
SELECT speech_key, CASE WHEN n > 0 THEN topic ELSE '기타' END AS topic FROM k WHERE rn = 1""",
    "topic_examples": f"""{_PARTY}, {_FIRST_MATCH}, top AS (SELECT party, topic FROM c
  QUALIFY row_number() OVER (PARTITION BY party ORDER BY score DESC, ord) = 1),
m AS (SELECT party, topic, speech_key, speaker_name, speech_text, string_agg(kw, ',' ORDER BY pos) AS matched
  FROM found SEMI JOIN top USING (party, topic) GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY party, topic ORDER BY speech_key) AS example FROM m)
SELECT party, topic, example, speech_key, speaker_name,
  CASE WHEN length(speech_text) > 100 THEN substring(speech_text, 1, 100) || '...' ELSE speech_text END AS preview, matched
FROM x WHERE example <= 3""",
    "long_lexicon_counts": f"""WITH {ds.lexicon_sql(ds.LONG)} SELECT doc_id AS speech_key,
  count(*) FILTER (WHERE ord = 0 AND contains(lower(text), kw)) AS beginnings, count(*) FILTER (WHERE ord = 1 AND contains(lower(text), kw)) AS whole
FROM documents CROSS JOIN lex GROUP BY doc_id""",
    "many_topic_scores": f"""WITH {ds.SPEECH_SQL}, {ds.lexicon_sql(ds.MANY)}, {ds.HIT_SQL},
c AS (SELECT session_name, topic, {_MEASURES} FROM hit GROUP BY session_name, topic)
SELECT session_name, topic, speeches, hits, covered, round(score, 6) AS score, round(coverage_pct, 6) AS coverage_pct, round(hits_per_100, 6) AS hits_per_100 FROM c""",
    "indexed_keyword_counts": """WITH lex AS (SELECT DISTINCT item_id % 7 AS topic, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS kw FROM benchmark),
hit AS (SELECT d.doc_id, count(*) AS hits, count(DISTINCT topic) AS topics FROM documents d JOIN lex ON contains(lower(d.text), kw) GROUP BY d.doc_id)
SELECT d.doc_id AS speech_key, coalesce(hits, 0) AS hits, coalesce(topics, 0) AS topics FROM documents d LEFT JOIN hit USING (doc_id)""",
    "lexicon_table_scores": f"""WITH {ds.SPEECH_SQL}, {_DISTINCT}, hit AS (
  SELECT s.speech_key, s.agenda_item_titles AS agenda, l.topic, l.ord, l.weight,
    count(*) FILTER (WHERE contains(lower(s.speech_text), lower(l.kw))) AS n
  FROM speech s CROSS JOIN lex l GROUP BY ALL),
c AS (SELECT agenda, topic, {_MEASURES} FROM hit GROUP BY agenda, topic)
SELECT agenda, topic, {_ROUNDED} FROM c""",
    "topic_rollup": f"""{_HIT}, c AS (
  SELECT 'session' AS level, session_name, '' AS month, '' AS party, topic, {_MEASURES} FROM hit GROUP BY session_name, topic
  UNION ALL SELECT 'month', '', month, '', topic, {_MEASURES} FROM hit GROUP BY month, topic
  UNION ALL SELECT 'party_month', '', month, party, topic, {_MEASURES} FROM hit GROUP BY month, party, topic)
SELECT level, session_name, month, party, topic, {_ROUNDED} FROM c""",
    "session_topic_scores": f"""{_HIT}, c AS (SELECT session_name, topic, min(d) AS a, max(d) AS b, {_MEASURES} FROM hit GROUP BY session_name, topic)
SELECT session_name, CAST(a AS VARCHAR) || ' ~ ' || CAST(b AS VARCHAR) AS dates, topic, speeches,
  round(score, 6) AS score, round(hits_per_100, 6) AS hits_per_100 FROM c""",
    "month_extremes": f"""{_MONTH}, h AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, month) AS hi,
  row_number() OVER (PARTITION BY topic ORDER BY score, month) AS lo FROM c)
SELECT topic, max(CASE WHEN hi = 1 THEN month END) AS max_month, round(max(CASE WHEN hi = 1 THEN score END), 6) AS max_score,
  max(CASE WHEN lo = 1 THEN month END) AS min_month, round(max(CASE WHEN lo = 1 THEN score END), 6) AS min_score,
  round(avg(score), 6) AS mean_score FROM h GROUP BY topic""",
    "party_topic_means": f"{_PARTY_MONTH} SELECT party, topic, round(mean_score, 6) AS mean_score, rank FROM t WHERE rank <= 5",
    "party_month_series": f"""{_PARTY_MONTH}, grid AS (SELECT t.party, t.topic, m.month FROM t CROSS JOIN (SELECT DISTINCT month FROM hit) m WHERE rank <= 3)
SELECT g.party, g.topic, g.month, round(coalesce(c.score, 0.0), 6) AS score FROM grid g LEFT JOIN c USING (party, topic, month)""",
    "sentiment_labels": f"{_mood(ds.MOOD)} SELECT speech_key, label FROM j",
    "sentiment_scores": f"{_MOOD} SELECT speech_key, label, round(score, 6) AS score FROM j",
    "sentiment_overall": f"{_mood(ds.MOOD)} SELECT label, count(*) AS speeches, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share_pct FROM j GROUP BY label",
    "sentiment_by_party": f"""{_MOOD} SELECT party, label, count(*) AS speeches,
  round(count(*) / sum(count(*)) OVER (PARTITION BY party) * 100, 6) AS share_pct FROM j GROUP BY party, label""",
    "sentiment_by_month": f"""{_MOOD} SELECT month, label, count(*) AS speeches,
  round(count(*) / sum(count(*)) OVER (PARTITION BY month) * 100, 6) AS share_pct FROM j GROUP BY month, label
  QUALIFY sum(count(*)) OVER (PARTITION BY month) > 10""",
    "sentiment_tone": f"""{_MOOD}, g AS (SELECT party, count(*) AS speeches, avg(score) AS m FROM j GROUP BY party)
SELECT party, speeches, round(m, 6) AS mean_score,
  CASE WHEN m > 0.1 THEN 'positive' WHEN m < -0.1 THEN 'negative' ELSE 'neutral' END AS tone FROM g""",
    "sentiment_month_matrix": f"{_MOOD} SELECT month, {_MATRIX} FROM j GROUP BY month",
    "sentiment_party_matrix": f"{_MOOD} SELECT party, {_MATRIX} FROM j GROUP BY party",
    "issue_mentions": f"""WITH {ds.SPEECH_SQL}, {ds.lexicon_sql(ds.ISSUES)}
SELECT DISTINCT l.topic AS issue, s.speech_key, s.session_name, s.speaker_name, s.party
FROM speech s JOIN lex l ON contains(s.speech_text, l.kw)""",
    "issue_trends": f"""{_MOOD}, {ds.lexicon_sql(ds.ISSUES, 'iss')}, x AS (
  SELECT DISTINCT i.topic AS issue, j.speech_key, j.session_name, j.speaker_name, j.score FROM j JOIN iss i ON contains(j.speech_text, i.kw)),
s AS (SELECT session_name, issue, speaker_name, count(*) AS n FROM x GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY session_name, issue ORDER BY n DESC, speaker_name) AS rn FROM s),
f AS (SELECT session_name, issue, count(*) AS frequency, avg(score) AS m FROM x GROUP BY ALL)
SELECT f.session_name, f.issue, f.frequency, round(f.m, 6) AS sentiment_score,
  (SELECT string_agg(speaker_name, ', ' ORDER BY rn) FROM t WHERE t.rn <= 3 AND t.session_name = f.session_name AND t.issue = f.issue) AS notes
FROM f""",
}
