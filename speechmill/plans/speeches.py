"""Filters, text functions, area rollups and speaking patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill.functions import fields, text
from speechmill.operators import filters, patterns, rollups
from speechmill.operators import lexicon as lx
from speechmill.plans import dataset as ds
from speechmill.plans.scores import r

EARLY, RECENT = (415, 416), (424, 425, 426)
AREAS = [*ds.TOPICS.names, "기타"]


def reasons(spark, sf):
    """Filter reason and dominant area per speech, decided without moving the text."""
    small = ds.texts(spark, sf).select(
        "speech_key",
        "session",
        "session_name",
        filters.policy_features(F.col("speech_text"), ds.POLICY, ds.PROCEDURAL).alias("features"),
        lx.dominant_topic(lx.topic_counts(F.col("speech_text"), ds.TOPICS), ds.TOPICS).alias("area"),
    )
    return ds.with_speaker(small, spark, sf).withColumn(
        "reason", filters.policy_reason(F.col("features"), F.col("speaker_position"))
    )


def classified(spark, sf):
    return reasons(spark, sf).filter(F.col("reason") == filters.KEEP)


def policy_reasons(spark, sf):
    return filters.reason_counts(reasons(spark, sf)).select("reason", "speeches", r("share_pct"))


def policy_speeches(spark, sf):
    return classified(spark, sf).select("speech_key", "area")


def quality_speeches(spark, sf):
    df = ds.table(spark, sf, "conversations")
    return df.filter(filters.is_substantive(F.col("text"), 200)).select("conv_id", "turn")


def quality_tiles(spark, sf):
    df = ds.table(spark, sf, "conversations")
    return rollups.session_tiles(df, filters.is_substantive(F.col("text"), 200)).select(
        "total_speeches", "quality_speeches", r("kept_pct")
    )


def fingerprint(df, cleaned):
    return df.select("speech_key", F.md5(cleaned).alias("digest"), F.length(cleaned).alias("chars"))


def procedural_removal(spark, sf):
    return fingerprint(ds.texts(spark, sf), text.remove_phrases(F.col("speech_text"), ds.PHRASES))


def conversation_texts(spark, sf):
    cleaned = text.conversation_clean(F.col("speech_text"), ds.FILLERS)
    return fingerprint(filters.cleaned_longer_than(ds.texts(spark, sf), "c", cleaned, 20), F.col("c"))


def plain_texts(spark, sf):
    cleaned = text.plain_clean(F.col("speech_text"))
    return fingerprint(filters.cleaned_longer_than(ds.texts(spark, sf), "c", cleaned, 50), F.col("c"))


def previews(spark, sf):
    body = F.col("speech_text")
    return ds.texts(spark, sf).select(
        "speech_key",
        text.preview(body, 100, "...").alias("short"),
        F.md5(text.preview(body, 300)).alias("cut_300"),
        F.md5(text.preview(body, 500)).alias("cut_500"),
    )


def eligible_speakers(spark, sf):
    """Speeches of named parties whose speaker has at least ten of them."""
    rows = ds.speakers(spark, sf).join(ds.texts(spark, sf).select("speech_key"), "speech_key", "left_semi")
    named = rows.filter(filters.is_named_group(F.col("party")))
    return filters.eligible_groups(named, "speaker_name", 10).select("speech_key", "speaker_name", "party")


def selected_parties(spark, sf):
    rows = filters.select_groups(ds.speakers(spark, sf), "party", ["party_1", "미분류"])
    return rows.groupBy("party").agg(F.count(F.lit(1)).alias("speeches"), F.max("speech_key").alias("last_key"))


def dates_and_months(spark, sf):
    df = ds.texts(spark, sf).select("speech_key", "session_name", fields.korean_date(F.col("date")).alias("d"))
    return df.filter(F.col("d").isNotNull()).select(
        "speech_key",
        F.col("d").cast("string").alias("d"),
        F.year("d").alias("year"),
        F.month("d").alias("month_no"),
        fields.month(F.col("d")).alias("month"),
        fields.session_number(F.col("session_name")).alias("session"),
    )


def parsed_timestamps(spark, sf):
    """Dates of any form: ISO text, another format, and rubbish."""
    ts = F.col("ts")
    shown = (
        F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy/MM/dd"))
        .otherwise(F.concat(F.lit("day "), F.date_format(ts, "dd")))
    )
    df = ds.table(spark, sf, "events").select("event_id", fields.any_date(shown).alias("d"))
    return df.groupBy(F.coalesce(F.col("d").cast("string"), F.lit("none")).alias("d")).agg(
        F.count(F.lit(1)).alias("events")
    )


def token_counts(spark, sf):
    """Sizes and fingerprints of the four tokenisers."""
    body = F.col("speech_text")
    tokens = {
        "pattern": text.pattern_tokens(body, r"[a-zà-ÿ]{2,}"),
        "blank": text.blank_tokens(body),
        "word": text.word_tokens(body),
        "gram": text.one_and_two_grams(body),
    }
    df = ds.texts(spark, sf).select("speech_key", *[t.alias(n) for n, t in tokens.items()])
    return df.select(
        "speech_key",
        *[F.size(n).alias(f"{n}_n") for n in tokens],
        *[F.md5(F.array_join(n, "|")).alias(f"{n}_md5") for n in tokens],
    )


def marks_and_sentences(spark, sf):
    body = F.col("speech_text")
    return ds.texts(spark, sf).select(
        "speech_key",
        text.count_of(body, "!").alias("exclamations"),
        text.count_of(body, "?").alias("questions"),
        F.size(text.sentences(body)).alias("sentences"),
        F.md5(F.array_join(text.sentences(body), "|")).alias("digest"),
    )


def numbers_and_ordinals(spark, sf):
    e = ds.table(spark, sf, "events")
    shown = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit("%")))
        .when(F.col("event_id") % 4 == 1, F.get_json_object("props", "$.k"))
        .when(F.col("event_id") % 4 == 2, F.lit("n/a"))
    )
    level = F.element_at(F.array(*[F.lit(x) for x in ("높음", "중간", "낮음", "?")]), (F.col("user_id") % 4 + 1).cast("int"))
    side = F.element_at(
        F.array(*[F.lit(x) for x in ("지지", "중립", "반대", "비판적", "건의적", "지지적", "?")]),
        (F.col("user_id") % 7 + 1).cast("int"),
    )
    return e.select(
        "event_id",
        fields.number(shown).alias("number"),
        fields.importance(level).alias("importance"),
        fields.stance(side).alias("stance"),
    )


def json_fields(spark, sf):
    e = ds.table(spark, sf, "events").select("event_id", fields.parsed(F.col("props"), "k int, tags array<string>").alias("p"))
    return e.select(
        "event_id",
        F.coalesce("p.k", F.lit(0)).alias("k"),
        F.size(fields.list_or_empty(F.col("p.tags"))).alias("tags"),
        F.to_json(F.struct(F.col("p.k").alias("k"))).alias("again"),
    )


def speaker_party(spark, sf):
    return ds.speakers(spark, sf).groupBy("speaker_name", "party").agg(F.count(F.lit(1)).alias("speeches"))


def session_area_matrix(spark, sf):
    return rollups.area_matrix(classified(spark, sf), "session_name", "area", AREAS)


def area_totals(spark, sf):
    return rollups.counts_with_share(classified(spark, sf), "area").select("area", "speeches", r("share_pct"))


def peak_sessions(spark, sf):
    """Session where each of the five leading areas peaks."""
    cells = classified(spark, sf).groupBy("area", "session").agg(F.count(F.lit(1)).alias("speeches"))
    return rollups.leading_peaks(cells, "area", "session", "speeches", 5)


def area_cohorts(spark, sf):
    return rollups.cohorts(classified(spark, sf), "session", "area", {"early": EARLY, "recent": RECENT}).select(
        "cohort", "area", "speeches", "rank"
    )


def agenda_counts(spark, sf):
    rows = ds.texts(spark, sf).filter(F.trim("agenda_item_titles") != "")
    return rollups.counts_with_share(rows, "agenda_item_titles").select(
        "agenda_item_titles", "speeches", r("share_pct")
    )


def speaker_tallies(spark, sf):
    rows = ds.with_speaker(ds.texts(spark, sf).select("speech_key", "session_name", "file_name"), spark, sf)
    return rollups.speaker_tallies(rows, "session_name", "file_name", "speaker_name", "party")


def load_totals(spark, sf):
    return rollups.load_totals(ds.texts(spark, sf), "file_name", "session_name")


def agenda_party_grid(spark, sf):
    rows = ds.with_speaker(ds.texts(spark, sf).select("speech_key", "session_name", "agenda_item_titles"), spark, sf)
    return rollups.dense_grid(rows, "session_name", "agenda_item_titles", "party", F.count(F.lit(1)), "speeches")


def speaking_patterns(spark, sf):
    """Sums, mean lengths and ratios per named party with at least ten cleaned speeches."""
    cleaned = filters.cleaned_longer_than(
        ds.texts(spark, sf), "c", text.conversation_clean(F.col("speech_text"), ds.FILLERS), 20
    )
    small = cleaned.select(
        "speech_key", patterns.speech_patterns(F.col("c"), ds.FILLERS).alias("patterns")
    )
    rows = ds.with_speaker(small, spark, sf).filter(filters.is_named_group(F.col("party")))
    return patterns.pattern_profile(rows, ["party"], at_least=10).select(
        "party",
        "speeches",
        *patterns.SUMS,
        *[r(c) for c in ("mean_words", "sentences_per_speech", "questions_per_speech", "long_share")],
    )


QUERIES = {
    f.__name__: f
    for f in (
        policy_reasons, policy_speeches, quality_speeches, quality_tiles, procedural_removal, conversation_texts,
        plain_texts, previews, eligible_speakers, selected_parties, dates_and_months, parsed_timestamps, token_counts,
        marks_and_sentences, numbers_and_ordinals, json_fields, speaker_party, session_area_matrix, area_totals,
        peak_sessions, area_cohorts, agenda_counts, speaker_tallies, load_totals, agenda_party_grid, speaking_patterns,
    )
}

# --- the same in SQL ------------------------------------------------------------------------------

_S = f"WITH {ds.SPEECH_SQL}"
_CLEAN = ds.conversation_sql("speech_text")
_AREA = f"""{_S}, {ds.lexicon_sql(ds.TOPICS)}, {ds.HIT_SQL},
area AS (SELECT speech_key, CASE WHEN n > 0 THEN topic ELSE '기타' END AS area FROM hit
  QUALIFY row_number() OVER (PARTITION BY speech_key ORDER BY n * weight DESC, ord) = 1),
why AS (SELECT speech_key, session, session_name, CASE WHEN speech_text IS NULL THEN 'null_text'
  WHEN contains(speaker_position, '위원장') AND len(list_filter({ds.words_sql(ds.PROCEDURAL)}, lambda k: contains(lower(speech_text), k))) > 0 THEN 'procedural'
  WHEN length(lower(speech_text)) < 50 THEN 'short'
  WHEN len(list_filter({ds.words_sql(ds.POLICY)}, lambda k: contains(lower(speech_text), k))) < 2 THEN 'few_policy_words'
  ELSE 'keep' END AS reason FROM speech),
kept AS (SELECT w.speech_key, w.session, w.session_name, a.area FROM why w JOIN area a USING (speech_key) WHERE reason = 'keep')"""
_GRAMS = r"""regexp_extract_all(lower(speech_text), '[\p{L}\p{N}_]{2,}')"""
_SENTENCES = f"""list_filter(list_transform(string_split_regex(X, '[.!?]'), lambda s: {ds.strip_sql('s')}), lambda s: length(s) > 5)"""


def _phrases(x: str) -> str:
    for p in ds.PHRASES:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return ds.strip_sql(x)


def _digest(source: str, where: str = "") -> str:
    return f"{_S}, c AS (SELECT speech_key, {source} AS c FROM speech) SELECT speech_key, md5(c) AS digest, length(c) AS chars FROM c {where}"


SQL = {
    "policy_reasons": f"{_AREA} SELECT reason, count(*) AS speeches, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share_pct FROM why GROUP BY reason",
    "policy_speeches": f"{_AREA} SELECT speech_key, area FROM kept",
    "quality_speeches": f"SELECT conv_id, turn FROM conversations WHERE length({ds.strip_sql('text')}) >= 200",
    "quality_tiles": f"""SELECT count(*) AS total_speeches, count(*) FILTER (WHERE length({ds.strip_sql('text')}) >= 200) AS quality_speeches,
  round(count(*) FILTER (WHERE length({ds.strip_sql('text')}) >= 200) * 100 / count(*), 6) AS kept_pct FROM conversations""",
    "procedural_removal": _digest(_phrases("speech_text")),
    "conversation_texts": _digest(_CLEAN, "WHERE length(c) > 20"),
    "plain_texts": _digest(ds.plain_sql("speech_text"), "WHERE length(c) > 50"),
    "previews": f"""{_S} SELECT speech_key, CASE WHEN length(speech_text) > 100 THEN substring(speech_text, 1, 100) || '...' ELSE speech_text END AS short,
  md5(substring(speech_text, 1, 300)) AS cut_300, md5(substring(speech_text, 1, 500)) AS cut_500 FROM speech""",
    "eligible_speakers": f"""{_S} SELECT speech_key, speaker_name, party FROM speech WHERE party <> '미분류'
  QUALIFY count(*) OVER (PARTITION BY speaker_name) >= 10""",
    "selected_parties": """SELECT CASE WHEN user_id % 7 = 0 THEN '미분류' ELSE 'party_' || (user_id % 5) END AS party,
  count(*) AS speeches, max(event_id) AS last_key FROM events GROUP BY 1 HAVING party IN ('party_1', '미분류')""",
    "dates_and_months": f"""{_S} SELECT speech_key, CAST(d AS VARCHAR) AS d, year(d) AS year, month(d) AS month_no, month, session FROM speech""",
    "parsed_timestamps": """SELECT CASE WHEN event_id % 3 = 2 THEN 'none' ELSE strftime(ts, '%Y-%m-%d') END AS d, count(*) AS events FROM events GROUP BY 1""",
    "token_counts": rf"""{_S}, t AS (SELECT speech_key, regexp_extract_all(speech_text, '[a-zà-ÿ]{{2,}}') AS a,
  list_filter(string_split_regex(speech_text, '{ds.SPACE_SQL}+'), lambda w: length(w) >= 3) AS b, {_GRAMS} AS c FROM speech),
g AS (SELECT *, list_concat(c, CASE WHEN len(c) > 1 THEN list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1]) ELSE [] END) AS g FROM t)
SELECT speech_key, len(a) AS pattern_n, len(b) AS blank_n, len(c) AS word_n, len(g) AS gram_n,
  md5(array_to_string(a, '|')) AS pattern_md5, md5(array_to_string(b, '|')) AS blank_md5,
  md5(array_to_string(c, '|')) AS word_md5, md5(array_to_string(g, '|')) AS gram_md5 FROM g""",
    "marks_and_sentences": f"""{_S}, t AS (SELECT speech_key, length(speech_text) - length(replace(speech_text, '!', '')) AS exclamations,
  length(speech_text) - length(replace(speech_text, '?', '')) AS questions, {_SENTENCES.replace('X', 'speech_text')} AS s FROM speech)
SELECT speech_key, exclamations, questions, len(s) AS sentences, md5(array_to_string(s, '|')) AS digest FROM t""",
    "numbers_and_ordinals": """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE 0 END AS number,
  CASE user_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END AS importance,
  CASE user_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN -2 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS stance FROM events""",
    "json_fields": """SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS INTEGER) AS k, 0 AS tags,
  '{"k":' || json_extract_string(props, '$.k') || '}' AS again FROM events""",
    "speaker_party": """SELECT 'u' || user_id AS speaker_name, CASE WHEN user_id % 7 = 0 THEN '미분류' ELSE 'party_' || (user_id % 5) END AS party,
  count(*) AS speeches FROM events GROUP BY 1, 2""",
    "session_area_matrix": f"""{_AREA} SELECT session_name, session AS session_num, {', '.join(f"count(*) FILTER (WHERE area = '{a}') AS {a}" for a in AREAS)}
FROM kept GROUP BY session_name, session""",
    "area_totals": f"{_AREA} SELECT area, count(*) AS speeches, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share_pct FROM kept GROUP BY area",
    "peak_sessions": f"""{_AREA}, lead AS (SELECT area FROM kept GROUP BY area ORDER BY count(*) DESC, area LIMIT 5),
c AS (SELECT area, session, count(*) AS n FROM kept SEMI JOIN lead USING (area) GROUP BY ALL)
SELECT area, session AS peak_session, n AS peak_value FROM c QUALIFY row_number() OVER (PARTITION BY area ORDER BY n DESC, session) = 1""",
    "area_cohorts": f"""{_AREA}, c AS (SELECT CASE WHEN session IN (415, 416) THEN 'early' WHEN session IN (424, 425, 426) THEN 'recent' END AS cohort, area,
  count(*) AS speeches FROM kept GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY speeches DESC, area) AS rank FROM c WHERE cohort IS NOT NULL)
SELECT cohort, area, speeches, rank FROM k WHERE rank <= 3""",
    "agenda_counts": f"""{_S} SELECT agenda_item_titles, count(*) AS speeches, round(count(*) / sum(count(*)) OVER () * 100, 6) AS share_pct
FROM speech WHERE trim(agenda_item_titles) <> '' GROUP BY 1""",
    "speaker_tallies": f"""{_S}, seen AS (SELECT DISTINCT session_name, file_name, speaker_name, party FROM speech)
SELECT 'all' AS scope, 'speakers' AS measure, '' AS party, count(DISTINCT speaker_name) AS n FROM speech
UNION ALL SELECT session_name, 'speakers', '', count(DISTINCT speaker_name) FROM speech GROUP BY session_name
UNION ALL SELECT session_name, 'party', party, count(*) FROM seen GROUP BY session_name, party
UNION ALL SELECT 'all', 'party', party, count(*) FROM seen GROUP BY party""",
    "load_totals": f"{_S} SELECT file_name, session_name, count(*) AS rows FROM speech GROUP BY 1, 2",
    "agenda_party_grid": f"""{_S}, a AS (SELECT DISTINCT session_name, agenda_item_titles FROM speech), p AS (SELECT DISTINCT session_name, party FROM speech),
c AS (SELECT session_name, agenda_item_titles, party, count(*) AS n FROM speech GROUP BY ALL)
SELECT session_name, agenda_item_titles, party, coalesce(n, 0) AS speeches FROM a JOIN p USING (session_name) LEFT JOIN c USING (session_name, agenda_item_titles, party)""",
    "speaking_patterns": f"""{_S}, c AS (SELECT speech_key, party, {_CLEAN} AS c FROM speech WHERE party <> '미분류'),
f AS (SELECT *, {ds.conversation_sql('c')} AS c2, {_SENTENCES.replace('X', 'c')} AS s FROM c WHERE length(c) > 20),
w AS (SELECT speech_key, count(*) FILTER (WHERE n >= 3) AS rep FROM (
  SELECT speech_key, w, count(*) AS n FROM (SELECT speech_key, unnest(string_split(c2, ' ')) AS w FROM f) WHERE w <> '' GROUP BY ALL) GROUP BY speech_key),
p AS (SELECT party, count(*) AS speeches, sum(length(c) - length(replace(c, '?', '')))::BIGINT AS questions,
  sum(length(c) - length(replace(c, '!', '')))::BIGINT AS exclamations, sum(len(s))::BIGINT AS sentences,
  sum(len(list_filter(s, lambda x: length(x) > 30)))::BIGINT AS long_sentences,
  sum(len(list_filter(s, lambda x: length(x) <= 10)))::BIGINT AS short_sentences,
  sum(coalesce(rep, 0))::BIGINT AS repeated_words, avg(len(string_split(c, ' '))) AS mean_words
  FROM f LEFT JOIN w USING (speech_key) GROUP BY party HAVING count(*) >= 10)
SELECT party, speeches, questions, exclamations, sentences, long_sentences, short_sentences, repeated_words,
  round(mean_words, 6) AS mean_words, round(sentences / speeches, 6) AS sentences_per_speech,
  round(questions / speeches, 6) AS questions_per_speech, round(coalesce(long_sentences / nullif(sentences, 0), 0), 6) AS long_share FROM p""",
}
