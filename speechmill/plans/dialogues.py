"""Question-answer pairs, samples and text blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill.functions import text
from speechmill.operators import chunks, dialogue, filters
from speechmill.plans import dataset as ds


def spoken(spark, sf):
    return ds.dialogue(spark, sf).filter(filters.is_substantive(F.col("speech_text")))


def pairs(spark, sf, **options):
    return dialogue.qa_pairs(
        spoken(spark, sf), question_markers=ds.QUESTIONS, answer_markers=ds.ANSWERS, **options
    )


def shown(df):
    return df.select(
        "session_name",
        "question_file",
        "question_order",
        "question_speaker_name",
        "question_party",
        F.col("question_agenda_item_titles").alias("agenda"),
        F.md5("question").alias("question"),
        F.md5("answer").alias("answer"),
        "answer_speaker_name",
    )


def qa_pairs(spark, sf):
    return shown(pairs(spark, sf))


def qa_pairs_within_meeting(spark, sf):
    return shown(pairs(spark, sf, across_files=False))


def qa_pairs_small_blocks(spark, sf):
    """Blocks of two orders, so that most neighbours are matched across block borders."""
    return shown(pairs(spark, sf, block=2))


def speech_qa_pairs(spark, sf):
    """Pairs among the documents, with the speaker joined to the narrowed pairs afterwards."""
    found = dialogue.qa_pairs(
        ds.texts(spark, sf), carry=("speech_key",), question_markers=ds.QUESTIONS, answer_markers=ds.ANSWERS, block=100
    )
    who = ds.speakers(spark, sf).select(F.col("speech_key").alias("question_speech_key"), "party")
    return found.join(who, "question_speech_key").select(
        "session_name", "question_file", "question_order", "question_speech_key", "answer_speech_key", "party",
        F.md5("question").alias("question"), F.md5("answer").alias("answer"),
    )


def sampled(spark, sf):
    small = ds.texts(spark, sf).select(
        "speech_key", "session_name", "file_name", "speech_order", F.substring("speech_text", 1, 300).alias("speech_text")
    )
    return dialogue.session_sample(ds.with_speaker(small, spark, sf))


def session_sample(spark, sf):
    return sampled(spark, sf).select(
        "session_name", "sample_no", "party", "speaker_name", "speech_key", F.md5("speech_text").alias("text")
    )


def leading_agendas(spark, sf):
    return dialogue.leading_agendas(ds.texts(spark, sf)).select(
        "session_name", "agenda_item_titles", "speeches", "agenda_rank"
    )


def agenda_sampled(spark, sf):
    small = ds.texts(spark, sf).select(
        "speech_key", "session_name", "agenda_item_titles", F.substring("speech_text", 1, 400).alias("speech_text")
    )
    rows = ds.with_speaker(small, spark, sf)
    return dialogue.agenda_sample(rows, dialogue.leading_agendas(ds.texts(spark, sf)))


def agenda_sample(spark, sf):
    return agenda_sampled(spark, sf).select(
        "session_name", "agenda_item_titles", "party", "sample_rank", "speech_key", "agenda_speeches"
    )


def agenda_payload(spark, sf):
    nested = dialogue.agenda_payload(
        agenda_sampled(spark, sf), "session_name", "agenda_item_titles", "party", "speech_text"
    )
    return nested.select(
        "session_name",
        "agenda_item_titles",
        F.array_join(F.map_keys("party_speeches"), ",").alias("parties"),
        F.size(F.flatten(F.map_values("party_speeches"))).alias("speeches"),
        F.md5(F.array_join(F.flatten(F.map_values("party_speeches")), "|")).alias("digest"),
    )


def session_payloads(spark, sf):
    """What a session's prompt is made of, as one row: totals, statistics and the sample."""
    rows = ds.with_speaker(ds.texts(spark, sf).select("speech_key", "session_name", "agenda_item_titles"), spark, sf)
    payload = dialogue.session_payload(rows, sampled(spark, sf))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    spoken = F.transform("speeches_sample", lambda x: F.concat_ws("|", x["party"], x["speaker"], x["text"]))
    return payload.select(
        "session_name", "total_speeches", listed("agenda_stats").alias("agendas"), listed("party_stats").alias("parties"),
        F.size("speeches_sample").alias("sampled"), F.md5(F.array_join(spoken, "\n")).alias("digest"),
    )


def session_prompts(spark, sf):
    rows = ds.with_speaker(ds.texts(spark, sf).select("speech_key", "session_name", "agenda_item_titles"), spark, sf)
    prompts = dialogue.session_prompt(rows, sampled(spark, sf), instructions="Answer in JSON.")
    return prompts.select("session_name", F.length("prompt").alias("chars"), F.md5("prompt").alias("digest"))


def agenda_prompts(spark, sf):
    nested = dialogue.agenda_payload(
        agenda_sampled(spark, sf), "session_name", "agenda_item_titles", "party", "speech_text"
    )
    prompts = dialogue.agenda_prompt(nested, "session_name", "agenda_item_titles")
    return prompts.select("session_name", "agenda_item_titles", F.md5("prompt").alias("digest"))


def qa_prompts(spark, sf):
    return dialogue.qa_prompt(pairs(spark, sf)).select("session_name", F.md5("prompt").alias("digest"))


def numbered_pairs(spark, sf):
    return chunks.numbered_pairs(pairs(spark, sf), block=3).select(
        "session_name", "question_file", "question_order", "pair_index"
    )


def text_chunks(spark, sf):
    rows = ds.texts(spark, sf).select(F.col("speech_key").alias("source_id"), F.col("speech_text").alias("text"))
    return chunks.chunk_rows(rows, metadata=None).select(
        "source_id", "chunk_index", "record_id", F.length("content").alias("chars"), F.md5("content").alias("digest")
    )


def page_texts(spark, sf):
    """Page text with and without its line breaks."""
    return ds.table(spark, sf, "pages").select(
        "page_id",
        F.md5(text.markup_text(F.col("html"))).alias("plain"),
        F.md5(text.markup_text(F.col("html"), breaks=True)).alias("with_breaks"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        qa_pairs, qa_pairs_within_meeting, qa_pairs_small_blocks, speech_qa_pairs, session_sample, leading_agendas,
        agenda_sample, agenda_payload, session_payloads, session_prompts, agenda_prompts, qa_prompts, numbered_pairs, text_chunks,
        page_texts,
    )
}

# --- the same in SQL ------------------------------------------------------------------------------

_SPOKEN = f"WITH {ds.DIALOGUE_SQL}, spoken AS (SELECT * FROM dialogue WHERE length({ds.strip_sql('speech_text')}) >= 30)"
_ASKS = f"len(list_filter({ds.words_sql(ds.QUESTIONS)}, lambda m: contains(lower(X), m))) > 0"
_REPLIES = f"len(list_filter({ds.words_sql(ds.ANSWERS)}, lambda m: contains(lower(X), m))) > 0"


def _pairs(source: str, scope: str) -> str:
    return f"""n AS (SELECT *, lead(speech_text) OVER w AS answer, lead(speaker_name) OVER w AS answerer, lead(party) OVER w AS answer_party,
  lead(speech_key) OVER w AS answer_key FROM {source} WINDOW w AS (PARTITION BY {scope} ORDER BY file_name, speech_order)),
pairs AS (SELECT * FROM n WHERE {_ASKS.replace('X', 'speech_text')} AND answer IS NOT NULL AND {_REPLIES.replace('X', 'answer')})"""


_SHOWN = """SELECT session_name, file_name AS question_file, speech_order AS question_order, speaker_name AS question_speaker_name,
  party AS question_party, agenda_item_titles AS agenda, md5(substring(speech_text, 1, 500)) AS question,
  md5(substring(answer, 1, 500)) AS answer, answerer AS answer_speaker_name FROM pairs"""
_ACROSS = f"{_SPOKEN}, {_pairs('spoken', 'session_name')}"
_SAMPLE = f"""WITH {ds.SPEECH_SQL}, ff AS (SELECT session_name, party, min(file_name || '~' || lpad(CAST(speech_order AS VARCHAR), 12, '0')) AS f FROM speech GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY f, party) AS party_rank FROM ff QUALIFY party_rank <= 5),
sr AS (SELECT *, row_number() OVER (PARTITION BY session_name, party ORDER BY md5(speech_key || ':42'), speech_key) AS sample_rank FROM speech QUALIFY sample_rank <= 5),
sample AS (SELECT s.*, row_number() OVER (PARTITION BY s.session_name ORDER BY party_rank, sample_rank) AS sample_no
  FROM sr s JOIN pr USING (session_name, party) QUALIFY sample_no <= 20)"""
_AGENDAS = """ag AS (SELECT session_name, agenda_item_titles, count(*) AS speeches FROM speech GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY speeches DESC, agenda_item_titles) AS agenda_rank FROM ag QUALIFY agenda_rank <= 3)"""
_AGENDA_SAMPLE = f"""WITH {ds.SPEECH_SQL}, {_AGENDAS}, smp AS (SELECT s.*, t.speeches AS agenda_speeches,
  row_number() OVER (PARTITION BY session_name, agenda_item_titles, party ORDER BY md5(speech_key || ':42'), speech_key) AS sample_rank
  FROM speech s JOIN top t USING (session_name, agenda_item_titles) QUALIFY sample_rank <= 5)"""
_UNESCAPED = (
    "replace(replace(replace(replace(replace(replace(replace(replace(X, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'),"
    " '&quot;', '\"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
)


def _markup(x: str) -> str:
    inner = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    return f"trim(regexp_replace({_UNESCAPED.replace('X', inner)}, '{ds.SPACE_SQL}+', ' ', 'g'))"


def _markup_lines(x: str) -> str:
    inner = f"regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '(?i)<br\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    plain = f"replace({_UNESCAPED.replace('X', inner)}, chr(160), ' ')"
    return ds.strip_sql(rf"regexp_replace(regexp_replace({plain}, '\n{ds.SPACE_SQL}*\n+', chr(10), 'g'), '[ \t]+', ' ', 'g')")


SQL = {
    "qa_pairs": f"{_ACROSS} {_SHOWN}",
    "qa_pairs_within_meeting": f"{_SPOKEN}, {_pairs('spoken', 'session_name, file_name')} {_SHOWN}",
    "qa_pairs_small_blocks": f"{_ACROSS} {_SHOWN}",
    "speech_qa_pairs": f"""WITH {ds.SPEECH_SQL}, {_pairs('speech', 'session_name')}
SELECT session_name, file_name AS question_file, speech_order AS question_order, speech_key AS question_speech_key, answer_key AS answer_speech_key,
  party, md5(substring(speech_text, 1, 500)) AS question, md5(substring(answer, 1, 500)) AS answer FROM pairs""",
    "session_sample": f"{_SAMPLE} SELECT session_name, sample_no, party, speaker_name, speech_key, md5(substring(speech_text, 1, 300)) AS text FROM sample",
    "leading_agendas": f"WITH {ds.SPEECH_SQL}, {_AGENDAS} SELECT * FROM top",
    "agenda_sample": f"{_AGENDA_SAMPLE} SELECT session_name, agenda_item_titles, party, sample_rank, speech_key, agenda_speeches FROM smp",
    "agenda_payload": f"""{_AGENDA_SAMPLE}, p AS (SELECT DISTINCT session_name, agenda_item_titles, party FROM smp)
SELECT s.session_name, s.agenda_item_titles, (SELECT string_agg(party, ',' ORDER BY party) FROM p WHERE p.session_name = s.session_name AND p.agenda_item_titles = s.agenda_item_titles) AS parties,
  count(*) AS speeches, md5(string_agg(substring(speech_text, 1, 400), '|' ORDER BY party, sample_rank)) AS digest FROM smp s GROUP BY ALL""",
    "session_payloads": f"""{_SAMPLE}, ac AS (SELECT session_name, agenda_item_titles AS a, count(*) AS n FROM speech WHERE trim(agenda_item_titles) <> '' GROUP BY ALL),
pc AS (SELECT session_name, party AS a, count(*) AS n FROM speech GROUP BY ALL),
agt AS (SELECT session_name, string_agg(a || '=' || n, ';' ORDER BY a) AS agendas FROM ac GROUP BY 1),
pt AS (SELECT session_name, string_agg(a || '=' || n, ';' ORDER BY a) AS parties FROM pc GROUP BY 1),
st AS (SELECT session_name, count(*) AS sampled, md5(string_agg(party || '|' || speaker_name || '|' || substring(speech_text, 1, 300), chr(10) ORDER BY sample_no)) AS digest
  FROM sample WHERE sample_no <= 20 GROUP BY 1),
n AS (SELECT session_name, count(*) AS total_speeches FROM speech GROUP BY 1)
SELECT n.session_name, total_speeches, agendas, parties, sampled, digest FROM n JOIN agt USING (session_name) JOIN pt USING (session_name) JOIN st USING (session_name)""",
    "session_prompts": f"""{_SAMPLE}, ac AS (SELECT session_name, agenda_item_titles AS a, count(*) AS n FROM speech WHERE trim(agenda_item_titles) <> '' GROUP BY session_name, agenda_item_titles
  QUALIFY row_number() OVER (PARTITION BY session_name ORDER BY count(*) DESC, agenda_item_titles) <= 10),
pc AS (SELECT session_name, party AS a, count(*) AS n FROM speech GROUP BY ALL),
agt AS (SELECT session_name, string_agg('- ' || a || ': ' || n || '개 발언', chr(10) ORDER BY n DESC, a) AS t FROM ac GROUP BY 1),
pt AS (SELECT session_name, string_agg('- ' || a || ': ' || n || '개 발언', chr(10) ORDER BY n DESC, a) AS t FROM pc GROUP BY 1),
st AS (SELECT session_name, count(*) AS c, string_agg('[' || sample_no || '] 정당: ' || party || ', 발언자: ' || speaker_name || chr(10) || '발언: ' || substring(speech_text, 1, 300), chr(10) || chr(10) ORDER BY sample_no) AS t FROM sample GROUP BY 1),
n AS (SELECT session_name, count(*) AS n FROM speech GROUP BY 1),
p AS (SELECT n.session_name, '=== 회차 정보 ===' || chr(10) || '회차: ' || n.session_name || chr(10) || '총 발언 수: ' || n.n || '개 (전체의 대표 샘플: ' || st.c || '개)' || chr(10) || chr(10)
  || '=== 안건 통계 ===' || chr(10) || agt.t || chr(10) || chr(10) || '=== 정당별 발언 통계 ===' || chr(10) || pt.t || chr(10) || chr(10)
  || '=== 대표 발언 샘플 ===' || chr(10) || st.t || chr(10) || 'Answer in JSON.' AS prompt
  FROM n JOIN agt USING (session_name) JOIN pt USING (session_name) JOIN st USING (session_name))
SELECT session_name, length(prompt) AS chars, md5(prompt) AS digest FROM p""",
    "agenda_prompts": f"""{_AGENDA_SAMPLE}, l AS (SELECT session_name, agenda_item_titles, agenda_speeches, party,
  '[정당: ' || party || ']' || chr(10) || string_agg(sample_rank || '. ' || substring(speech_text, 1, 400), chr(10) ORDER BY sample_rank) AS s
  FROM smp GROUP BY session_name, agenda_item_titles, agenda_speeches, party)
SELECT session_name, agenda_item_titles, md5('=== 안건 정보 ===' || chr(10) || '안건명: ' || agenda_item_titles || chr(10) || '총 발언 수: ' || agenda_speeches || '개' || chr(10) || chr(10)
  || '=== 정당별 발언 샘플 ===' || chr(10) || string_agg(s, chr(10) || chr(10) ORDER BY party)) AS digest FROM l GROUP BY session_name, agenda_item_titles, agenda_speeches""",
    "qa_prompts": f"""{_ACROSS}, k AS (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY file_name, speech_order) AS i FROM pairs QUALIFY i <= 10)
SELECT session_name, md5('=== 질의-응답 샘플 ===' || chr(10) || string_agg('[질의-응답 ' || i || ']' || chr(10) || '질문자 (' || party || '): ' || speaker_name || chr(10) || '질문: ' || substring(speech_text, 1, 500)
  || chr(10) || '답변자 (' || answer_party || '): ' || answerer || chr(10) || '답변: ' || substring(answer, 1, 500), chr(10) || chr(10) ORDER BY i)) AS digest FROM k GROUP BY session_name""",
    "numbered_pairs": f"""{_ACROSS} SELECT session_name, file_name AS question_file, speech_order AS question_order,
  row_number() OVER (PARTITION BY session_name ORDER BY file_name, speech_order) - 1 AS pair_index FROM pairs""",
    "text_chunks": f"""WITH {ds.SPEECH_SQL}, t AS (SELECT speech_key AS source_id, {ds.strip_sql('speech_text')} AS t FROM speech),
c AS (SELECT source_id, t, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 800 THEN [0] ELSE range(0, length(t), 700) END) AS s FROM t)
SELECT source_id, s // 700 AS chunk_index, source_id || ':' || (s // 700) AS record_id, length(substring(t, CAST(s + 1 AS INTEGER), 800)) AS chars,
  md5(substring(t, CAST(s + 1 AS INTEGER), 800)) AS digest FROM c""",
    "page_texts": f"SELECT page_id, md5({_markup('html')}) AS plain, md5({_markup_lines('html')}) AS with_breaks FROM pages",
}
