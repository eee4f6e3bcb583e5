"""Session studies: analysis answers, stored rows, retrieval chunks and chart tables.

The answers that an outside service would give are assembled by Spark from the given tables, one
JSON text per session or agenda, in the shapes such a service returns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmill.operators import answers, chunks, dialogue
from speechmill.plans import dataset as ds
from speechmill.plans.dialogues import pairs
from speechmill.plans.scores import r
from speechmill.session import kept, run_folder
from speechmill.sources import tables

LEVELS = ("높음", "중간", "낮음", "보통")


def speech_facts(spark, sf):
    keys = ds.texts(spark, sf).select("speech_key", "session", "session_name", F.col("agenda_item_titles").alias("agenda_title"))
    return ds.with_speaker(keys, spark, sf)


def party_facts(spark, sf):
    """Per session, agenda and party: speeches, smallest and largest key. Stored, as all answers are formed from it."""
    facts = speech_facts(spark, sf).groupBy("session_name", "session", "agenda_title", "party").agg(
        F.count(F.lit(1)).alias("n"), F.min("speech_key").alias("lo"), F.max("speech_key").alias("hi")
    )
    return kept(facts, "party-facts")


def details():
    """What an answer says about a party; null fields are absent from the JSON."""
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    return F.struct(
        F.when(n % 3 == 0, "지지").when(n % 3 == 1, "비판적").alias("stance"),
        F.when(n % 3 == 2, "반대").alias("position"),
        F.array(F.concat(F.lit("n="), n.cast("string")), F.concat(F.lit("lo="), lo.cast("string"))).alias("key_points"),
        F.when(hi % 2 == 0, F.array(F.concat(F.lit("hi="), hi.cast("string")))).alias("concerns"),
        F.when(n > 1, F.array(F.lit("more"))).alias("suggestions"),
        F.when(lo % 3 == 0, F.concat(F.lit("said "), lo.cast("string"))).alias("key_statements"),
    )


def agenda_answers(facts):
    listed = facts.select("session_name", "agenda_title", "party", "n", details().alias("d"))
    grouped = listed.groupBy("session_name", "agenda_title").agg(
        F.sum("n").alias("n"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("party", "d")))).alias("party_positions"),
    )
    body = F.struct(
        "party_positions",
        F.array(F.concat(F.lit("agree "), F.col("agenda_title"))).alias("consensus_points"),
        F.when(F.col("n") % 2 == 0, F.array(F.lit("differ"))).alias("conflict_points"),
        F.lit("중간").alias("cooperation_level"),
        F.when(F.col("n") % 3 == 0, F.lit("in short")).alias("summary"),
    )
    return grouped.select("session_name", "agenda_title", F.to_json(body).alias("answer"))


def positions(facts):
    return answers.position_rows(agenda_answers(facts))


def agenda_records_of(facts):
    return answers.agenda_records(answers.agenda_rows(agenda_answers(facts)))


def summary_parts(facts):
    """Per session: issues from its leading agendas, views of its parties, one conflict."""
    top = dialogue.leading_agendas(facts, agenda="agenda_title", k=4, speeches=F.sum("n"))
    issues = top.groupBy("session_name").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "agenda_rank",
                    F.struct(
                        F.col("agenda_title").alias("issue"),
                        F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("agenda_rank") - 1).alias("importance"),
                        F.concat(F.col("speeches").cast("string"), F.lit(" speeches")).alias("description"),
                        F.when(F.col("agenda_rank") < 3, F.array(F.lit("party_1"), F.lit("party_2"))).alias(
                            "mentioned_parties"
                        ),
                    ).alias("i"),
                )
            )
        ).alias("i")
    )
    parties = facts.groupBy("session_name", "session", "party").agg(F.sum("n").alias("n"))
    view = F.struct(
        F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("n") % 3).cast("int")).alias("main_concerns"),
        F.when(F.col("n") % 2 == 0, "비판적").alias("stance"),
    )
    views = parties.groupBy("session_name", "session").agg(
        F.sum("n").alias("n"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("party", view)))).alias("views"),
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "party"))).alias("ranked"),
    )
    conflict = F.struct(
        F.lit("who speaks").alias("topic"),
        F.transform(F.slice("ranked", 1, 2), lambda p: p["party"]).alias("parties_involved"),
        F.lit("토론").alias("nature"),
    )
    event = F.struct(F.lit("sitting").alias("event"), F.col("session_name").alias("description"), F.lit("held").alias("response"))
    return views.join(issues, "session_name").select(
        "session_name",
        "session",
        "n",
        F.transform("i", lambda x: x["i"]).alias("key_issues"),
        "views",
        F.array(conflict).alias("major_conflicts"),
        F.array(event).alias("key_events"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("about "), F.col("session_name"))).alias("characteristics"),
    )


def summary_answers(facts):
    body = F.struct(
        "key_issues",
        F.col("views").alias("party_positions"),
        "major_conflicts",
        "key_events",
        F.col("characteristics").alias("session_characteristics"),
    )
    return summary_parts(facts).select("session_name", F.to_json(body).alias("answer"))


def documents(spark, sf):
    """Stored result documents: the older shape for even session numbers, the newer for odd ones."""
    facts = party_facts(spark, sf)
    parts = summary_parts(facts)
    listed = facts.select("session_name", "agenda_title", "party", details().alias("d"))
    per_agenda = listed.groupBy("session_name", "agenda_title").agg(
        F.sort_array(F.collect_list(F.struct("party", "d"))).alias("p")
    )
    per_session = per_agenda.groupBy("session_name").agg(
        F.sort_array(F.collect_list(F.struct("agenda_title", "p"))).alias("a")
    )
    as_map = F.map_from_entries(
        F.transform(
            "a", lambda a: F.struct(a["agenda_title"], F.struct(F.map_from_entries(a["p"]).alias("party_positions")))
        )
    )
    as_list = F.transform(
        "a",
        lambda a: F.struct(
            a["agenda_title"].alias("agenda_title"),
            F.transform(
                a["p"],
                lambda p: F.struct(
                    p["party"].alias("party_name"),
                    F.coalesce(p["d"]["stance"], p["d"]["position"]).alias("stance_label"),
                    p["d"]["key_points"].alias("key_points"),
                    p["d"]["concerns"].alias("concerns"),
                    p["d"]["suggestions"].alias("suggestions"),
                    p["d"]["key_statements"].alias("summary_text"),
                ),
            ).alias("party_positions"),
        ),
    )
    share = F.concat((F.col("n") % 100).cast("string"), F.lit("%"))
    quality = F.create_map(F.lit("high"), share, F.lit("medium"), (F.col("n") % 7).cast("string"))
    types = F.create_map(F.lit("criticism"), F.lit("n/a"), F.lit("suggestion"), share)
    head = [F.col("session_name"), F.col("n").alias("total_speeches"), (F.col("n") - 1).alias("quality_speeches")]
    older = F.to_json(
        F.struct(
            *head,
            F.struct(
                "key_issues", F.col("views").alias("party_positions"), "major_conflicts", "key_events",
                F.col("characteristics").alias("session_characteristics"),
            ).alias("session_summary"),
            as_map.alias("party_positions"),
            F.struct(
                F.lit(10).alias("total_qa_pairs"), F.col("n").alias("qa_pairs_count"),
                quality.alias("quality_distribution"), types.alias("question_types"),
            ).alias("qa_analysis"),
        )
    )
    newer = F.to_json(
        F.struct(
            *head,
            F.struct(
                "key_issues",
                F.col("characteristics").alias("raw_summary"),
                F.struct(F.col("views").alias("party_positions_overview"), "major_conflicts", "key_events").alias("metadata"),
            ).alias("session_summary"),
            as_list.alias("party_positions"),
            F.struct(
                F.col("n").alias("total_qa_pairs"), quality.alias("quality_distribution"), types.alias("question_types")
            ).alias("qa_analysis"),
        )
    )
    value = F.when(F.col("session") % 2 == 0, older).otherwise(newer)
    raw = parts.join(per_session, "session_name").select(value.alias("value"))
    return answers.result_documents(
        raw.select(F.from_json("value", answers.RESULT_DOCUMENT).alias("d")).select("d.*")
    )


# --- queries --------------------------------------------------------------------------------------


def shown_positions(df):
    return df.select(
        "session_name",
        "agenda_title",
        "party_name",
        "stance_label",
        F.array_join("key_points", "|").alias("key_points"),
        F.array_join("concerns", "|").alias("concerns"),
        F.array_join("suggestions", "|").alias("suggestions"),
        F.coalesce("summary_text", F.lit("")).alias("summary_text"),
    )


def position_rows(spark, sf):
    return shown_positions(positions(party_facts(spark, sf)))


def document_positions(spark, sf):
    return shown_positions(answers.document_positions(documents(spark, sf)))


def agenda_records(spark, sf):
    return agenda_records_of(party_facts(spark, sf))


def position_records(spark, sf):
    """Stored rows of positions; agendas whose record has no summary of its own are not stored."""
    facts = party_facts(spark, sf)
    agendas = answers.agenda_records(
        answers.agenda_rows(agenda_answers(facts)).filter(F.col("summary").isNotNull())
    )
    return answers.position_records(positions(facts), agendas).select(
        "agenda_id", "session_name", "party_name", "stance_label", "summary_text"
    )


def summary_rows(spark, sf):
    return answers.summary_rows(summary_answers(party_facts(spark, sf))).select(
        "session_name",
        F.size("key_issues").alias("issues"),
        F.size("party_views").alias("parties"),
        F.coalesce("raw_summary", F.lit("")).alias("raw_summary"),
        F.size("major_conflicts").alias("conflicts"),
        F.size("key_events").alias("events"),
    )


def session_records(spark, sf):
    from speechmill.plans.upkeep import digests

    facts = party_facts(spark, sf)
    named = F.when(F.col("party") != "미분류", F.col("n")).otherwise(0)
    totals = facts.groupBy("session_name").agg(F.sum("n").alias("total_speeches"), F.sum(named).alias("quality_speeches"))
    rows = answers.session_records(
        answers.summary_rows(summary_answers(facts)), totals, digests(spark, sf), "v1"
    )
    return rows.select("session_id", "session_name", "analysis_version", "summary_text", "metadata")


def stored_session_metadata(spark, sf):
    """What a stored session tells of its summary and its questions and answers, read back from the metadata."""
    from speechmill.plans.upkeep import digests

    facts = party_facts(spark, sf)
    totals = facts.groupBy("session_name").agg(F.sum("n").alias("total_speeches"), F.lit(0).alias("quality_speeches"))
    metrics = answers.qa_metric_rows(qa_metric_answers(spark, sf), pairs(spark, sf))
    rows = answers.session_records(answers.summary_rows(summary_answers(facts)), totals, digests(spark, sf), "v1", metrics, whole=True)
    schema = (
        f"total_speeches long, session_summary struct<raw_summary:string,key_issues:array<{answers.ISSUE}>,metadata:struct<"
        f"party_positions_overview:map<string,{answers.PARTY_VIEW}>,key_events:array<{answers.EVENT}>>>, "
        "qa_metrics struct<total_qa_pairs:int,quality_distribution:map<string,string>>"
    )
    m = rows.select("session_name", F.from_json("metadata", schema).alias("m"))
    return m.select(
        "session_name",
        "m.total_speeches",
        F.col("m.session_summary.key_issues")[0]["issue"].alias("first_issue"),
        F.coalesce("m.session_summary.raw_summary", F.lit("")).alias("raw_summary"),
        F.size("m.session_summary.metadata.party_positions_overview").alias("parties"),
        F.size("m.session_summary.metadata.key_events").alias("events"),
        F.coalesce("m.qa_metrics.total_qa_pairs", F.lit(-1)).alias("total_qa_pairs"),
        F.coalesce(F.col("m.qa_metrics.quality_distribution")["high"], F.lit("")).alias("high"),
    )


def unreadable_answers(spark, sf):
    """Sessions whose answers were cut off or are no JSON; of the agendas' answers, every one of a session."""
    number = F.regexp_extract("session_name", r"(\d+)", 1).cast("int")
    broken = F.when(number % 4 == 1, F.expr("left(answer, length(answer) - 1)")).when(number % 4 == 2, "not json{").otherwise(F.col("answer"))
    facts = party_facts(spark, sf)
    summaries = summary_answers(facts).withColumn("answer", broken)
    agendas = agenda_answers(facts).withColumn("answer", F.when(number % 4 == 3, F.lit("[1]")).otherwise(F.col("answer")))
    return answers.unreadable_sessions(summaries, agendas)


def summary_documents(spark, sf):
    docs = chunks.summary_documents(answers.summary_rows(summary_answers(party_facts(spark, sf))))
    return docs.select("source_id", F.md5("text").alias("digest"), F.col("metadata")["source_type"].alias("source_type"))


def position_documents(spark, sf):
    facts = party_facts(spark, sf)
    docs = chunks.position_documents(positions(facts), agenda_records_of(facts))
    return docs.select("source_id", F.md5("text").alias("digest"), F.col("metadata")["agenda_id"].alias("agenda_id"))


def spoken_agendas(spark, sf):
    """Agenda records of the dialogue's agendas."""
    named = ds.dialogue(spark, sf).select("session_name", F.col("agenda_item_titles").alias("agenda_title")).distinct()
    return answers.agenda_records(answers.agenda_rows(named.withColumn("answer", F.lit("{}"))))


def qa_records(spark, sf):
    return answers.qa_records(pairs(spark, sf), spoken_agendas(spark, sf)).select(
        "qa_id", "agenda_id", "questioner", "respondent", F.md5("question_text").alias("question"), "metadata"
    )


def qa_documents(spark, sf):
    docs = chunks.qa_documents(pairs(spark, sf), spoken_agendas(spark, sf))
    return docs.select("source_id", F.md5("text").alias("digest"), F.col("metadata")["agenda_id"].alias("agenda_id"))


def qa_chunks(spark, sf):
    """Retrieval rows of the question-answer documents."""
    cut = chunks.chunk_rows(chunks.qa_documents(pairs(spark, sf), spoken_agendas(spark, sf)))
    return chunks.rag_rows(cut).select("document_id", "source_type", "source_id", "chunk_index", "content_hash")


def qa_metric_answers(spark, sf):
    """Metrics per session; the service left the pair count out and gave no name for some."""
    counted = pairs(spark, sf).groupBy("session_name").agg(F.count(F.lit(1)).alias("n"))
    body = F.struct(
        F.when(F.col("n") % 2 == 0, F.col("n") + 1).alias("total_qa_pairs"),
        F.create_map(F.lit("high"), F.lit("40%")).alias("quality_distribution"),
        F.array(F.lit("shorter")).alias("improvement_suggestions"),
    )
    return counted.select("session_name", F.to_json(body).alias("answer"))


def qa_metrics(spark, sf):
    return answers.qa_metric_rows(qa_metric_answers(spark, sf), pairs(spark, sf)).select(
        "session_name",
        "total_qa_pairs",
        F.col("quality_distribution")["high"].alias("high"),
        F.size("question_types").alias("types"),
        F.size("improvement_suggestions").alias("suggestions"),
    )


def document_files(spark, sf):
    """Documents assembled from their tables, written as files in both shapes, read back and taken apart."""
    facts = party_facts(spark, sf)
    heads = summary_parts(facts).select(
        "session_name",
        F.col("n").cast("int").alias("total_speeches"),
        (F.col("n") - 1).cast("int").alias("quality_speeches"),
        F.lit("2024-01-01T00:00:00").alias("analysis_timestamp"),
        (F.col("session") % 2 == 1).alias("as_list"),
    )
    summaries = summary_answers(facts).select("session_name", F.col("answer").alias("session_summary"))
    metrics = heads.select("session_name", F.to_json(F.struct(F.col("total_speeches").alias("total_qa_pairs"))).alias("qa_analysis"))
    path = run_folder(spark, "result-documents")
    tables.write_document_texts(answers.assembled_documents(heads, positions(facts), summaries, metrics), path)
    read = tables.read_documents(spark, f"{path}-absent", path)
    tiles = answers.tiles(read).select("session_name", "total_speeches", "issues", "qa_pairs")
    return shown_positions(answers.document_positions(read)).join(tiles, "session_name")


def document_tiles(spark, sf):
    return answers.tiles(documents(spark, sf))


def document_issues(spark, sf):
    """Issues by importance, most important first inside a session."""
    return answers.issue_rows(documents(spark, sf)).select(
        "session_name", "pos", "issue", "importance", "description", F.array_join("parties", ",").alias("parties"), "rank"
    )


def concern_counts(spark, sf):
    return answers.concern_counts(documents(spark, sf))


def quality_shares(spark, sf):
    docs = documents(spark, sf)
    quality = answers.shares(docs, "quality_distribution", answers.QUALITY_LABELS)
    types = answers.shares(docs, "question_types", answers.QUESTION_LABELS)
    return quality.unionByName(types).select("session_name", "label", r("value"))


def stance_matrix(spark, sf):
    return answers.stance_matrix(positions(party_facts(spark, sf)))


def conflict_nodes(spark, sf):
    return answers.conflict_nodes(documents(spark, sf))


def conflict_edges(spark, sf):
    return answers.conflict_edges(documents(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        position_rows, document_positions, agenda_records, position_records, summary_rows, session_records, stored_session_metadata,
        unreadable_answers,
        summary_documents, position_documents, qa_records, qa_documents, qa_chunks, qa_metrics, document_files, document_tiles,
        document_issues, concern_counts, quality_shares, stance_matrix, conflict_nodes, conflict_edges,
    )
}

# --- the same in SQL ------------------------------------------------------------------------------

from speechmill.plans.dialogues import _ACROSS  # noqa: E402

_NL = "chr(10)"
_SEP = "chr(31)"


def _key(*parts: str) -> str:
    return f"sha256({f' || {_SEP} || '.join(parts)})"


_POS = f"""WITH {ds.SPEECH_SQL}, pf AS (SELECT session_name, session, agenda_item_titles AS agenda_title, party AS party_name, count(*) AS n,
  min(speech_key) AS lo, max(speech_key) AS hi FROM speech GROUP BY ALL),
pos AS (SELECT session_name, agenda_title, party_name, CASE n % 3 WHEN 0 THEN '지지' WHEN 1 THEN '비판적' ELSE '반대' END AS stance_label,
  'n=' || n || '|lo=' || lo AS key_points, CASE WHEN hi % 2 = 0 THEN 'hi=' || hi ELSE '' END AS concerns,
  CASE WHEN n > 1 THEN 'more' ELSE '' END AS suggestions, CASE WHEN lo % 3 = 0 THEN 'said ' || lo ELSE '' END AS summary_text FROM pf),
ag AS (SELECT session_name, agenda_title, CAST(sum(n) AS BIGINT) AS n FROM pf GROUP BY ALL),
rec AS (SELECT {_key("'agenda'", 'session_name', 'agenda_title')} AS agenda_id, {_key("'session'", 'session_name')} AS session_id, session_name, agenda_title,
  CASE WHEN n % 3 = 0 THEN 'in short' ELSE 'agree ' || agenda_title || CASE WHEN n % 2 = 0 THEN {_NL} || 'differ' ELSE '' END END AS summary_text,
  '{{"consensus_points":["agree ' || agenda_title || '"],"conflict_points":[' || CASE WHEN n % 2 = 0 THEN '"differ"' ELSE '' END || '],"cooperation_level":"중간"}}' AS metadata, n FROM ag)"""
_BULLETS = """CASE WHEN X <> '' THEN '- ' || replace(X, '|', chr(10) || '- ') END"""
_SUM = f"""WITH {ds.SPEECH_SQL}, tot AS (SELECT session_name, session, count(*) AS n FROM speech GROUP BY ALL),
ac AS (SELECT session_name, agenda_item_titles AS issue, count(*) AS n FROM speech GROUP BY ALL),
iss AS (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY n DESC, issue) AS rk FROM ac QUALIFY rk <= 4),
pv AS (SELECT session_name, party, count(*) AS n FROM speech GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY n DESC, party) AS rk FROM pv)"""
_LEVEL = "CASE rk WHEN 1 THEN '높음' WHEN 2 THEN '중간' WHEN 3 THEN '낮음' ELSE '보통' END"
_QA = f"""{_ACROSS}, x AS (SELECT *, {_key("'qa'", 'session_name', 'file_name', 'CAST(speech_order AS VARCHAR)')} AS qa_id,
  {_key("'agenda'", 'session_name', 'agenda_item_titles')} AS agenda_id,
  row_number() OVER (PARTITION BY session_name ORDER BY file_name, speech_order) - 1 AS i,
  substring(speech_text, 1, 500) AS q, substring(answer, 1, 500) AS a FROM pairs),
doc AS (SELECT *, 'session::' || session_name || '::qa::' || i AS source_id, '[질문자] ' || speaker_name || ' (' || party || ')' || {_NL} || '[질문]' || {_NL} || q || {_NL} || {_NL}
  || '[답변자] ' || answerer || ' (' || answer_party || ')' || {_NL} || '[답변]' || {_NL} || a AS text FROM x)"""

_METRICS = f"""{_ACROSS} SELECT session_name, count(*) + CASE WHEN count(*) % 2 = 0 THEN 1 ELSE 0 END AS total_qa_pairs, '40%' AS high, 0 AS types, 1 AS suggestions
FROM pairs GROUP BY session_name"""

SQL = {
    "position_rows": f"{_POS} SELECT * FROM pos",
    "document_positions": f"{_POS} SELECT * FROM pos",
    "document_files": f"""{_POS}, t AS (SELECT session_name, CAST(count(*) AS INTEGER) AS total_speeches, CAST(least(count(DISTINCT agenda_item_titles), 4) AS INTEGER) AS issues,
  CAST(count(*) AS INTEGER) AS qa_pairs FROM speech GROUP BY session_name) SELECT * FROM pos JOIN t USING (session_name)""",
    "agenda_records": f"{_POS} SELECT agenda_id, session_id, session_name, agenda_title, summary_text, metadata FROM rec",
    "position_records": f"""{_POS} SELECT r.agenda_id, p.session_name, p.party_name, p.stance_label,
  CASE WHEN p.summary_text <> '' THEN p.summary_text ELSE replace(key_points, '|', {_NL}) || CASE WHEN concerns <> '' THEN {_NL} || concerns ELSE '' END
  || CASE WHEN suggestions <> '' THEN {_NL} || suggestions ELSE '' END END AS summary_text
FROM pos p JOIN rec r USING (session_name, agenda_title) WHERE r.n % 3 = 0""",
    "summary_rows": f"""{_SUM} SELECT t.session_name, (SELECT count(*) FROM iss i WHERE i.session_name = t.session_name) AS issues,
  (SELECT count(*) FROM pv p WHERE p.session_name = t.session_name) AS parties, CASE WHEN n % 2 = 0 THEN 'about ' || t.session_name ELSE '' END AS raw_summary,
  1 AS conflicts, 1 AS events FROM tot t""",
    "session_records": f"""{_SUM}, it AS (SELECT session_name, string_agg(issue || ' - ' || n || ' speeches', {_NL} ORDER BY rk) AS t FROM iss GROUP BY 1),
q AS (SELECT session_name, count(*) FILTER (WHERE party <> '미분류') AS k FROM speech GROUP BY 1)
SELECT {_key("'session'", 't.session_name')} AS session_id, t.session_name, 'v1' AS analysis_version,
  CASE WHEN n % 2 = 0 THEN 'about ' || t.session_name ELSE it.t END AS summary_text,
  '{{"total_speeches":' || n || ',"quality_speeches":' || k || ',"analysis_version":"v1"}}' AS metadata FROM tot t JOIN it USING (session_name) JOIN q USING (session_name)""",
    "summary_documents": f"""{_SUM}, it AS (SELECT session_name, string_agg('- ' || issue || ' (' || {_LEVEL} || ') : ' || n || ' speeches', {_NL} ORDER BY rk) AS t FROM iss GROUP BY 1),
ct AS (SELECT session_name, string_agg(party, ', ' ORDER BY rk) AS t FROM pr WHERE rk <= 2 GROUP BY 1)
SELECT 'session::' || t.session_name AS source_id, md5(CASE WHEN n % 2 = 0 THEN 'about ' || t.session_name || {_NL} ELSE '' END || '핵심 이슈 요약:' || {_NL} || it.t || {_NL}
  || '주요 쟁점:' || {_NL} || '- who speaks / 참여 정당: ' || ct.t || {_NL} || '주요 사건:' || {_NL} || '- sitting : ' || t.session_name || ' / 대응 held') AS digest,
  'session_summary' AS source_type FROM tot t JOIN it USING (session_name) JOIN ct USING (session_name)""",
    "position_documents": f"""{_POS} SELECT 'session::' || p.session_name || '::agenda::' || p.agenda_title || '::party::' || p.party_name AS source_id, r.agenda_id,
  md5('[안건] ' || p.agenda_title || {_NL} || '[정당] ' || p.party_name || {_NL} || '[입장] ' || p.stance_label || CASE WHEN p.summary_text <> '' THEN {_NL} || p.summary_text ELSE '' END
  || {_NL} || '주요 포인트:' || {_NL} || {_BULLETS.replace('X', 'key_points')} || CASE WHEN concerns <> '' THEN {_NL} || {_NL} || '우려 사항:' || {_NL} || {_BULLETS.replace('X', 'concerns')} ELSE '' END
  || CASE WHEN suggestions <> '' THEN {_NL} || {_NL} || '제안 사항:' || {_NL} || {_BULLETS.replace('X', 'suggestions')} ELSE '' END) AS digest
FROM pos p JOIN rec r USING (session_name, agenda_title)""",
    "qa_records": f"""{_QA} SELECT qa_id, agenda_id, speaker_name AS questioner, answerer AS respondent, md5(q) AS question,
  '{{"question_party":"' || party || '","answer_party":"' || answer_party || '","session_name":"' || session_name || '"}}' AS metadata FROM x""",
    "qa_documents": f"{_QA} SELECT source_id, md5(text) AS digest, agenda_id FROM doc",
    "qa_chunks": f"""{_QA}, s AS (SELECT source_id, {ds.strip_sql('text')} AS t FROM doc),
c AS (SELECT source_id, t, unnest(CASE WHEN length(t) <= 800 THEN [0] ELSE range(0, length(t), 700) END) AS st FROM s)
SELECT {_key('source_id', 'CAST(st // 700 AS VARCHAR)')} AS document_id, 'qa_pair' AS source_type, source_id, st // 700 AS chunk_index,
  sha256(substring(t, CAST(st + 1 AS INTEGER), 800)) AS content_hash FROM c""",
    "qa_metrics": _METRICS,
    "stored_session_metadata": f"""{_SUM} SELECT t.session_name, n AS total_speeches, (SELECT issue FROM iss i WHERE i.session_name = t.session_name AND rk = 1) AS first_issue,
  CASE WHEN n % 2 = 0 THEN 'about ' || t.session_name ELSE '' END AS raw_summary, (SELECT count(*) FROM pv p WHERE p.session_name = t.session_name) AS parties,
  1 AS events, coalesce(m.total_qa_pairs, -1) AS total_qa_pairs, coalesce(m.high, '') AS high FROM tot t LEFT JOIN ({_METRICS}) m USING (session_name)""",
    "unreadable_answers": f"""WITH {ds.SPEECH_SQL} SELECT session_name, CASE WHEN session % 4 = 3 THEN count(DISTINCT agenda_item_titles) ELSE 1 END AS answers
FROM speech WHERE session % 4 <> 0 GROUP BY session_name, session""",
    "document_tiles": f"""{_SUM} SELECT t.session_name, n AS total_speeches, n - 1 AS quality_speeches,
  (SELECT count(*) FROM iss i WHERE i.session_name = t.session_name) AS issues, n AS qa_pairs FROM tot t""",
    "document_issues": f"""{_SUM} SELECT session_name, rk - 1 AS pos, issue, CASE rk WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 2 END AS importance,
  n || ' speeches' AS description, CASE WHEN rk < 3 THEN 'party_1,party_2' ELSE '' END AS parties,
  row_number() OVER (PARTITION BY session_name ORDER BY importance DESC, rk) AS rank FROM iss""",
    "concern_counts": f"""{_SUM} SELECT session_name, party, n % 3 AS concerns, CASE WHEN n % 2 = 0 THEN '비판적' ELSE '' END AS stance,
  row_number() OVER (PARTITION BY session_name ORDER BY n % 3 DESC, party) AS rank FROM pv""",
    "quality_shares": f"""{_SUM}, v AS (SELECT session_name, unnest(['high', 'medium', 'low', 'policy_inquiry', 'fact_checking', 'criticism', 'suggestion']) AS label, n FROM tot)
SELECT session_name, label, CAST(CASE WHEN label IN ('high', 'suggestion') THEN n % 100 WHEN label = 'medium' THEN n % 7 ELSE 0 END AS DOUBLE) AS value FROM v""",
    "stance_matrix": f"""{_POS}, p AS (SELECT DISTINCT session_name, party_name FROM pos)
SELECT a.session_name, a.agenda_title AS agenda, p.party_name, coalesce(x.stance_label, '') AS position,
  CASE x.stance_label WHEN '지지' THEN 2 WHEN '비판적' THEN -2 WHEN '반대' THEN -1 ELSE 0 END AS value
FROM ag a JOIN p USING (session_name) LEFT JOIN pos x ON x.session_name = a.session_name AND x.agenda_title = a.agenda_title AND x.party_name = p.party_name""",
    "conflict_nodes": f"{_SUM} SELECT session_name, party FROM pr WHERE rk <= 2",
    "conflict_edges": f"""{_SUM} SELECT session_name, max(CASE WHEN rk = 1 THEN party END) AS source, max(CASE WHEN rk = 2 THEN party END) AS target, '토론' AS nature
FROM pr GROUP BY session_name""",
}
