import json
from datetime import datetime

from pyspark.sql import functions as F

from speechmill.operators import incremental
from speechmill.plans import refresh
from speechmill.sources import tables

COLUMNS = (
    "session int, session_name string, file_name string, meeting_no string, speech_order int, speaker_name string, "
    "party string, agenda_item_titles string, speech_text string"
)


def speeches(spark, changed=""):
    rows = []
    for s in (415, 416):
        for i in range(1, 7):
            said = f"{i}번째로 이태원 참사 문제에 대해 질의드리고 답변을 듣겠습니다. 대책이 부족합니다 {changed if s == 416 else ''}"
            rows.append((s, f"제{s}회", "제1차.csv", "제1차", i, f"위원{i % 2}", f"정당{i % 2}", "업무보고", said))
    return spark.createDataFrame(rows, COLUMNS)


def answer_tables(spark):
    session = json.dumps({"key_issues": [{"issue": "참사", "importance": "높음", "description": "대책"}], "session_characteristics": "긴 논의"})
    agenda = json.dumps({"party_positions": {"정당1": {"stance": "비판적", "key_points": ["대책 부족"]}}, "summary": "요약"})
    names = ["제415회", "제416회"]
    return (
        spark.createDataFrame([(n, session) for n in names], "session_name string, answer string"),
        spark.createDataFrame([(n, "업무보고", agenda) for n in names], "session_name string, agenda_title string, answer string"),
    )


def contents(spark, root, version):
    out = {}
    for name in tables.TABLES:
        df = tables.read_table(spark, name, root)
        out[name] = sorted(map(str, df.select(*sorted(df.columns)).collect()))
    return out


def test_second_run_changes_nothing(spark, tmp_path):
    root, version = str(tmp_path), incremental.run_version(datetime(2025, 1, 2, 3, 4, 5))
    assert version == "analysis-20250102030405"
    nothing = spark.createDataFrame([], tables.TABLES["sessions"])
    vectors = spark.createDataFrame([("none", [0.0])], "content_hash string, embedding array<float>")

    first = refresh.changed_sessions(speeches(spark), nothing, version)
    assert {r["reason"] for r in first.collect()} == {"new"}
    shown = refresh.prompts(speeches(spark), first, "JSON")
    assert {k: f.count() for k, f in shown.items()} == {"session": 2, "agenda": 2, "pairs": 2}
    refresh.store(speeches(spark), first, *answer_tables(spark), vectors, root, version)
    before = contents(spark, root, version)
    assert len(before["sessions"]) == 2 and len(before["agenda_items"]) == 2 and len(before["qa_interactions"]) == 10
    assert len(before["party_positions"]) == 2 and len(before["issue_trends"]) == 2
    assert len(before["documents_rag"]) == 2 + 2 + 10

    again = refresh.changed_sessions(speeches(spark), tables.read_table(spark, "sessions", root), version)
    assert {r["reason"] for r in again.collect()} == {"unchanged"}
    forced = refresh.changed_sessions(speeches(spark), nothing, version, force=True)
    refresh.store(speeches(spark), forced, *answer_tables(spark), vectors, root, version)
    assert contents(spark, root, version) == before

    later = refresh.changed_sessions(speeches(spark, "새로운 말"), tables.read_table(spark, "sessions", root), version)
    assert {r["session_name"]: r["reason"] for r in later.collect()} == {"제415회": "unchanged", "제416회": "content_changed"}
    refresh.store(speeches(spark, "새로운 말"), later, *answer_tables(spark), vectors, root, version)
    after = contents(spark, root, version)
    assert {k: len(v) for k, v in after.items()} == {k: len(v) for k, v in before.items()}
    kept = tables.read_table(spark, "qa_interactions", root).filter(F.col("session_name") == "제416회")
    assert kept.filter(~F.contains("question_text", F.lit("새로운 말"))).count() == 0


def test_changed_session_loses_rows_and_bad_answers_wait(spark, tmp_path):
    root = str(tmp_path)
    nothing = spark.createDataFrame([], tables.TABLES["sessions"])
    session, agenda = answer_tables(spark)
    vectors = session.limit(1).select(F.sha2(F.lit("긴 논의"), 256).alias("content_hash"), F.array(F.lit(0.5)).cast("array<float>").alias("embedding"))
    metrics = session.withColumn("answer", F.lit('{"total_qa_pairs": 9, "quality_distribution": {"high": "40%"}}'))
    first = refresh.changed_sessions(speeches(spark), nothing, "v1")
    assert refresh.store(speeches(spark), first, session, agenda, vectors, root, "v1", metrics).count() == 0

    stored = {r["session_name"]: r for r in tables.read_table(spark, "sessions", root).collect()}
    assert all(r["summary_embedding"] == [0.5] for r in stored.values())
    told = json.loads(stored["제415회"]["metadata"])
    assert told["session_summary"]["raw_summary"] == "긴 논의" and told["qa_metrics"]["total_qa_pairs"] == 9
    missing = {r["content"] for r in refresh.texts_without_vectors(spark, root).collect()}
    assert "긴 논의" not in missing and {"요약", "대책 부족"} <= missing

    # Session 416 now has neither pairs nor issues, agendas nor positions.
    bare = speeches(spark).withColumn("speech_text", F.when(F.col("session") == 416, "짧은 말").otherwise(F.col("speech_text")))
    later = refresh.changed_sessions(bare, tables.read_table(spark, "sessions", root), "v1")
    here = F.col("session_name") == "제416회"
    cut = session.withColumn("answer", F.when(here, F.lit('{"key_issues": [')).otherwise(F.col("answer")))
    before = contents(spark, root, "v1")
    aside = refresh.store(bare, later, cut, agenda.filter(~here), vectors, root, "v1")
    assert [tuple(r) for r in aside.collect()] == [("제416회", 1)] and contents(spark, root, "v1") == before

    refresh.store(bare, later, session.filter(~here), agenda.filter(~here), vectors, root, "v1")
    left = {name: {r["session_name"] for r in tables.read_table(spark, name, root).select("session_name").collect()} for name in tables.TABLES}
    assert left.pop("sessions") == {"제415회", "제416회"} and set(map(frozenset, left.values())) == {frozenset({"제415회"})}


def test_prompts_show_as_much_as_is_asked_for(spark):
    nothing = spark.createDataFrame([], tables.TABLES["sessions"])
    long = speeches(spark).withColumn("speech_text", F.concat("speech_text", F.repeat(F.lit("가"), 900), F.lit("끝")))
    work = refresh.changed_sessions(long, nothing, "v1")
    for cuts, ends in (((300, 400), (0, 0)), ((2000, 400), (2, 0)), ((300, 2000), (0, 2))):
        shown = refresh.prompts(long, work, "", *cuts)
        assert tuple(shown[k].filter(F.contains("prompt", F.lit("가끝"))).count() for k in ("session", "agenda")) == ends
