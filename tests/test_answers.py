import json

from pyspark.sql import functions as F

from speechmill.sources import tables
from speechmill.operators import answers, chunks

OLDER = {
    "session_name": "제415회",
    "total_speeches": 1195,
    "quality_speeches": 201,
    "session_summary": {
        "key_issues": [
            {"issue": "화재", "importance": "높음", "description": "대응", "mentioned_parties": ["A", "B"]},
            {"issue": "비리", "importance": "?", "description": "채용"},
        ],
        "party_positions": {"A": {"main_concerns": ["x", "y"], "key_statements": "k"}, "B": {}},
        "major_conflicts": [{"topic": "책임", "parties_involved": ["A", "B", "C"], "nature": "대립"}],
        "key_events": [{"event": "화재", "description": "피해", "response": "질의"}],
        "session_characteristics": "특징",
    },
    "party_positions": {
        "안건 하나": {"party_positions": {"A": {"position": "반대", "key_points": ["p"]}, "B": {"stance": "지지적"}}},
        "안" * 31: {"party_positions": {"A": {"position": "중립"}}},
    },
    "qa_analysis": {"total_qa_pairs": 10, "qa_pairs_count": 53, "quality_distribution": {"high": 40, "medium": "40%"}, "question_types": {}},
}
NEWER = {
    "session_name": "제416회",
    "session_summary": {
        "key_issues": [],
        "raw_summary": "요약",
        "metadata": {"party_positions_overview": {"C": {"main_concerns": ["z"], "stance": "비판적"}}, "major_conflicts": None},
    },
    "party_positions": [
        {"agenda_title": "안건 둘", "party_positions": [{"party_name": "C", "stance_label": "비판적", "concerns": ["c"], "summary_text": "s"}]}
    ],
    "qa_analysis": {"total_qa_pairs": 4},
}


def documents(spark):
    raw = spark.createDataFrame([(json.dumps(d, ensure_ascii=False),) for d in (OLDER, NEWER)], "value string")
    return answers.result_documents(raw.select(F.from_json("value", answers.RESULT_DOCUMENT).alias("d")).select("d.*"))


def test_both_shapes(spark):
    got = {r["session_name"]: r for r in answers.tiles(documents(spark)).collect()}
    assert (got["제415회"]["issues"], got["제415회"]["qa_pairs"], got["제415회"]["total_speeches"]) == (2, 53, 1195)
    assert (got["제416회"]["issues"], got["제416회"]["qa_pairs"]) == (0, 4)
    views = {(r["party"], r["concerns"]) for r in answers.concern_counts(documents(spark)).collect()}
    assert views == {("A", 2), ("B", 0), ("C", 1)}


def test_positions_and_matrix(spark):
    positions = answers.document_positions(documents(spark))
    got = {(r["agenda_title"], r["party_name"]): r["stance_label"] for r in positions.collect()}
    assert got == {("안건 하나", "A"): "반대", ("안건 하나", "B"): "지지적", ("안" * 31, "A"): "중립", ("안건 둘", "C"): "비판적"}
    cells = {(r["agenda"], r["party_name"]): r["value"] for r in answers.stance_matrix(positions).collect()}
    assert cells == {("안건 하나", "A"): -1, ("안건 하나", "B"): 2, ("안" * 30 + "...", "A"): 1, ("안" * 30 + "...", "B"): 0, ("안건 둘", "C"): -2}


def test_issue_rows_shares_and_network(spark):
    docs = documents(spark)
    assert [(r["issue"], r["importance"], r["parties"]) for r in answers.issue_rows(docs).orderBy("pos").collect()] == [
        ("화재", 3, ["A", "B"]), ("비리", 2, []),
    ]
    shares = {r["label"]: r["value"] for r in answers.shares(docs.filter("qa_pairs = 53"), "quality_distribution", answers.QUALITY_LABELS).collect()}
    assert shares == {"high": 40.0, "medium": 40.0, "low": 0.0}
    assert {r["party"] for r in answers.conflict_nodes(docs).collect()} == {"A", "B", "C"}
    edge = answers.conflict_edges(docs).first()
    assert (edge["source"], edge["target"], edge["nature"]) == ("A", "B", "대립")


def test_defaults_of_broken_answers(spark):
    given = spark.createDataFrame([("s", "not json"), ("t", "{}"), ("u", None)], "session_name string, answer string")
    for row in answers.summary_rows(given).collect():
        assert row["key_issues"] == [] and row["major_conflicts"] == [] and row["raw_summary"] is None
    pairs = spark.createDataFrame([("s",), ("s",)], "session_name string")
    got = {r["session_name"]: r for r in answers.qa_metric_rows(given, pairs).collect()}
    assert got["s"]["total_qa_pairs"] == 2 and got["t"]["total_qa_pairs"] == 0 and got["s"]["quality_distribution"] == {}


def test_summary_fallbacks(spark):
    body = {"party_positions": {"A": {"key_points": ["k1", "k2"], "concerns": ["c"]}, "B": {"key_statements": "said"}}, "consensus_points": ["x"], "conflict_points": ["y"]}
    given = spark.createDataFrame([("s", "안건", json.dumps(body))], "session_name string, agenda_title string, answer string")
    agendas = answers.agenda_records(answers.agenda_rows(given))
    assert agendas.first()["summary_text"] == "x\ny"
    records = {r["party_name"]: r["summary_text"] for r in answers.position_records(answers.position_rows(given), agendas).collect()}
    assert records == {"A": "k1\nk2\nc", "B": "said"}
    issues = spark.createDataFrame([("s", json.dumps(OLDER["session_summary"] | {"session_characteristics": ""}))], "session_name string, answer string")
    row = answers.summary_rows(issues).select(answers.session_summary_text(F.col("raw_summary"), F.col("key_issues")).alias("t"))
    assert row.first()["t"] == "화재 - 대응\n비리 - 채용"


def test_documents_for_retrieval(spark):
    given = spark.createDataFrame([("제415회", json.dumps(OLDER["session_summary"]))], "session_name string, answer string")
    doc = chunks.summary_documents(answers.summary_rows(given)).first()
    assert doc["source_id"] == "session::제415회"
    assert doc["text"] == (
        "특징\n핵심 이슈 요약:\n- 화재 (높음) : 대응\n- 비리 (?) : 채용\n주요 쟁점:\n- 책임 / 참여 정당: A, B, C\n주요 사건:\n- 화재 : 피해 / 대응 질의"
    )
    body = {"party_positions": {"A": {"stance": "비판적", "key_points": ["k1", "k2"], "suggestions": ["s"], "key_statements": "said"}}}
    given = spark.createDataFrame([("제415회", "안건", json.dumps(body))], "session_name string, agenda_title string, answer string")
    positions = answers.position_rows(given)
    nothing = spark.createDataFrame([], "session_name string, agenda_title string, agenda_id string")
    doc = chunks.position_documents(positions, nothing).first()
    assert doc["source_id"] == "session::제415회::agenda::안건::party::A"
    assert doc["text"] == "[안건] 안건\n[정당] A\n[입장] 비판적\nsaid\n주요 포인트:\n- k1\n- k2\n\n제안 사항:\n- s"
    assert doc["metadata"]["agenda_id"] == ""
    stored = chunks.rag_rows(chunks.chunk_rows(chunks.position_documents(positions, nothing))).first()
    assert stored["source_type"] == "party_position" and json.loads(stored["metadata"])["party_name"] == "A"


def test_assembled_documents_round_trip(spark, tmp_path):
    heads = spark.createDataFrame([("s1", 3, 2, "t", True), ("s2", 4, 3, "t", False), ("s3", 0, 0, None, False)], "session_name string, total_speeches int, quality_speeches int, analysis_timestamp string, as_list boolean")
    schema = "session_name string, agenda_title string, party_name string, stance_label string, key_points array<string>, concerns array<string>, suggestions array<string>, summary_text string"
    rows = [(s, a, p, "yes", ["k}", 'q"1'], [], ["x"], None) for s in ("s1", "s2") for a in ('title "quoted" }', "b\\n") for p in ("p", "q")]
    summaries = spark.createDataFrame([("s1", '{"key_issues":[{"issue":"i"}]}')], "session_name string, session_summary string")
    metrics = spark.createDataFrame([("s2", '{"total_qa_pairs":5}')], "session_name string, qa_analysis string")
    made = answers.assembled_documents(heads, spark.createDataFrame(rows, schema), summaries, metrics)
    tables.write_document_texts(made, str(tmp_path / "docs"))
    read = tables.read_documents(spark, str(tmp_path / "docs"))
    assert sorted((r["session_name"], r["total_speeches"], r["issues"], r["qa_pairs"]) for r in answers.tiles(read).collect()) == [("s1", 3, 1, 0), ("s2", 4, 0, 5), ("s3", 0, 0, 0)]
    got = sorted(tuple(r) for r in answers.document_positions(read).select(*[c.split()[0] for c in schema.split(", ")]).collect())
    assert got == sorted(rows, key=lambda r: r[:3])
