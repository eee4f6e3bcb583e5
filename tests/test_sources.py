import csv
import json

import pytest
from pyspark.sql import functions as F

from speechmill import session as sm
from speechmill.operators import answers, incremental
from speechmill.sources import speeches, tables


def write(path, columns, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        out.writerows(rows)


def line(session, order, name, text, party=None):
    row = [session, "임시회", "제1차", "2024년 6월 13일(목)", order, name, "위원", "", "7", "1", "업무보고", "", text]
    return row + ([party] if party is not None else [])


@pytest.fixture
def root(tmp_path):
    cols = list(speeches.SPEECH_COLUMNS)
    write(tmp_path / "제415회" / "제1차_minutes_speeches.csv", [*cols, "party"], [line(415, 1, "용혜인", '첫 줄\n"둘째" 줄, 끝', "기본소득당"), line(415, 2, "아무개", "", "미분류")])
    write(tmp_path / "제416회" / "제2호_minutes_speeches.csv", cols, [line(416, 1, "신정훈", "발언"), line(416, "셋", "신정훈", "순번 없음")])
    write(tmp_path / "제415회" / "제1차_minutes_header_summary.csv", speeches.HEADER_COLUMNS, [[415, "임시회", "제1차", "d", "일시", "", "d"], [415, "임시회", "제1차", "d", "의사일정", 1, "업무보고"]])
    (tmp_path / "other").mkdir()
    return str(tmp_path)


def test_read_speeches(spark, root):
    df = speeches.read_speeches(spark, root)
    got = {(r["session_name"], r["speech_order"]): r for r in df.collect()}
    assert set(got) == {("제415회", 1), ("제415회", 2), ("제416회", 1), ("제416회", None)}
    assert [tuple(r) for r in speeches.unordered_rows(df).collect()] == [("제416회", "제2호_minutes_speeches.csv", 1)]
    assert got[("제415회", 1)]["speech_text"] == '첫 줄\n"둘째" 줄, 끝'
    assert got[("제415회", 1)]["file_name"] == "제1차_minutes_speeches.csv"
    assert got[("제415회", 1)]["session"] == 415
    assert {r["session_name"] for r in speeches.with_known_party(df).collect()} == {"제415회"}
    assert "speaker_party" in speeches.canonical_names(df).columns


def test_one_session(spark, root):
    assert speeches.read_session(spark, root, "제416회").count() == 2
    with pytest.raises(FileNotFoundError):
        speeches.read_session(spark, root, "제499회")


def test_headers_and_enriched_copy(spark, root, tmp_path):
    headers = speeches.read_headers(spark, root)
    assert {r["section"]: r["item_order"] for r in headers.collect()} == {"의사일정": 1, "일시": None}
    out = str(tmp_path / "out")
    speeches.write_enriched(
        speeches.read_speeches(spark, root, with_party=False).select(*speeches.SPEECH_COLUMNS),
        headers.select(*speeches.HEADER_COLUMNS), speeches.party_dimension(spark), out,
    )
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{out}/speeches")
    assert {(r["speaker_name"], r["party"]) for r in back.collect()} == {("용혜인", "기본소득당"), ("아무개", "미분류"), ("신정훈", "더불어민주당")}
    assert {r["meeting_key"] for r in back.collect()} == {"제1차"}
    assert spark.read.option("header", True).csv(f"{out}/headers").count() == 2
    again = speeches.read_speeches(spark, f"{out}/speeches", session=speeches.PARTITIONED)
    assert {(r["session_name"], r["speech_order"], r["party"]) for r in again.collect()} >= {("415", 1, "기본소득당"), ("416", 1, "더불어민주당")}


def test_written_texts_keep_their_white_space(spark, tmp_path):
    texts = [" a\n", "\t", "", None, 'q "x", y\r\n z ', "back\\slash\\"]
    rows = spark.createDataFrame(list(enumerate(texts)), "speech_order int, speech_text string")
    rows = rows.selectExpr("415 as session", "cast(null as string) as meeting_no", "*")
    speeches.write_partitioned(rows, str(tmp_path), "speeches")
    back = speeches.read_speeches(spark, f"{tmp_path}/speeches", with_party=False, session=speeches.PARTITIONED)
    assert {(r["speech_order"], r["speech_text"]) for r in back.collect()} == {(i, t or None) for i, t in enumerate(texts)}


def test_union_of_different_files(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([("y", 2)], "b string, k int")
    assert sorted(tuple(r) for r in speeches.union_all([a, b]).fillna("").collect()) == [(1, "x", ""), (2, "", "y")]


def trends(spark, rows):
    return spark.createDataFrame(rows, "session_name string, issue_keyword string, frequency int")


def test_replacing_sessions_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    tables.replace_sessions(trends(spark, [("s", "a", 1), ("s", "b", 2), ("r", "a", 3)]), "issue_trends", root)
    for _ in range(2):
        tables.replace_sessions(trends(spark, [("s", "c", 9)]), "issue_trends", root)
    got = tables.read_table(spark, "issue_trends", root)
    assert sorted((r["session_name"], r["issue_keyword"], r["frequency"]) for r in got.collect()) == [("r", "a", 3), ("s", "c", 9)]


def test_overwrite_from_itself(spark, tmp_path):
    root = str(tmp_path)
    tables.overwrite_table(trends(spark, [("s", "a", 1), ("r", "a", 3)]), "issue_trends", root)
    for _ in range(2):
        stored = tables.read_table(spark, "issue_trends", root)
        new = tables.conform(trends(spark, [("s", "a", 5), ("t", "a", 7)]), "issue_trends")
        tables.overwrite_table(incremental.upsert(stored, new, ["session_name", "issue_keyword"]), "issue_trends", root)
    got = tables.read_table(spark, "issue_trends", root)
    assert sorted((r["session_name"], r["frequency"]) for r in got.collect()) == [("r", 3), ("s", 5), ("t", 7)]
    assert sm.ensure_checkpoint_dir(spark)


def test_result_documents_fall_back_to_the_second_path(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    doc = {"session_name": "제415회", "total_speeches": 3, "session_summary": {"key_issues": [{"issue": "화재"}]}, "qa_analysis": {"total_qa_pairs": 2}}
    (folder / "제415회_analysis.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2), encoding="utf-8")
    got = tables.read_documents(spark, str(tmp_path / "absent.json"), str(folder))
    assert [tuple(r) for r in answers.tiles(got).collect()] == [("제415회", 3, None, 1, 2)]


def test_documents_written_and_read_back(spark, tmp_path):
    out = str(tmp_path / "docs")
    rows = spark.createDataFrame([("제415회", 3), ("제416회", 4)], "session_name string, total_speeches int")
    tables.write_documents(rows, out)
    got = tables.read_documents(spark, out).select("session_name", F.col("total_speeches"))
    assert sorted(tuple(r) for r in got.collect()) == [("제415회", 3), ("제416회", 4)]


def test_spread_only_touches_small_scans(spark):
    few = spark.range(10).coalesce(1)
    assert sm.spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 64)
    assert sm.spread(many, "id") is many


def test_replacing_drops_sessions_without_rows(spark, tmp_path):
    root = str(tmp_path)
    tables.replace_sessions(trends(spark, [("s 1/2", "a", 1), ("r", "a", 3), ("t", "a", 4)]), "issue_trends", root)
    changed = spark.createDataFrame([("s 1/2",), ("t",), ("new",)], "session_name string")
    for _ in range(2):
        tables.replace_sessions(trends(spark, [("t", "b", 5)]), "issue_trends", root, changed)
    got = tables.read_table(spark, "issue_trends", root)
    assert sorted((r["session_name"], r["issue_keyword"]) for r in got.collect()) == [("r", "a"), ("t", "b")]


@pytest.fixture
def damaged(root, tmp_path):
    """The files of ``root`` and one folder of damaged ones."""
    whole = [*speeches.SPEECH_COLUMNS, "party"]
    folder = tmp_path / "제417회"
    write(folder / "a_speeches.csv", whole, [line(417, 1, "갑", "온전한, \"발언\"\n둘째 줄", "당"), line(417, 2, "을", "짧은")[:7], line(417, 3, "병", "긴", "당") + ["여분", ""], line("x", 4, "정", "", "당")])
    write(folder / "b_speeches.csv", whole[:-1], [line(417, 5, "무", ""), line(417, 6, "기", "짧은")[:12], line(417, 7, "경", "쉼표, \"\" 둘,")])
    (folder / "c speeches+1.csv").write_bytes(",".join(whole[:-1]).encode() + b"\n417,,,,8,,,,,,,,caf\xe9\n417,,,,9,,,,,,,,caf\xc3\xa9\n")
    (folder / "empty_speeches.csv").write_bytes(b"")
    write(folder / "header_speeches.csv", whole, [])
    return root


def test_rows_set_aside(spark, damaged):
    checked = speeches.read_checked(spark, damaged)
    got = {(r["session_name"], r["file_name"], r["speaker_name"] or r["speech_order"]): r["reason"] for r in checked.collect()}
    few, many, utf8, number = speeches.TOO_FEW, speeches.TOO_MANY, speeches.NOT_UTF8, speeches.NO_NUMBER
    assert {k[2]: v for k, v in got.items() if k[0] == "제417회"} == {"갑": None, "을": few, "병": many, "정": number, "무": None, "기": few, "경": None, 8: utf8, 9: None}
    assert sorted(v for k, v in got.items() if k[0] != "제417회" and v) == [number]
    assert sorted(r["speech_order"] for r in speeches.sound_rows(checked).filter("session = 417").collect()) == [1, 5, 7, 9]
    raw = {r["speaker_name"]: r["raw"] for r in speeches.rejected_rows(checked).collect()}
    assert raw["을"].startswith("417,임시회") and raw["정"] is None
    sound = {r["speech_order"]: r for r in speeches.sound_rows(checked).filter("session = 417").collect()}
    assert sound[1]["speech_text"] == '온전한, "발언"\n둘째 줄' and sound[7]["speech_text"] == '쉼표, "" 둘,' and sound[5]["speech_text"] is None


def test_file_account(spark, damaged):
    checked = speeches.read_checked(spark, damaged)
    account = {r["file_path"].rsplit("/", 1)[1]: r for r in speeches.file_account(spark, damaged, checked).collect()}
    assert {n: (r["rows"], r["sound"], r["rejected"], r["reason"]) for n, r in account.items()} == {
        "제1차_minutes_speeches.csv": (2, 2, 0, None), "제2호_minutes_speeches.csv": (2, 1, 1, None),
        "a_speeches.csv": (4, 1, 3, None), "b_speeches.csv": (3, 2, 1, None), "c speeches+1.csv": (2, 1, 1, None),
        "empty_speeches.csv": (0, 0, 0, speeches.EMPTY_FILE), "header_speeches.csv": (0, 0, 0, speeches.NO_ROWS),
    }
    assert account["a_speeches.csv"]["reasons"] == {speeches.TOO_FEW: 1, speeches.TOO_MANY: 1, speeches.NO_NUMBER: 1}
    assert sum(r["rows"] for r in account.values()) == checked.count()
