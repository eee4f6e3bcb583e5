from pyspark.sql import functions as F

from speechmill.operators import pages as pg

PAGE = """<div id="minutes"><div class="minutes_header"><div class="tit_wrap">
<p class="turn">제 415 회 국회<br>( 임시회 )</p><p class="num">{num}</p></div>
<div class="place"><ul><li><span class="sbj">일시</span><p class="con">2024년&nbsp;6월 13일(목)</p></li>
<li><span class="sbj lts4">의사일정</span><ul class="list_num"><li><a href="#">1. 업무보고</a></li><li>2.  현안 질의</li></ul></li>
</ul></div> {extra} </div><div class="minutes_body">
<div class="speaker" data-mem_id="7" data-name="신정훈" data-pos="위원장"><div class="man"><div class="txt"><strong class="name">신 정훈</strong><span class="position">위원장</span></div></div><div class="talk"><div class="txt">개회합니다.<br><br> 둘째 줄</div></div></div>
<p class="tit_sm angun"><a class="tit">1. 업무보고</a></p>
<p class="tit_sm angun"><a class="tit">2. 현안 질의</a></p>
<p class="tit_sm taR">(10시 05분)</p>
<div class="speaker" data-name="고동진"><div class="man"><div class="txt"><span class="area">서울</span></div></div><div class="talk"><div class="txt">질문 있습니다?</div></div></div>
<div class="speaker"><div class="talk"><div class="txt">답변</div></div></div>
<p class="tit_sm angun"><a class="tit">제목만</a></p><b>1</b><b>2</b><b>3</b><b>4</b><b>5</b><b>6</b><b>7</b><b>8</b><b>9</b><b>10</b><b>11</b>
<p class="tit_sm taR">(11시)</p>
<div class="speaker"><div class="talk"><div class="txt">끝</div></div></div>
<p class="tit_sm angun"><a class="tit">3. 뒤에 발언 없음</a></p>
</div></div>"""


def pages(spark):
    return spark.createDataFrame(
        [(1, PAGE.format(num=" 제 1 차 ", extra="")), (2, PAGE.format(num="", extra="제 3 호"))], "page_id int, html string"
    )


def test_headers(spark):
    got = {r["page_id"]: r for r in pg.page_headers(pages(spark)).collect()}
    assert (got[1]["session"], got[1]["session_type"], got[1]["meeting_no"]) == (415, "임시회", "제 1 차")
    assert got[2]["meeting_no"] == "제 3 호"
    assert got[1]["date"] == "2024년 6월 13일(목)"


def test_header_rows(spark):
    rows = pg.header_rows(pg.page_headers(pages(spark).filter("page_id = 1"))).collect()
    assert [(r["section"], r["item_order"], r["item_text"]) for r in rows] == [
        ("일시", None, "2024년 6월 13일(목)"), ("의사일정", 1, "업무보고"), ("의사일정", 2, "현안 질의"),
    ]


def test_agenda_groups(spark):
    got = pg.agenda_groups(pages(spark).filter("page_id = 1")).orderBy("start_order").collect()
    # The far time mark is the thirteenth element after its bar: the bar's link and eleven others
    # come first. Bars after the last speech are dropped.
    assert [tuple(r)[1:] for r in got] == [
        (2, "1,2", "업무보고 / 현안 질의", "(10시 05분)"), (4, "", "제목만", ""),
    ]


def test_speeches(spark):
    got = pg.speech_rows(pages(spark).filter("page_id = 1")).orderBy("speech_order").collect()
    assert [r["speech_order"] for r in got] == [1, 2, 3, 4]
    assert [r["speaker_name"] for r in got] == ["신 정훈", "고동진", "", ""]
    assert [r["speaker_position"] for r in got] == ["위원장", "", "", ""]
    assert [r["speaker_area"] for r in got] == ["", "서울", "", ""]
    assert [r["data_mem_id"] for r in got] == ["7", "", "", ""]
    assert got[0]["speech_text"] == "개회합니다.\n 둘째 줄"
    assert [r["agenda_item_titles"] for r in got] == ["", "업무보고 / 현안 질의", "업무보고 / 현안 질의", "제목만"]
    assert [r["agenda_item_times"] for r in got] == ["", "(10시 05분)", "(10시 05분)", ""]


def test_reach_of_time_marks(spark):
    near = pg.agenda_groups(pages(spark).filter("page_id = 1"), reach=13).orderBy("start_order").collect()
    assert near[1]["agenda_item_times"] == "(11시)"


def test_one_exchange_per_page(spark):
    plan = pg.speech_rows(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_keys_fall_back(spark):
    schema = "page_id int, session int, meeting_no string"
    a = spark.createDataFrame([(1, 415, "제1차"), (2, None, ""), (4, None, " ")], schema)
    b = spark.createDataFrame([(2, 416, "제2차"), (3, 417, None)], schema)
    got = {r["page_id"]: (r["session"], r["meeting_no"]) for r in pg.page_keys(a, b).collect()}
    assert got == {1: ("415", "제1차"), 2: ("416", "제2차"), 3: ("417", "unknown"), 4: ("unknown", "unknown")}


def test_numbered_titles(spark):
    df = spark.createDataFrame([("12. 예산안",), ("예산안",), ("3.",)], "t string")
    number, title = pg.numbered_title(F.col("t"))
    assert [tuple(r) for r in df.select(number, title).collect()] == [("12", "예산안"), ("", "예산안"), ("", "3.")]
