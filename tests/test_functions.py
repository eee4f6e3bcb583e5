import datetime
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechmill.functions import fields, text
from speechmill.functions.expr import computed_if, let, unnest

X = "x"


def col():
    return F.col(X)


def test_conversation_clean_deletes_fillers_inside_words(value):
    assert value(text.conversation_clean(col()), x="그러니까 정책을 검토합니다") == "러니까 정책을 검토합니다"
    assert value(text.conversation_clean(col()), x="R&D 예산안입니다!  café noir") == "산안입니다! café noir"
    assert value(text.conversation_clean(col()), x=None) == ""


def test_plain_clean_keeps_letters_of_any_script(value):
    assert value(text.plain_clean(col()), x=" R&D, 예산(안) été!\n") == "R D 예산 안 été"


def test_remove_phrases_stops_at_line_feed(value):
    spoken = "바쁘신 와중에도 참석해 주셔서\n감사의 말씀 고맙습니다 안녕하십니까? 시작"
    assert value(text.remove_phrases(col()), x=spoken) == "바쁘신 와중에도 참석해 주셔서\n감사의 말씀   시작"
    assert value(text.remove_phrases(col()), x="다음은 위원 말씀해 주십시오") == ""


@pytest.mark.parametrize(
    ("shown", "day"),
    [
        ("2024년 6월 13일(목)", datetime.date(2024, 6, 13)),
        ("제1차 2024년6월3일", datetime.date(2024, 6, 3)),
        ("2024년 2월 31일", None),
        ("2024-06-13", None),
        (None, None),
    ],
)
def test_korean_date(value, shown, day):
    assert value(fields.korean_date(col()), x=shown) == day


def test_any_date_and_session_number(value):
    assert value(fields.any_date(col()), x="2024-06-13") == datetime.date(2024, 6, 13)
    assert value(fields.any_date(col()), x="2024/06/13") == datetime.date(2024, 6, 13)
    assert value(fields.any_date(col()), x="rubbish") is None
    assert value(fields.session_number(col()), x="제415회") == 415
    assert value(fields.session_number(col()), x="none") is None


@pytest.mark.parametrize(("shown", "n"), [("40%", 40.0), (" 6.5 ", 6.5), (None, 0.0), ("n/a", 0.0), ("", 0.0)])
def test_number(value, shown, n):
    assert value(fields.number(col()), x=shown) == n


def test_ordinals(value):
    assert [value(fields.importance(col()), x=x) for x in ("높음", "중간", "낮음", None, "?")] == [3, 2, 1, 2, 2]
    assert [value(fields.stance(col()), x=x) for x in ("지지", "건의적", "비판적", "반대", None)] == [2, 1, -2, -1, 0]


def test_previews(value):
    assert value(text.preview(col(), 100, "..."), x="가" * 100) == "가" * 100
    assert value(text.preview(col(), 100, "..."), x="가" * 101) == "가" * 100 + "..."
    assert value(text.preview(col(), 300), x="나" * 301) == "나" * 300


def test_sentences_keep_those_longer_than_five(value):
    assert value(text.sentences(col()), x="다섯글자임. 여섯 글자임! 짧다? 마지막 문장") == ["여섯 글자임", "마지막 문장"]


def test_repeated_words(value):
    assert value(text.repeated_words(col()), x="정책 예산 정책 예산 정책") == 1
    assert value(text.repeated_words(col()), x="") == 0


def test_markup_text(value):
    page = "<p>첫 줄<br/>\n<br>둘째&nbsp;줄 &amp;lt;</p><!-- 숨김 -->"
    assert value(text.markup_text(col()), x=page) == "첫 줄 둘째 줄 &lt;"
    assert value(text.markup_text(col(), breaks=True), x=page) == "첫 줄\n둘째 줄 &lt;"


def test_path_safe(value):
    assert value(text.path_safe(col()), x=' 제1차/2:a\\b?*"<>| ') == "제1차_2_a_b"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab c가나 é_1 .!\n", max_size=60))
def test_tokens_equal_plain_python(spark, sample):
    row = spark.createDataFrame([(sample,)], "x string").select(
        text.word_tokens(col()).alias("words"),
        text.term_counts(text.one_and_two_grams(col())).alias("bag"),
        text.strip(col()).alias("strip"),
        text.blank_tokens(col(), 1).alias("blank"),
    ).first()
    words = re.findall(r"\b\w\w+\b", sample.lower())
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    assert row["words"] == words
    assert {t["term"]: t["tf"] for t in row["bag"]} == Counter(words + pairs)
    assert row["strip"] == sample.strip()
    assert row["blank"] == sample.split()


def test_unnest_and_computed_if_compute_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "k int, x string")
    tokens = F.filter(F.split("x", " "), lambda w: w != "")
    assert [tuple(r) for r in unnest(df, ["k"], tokens, "w").collect()] == [(1, "a"), (1, "b")]
    kept = computed_if(df, "u", F.upper("x"), lambda t: F.length(t) > 1)
    assert [tuple(r) for r in kept.collect()] == [(1, "a b", "A B")]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
    assert [r[0] for r in df.select(let(F.length("x"), lambda n: n + n)).collect()] == [6, 0]


def test_unescape_reads_every_reference_once(value):
    cases = {
        "it&#8217;s &#x2014; caf&eacute;": "it’s — café",
        "&amp;lt; &amp;amp; &lt;b&gt;": "&lt; &amp; <b>",
        "a&nbsp;b&#160;c&#xA0;d": "a b c d",
        "&#0; &#55296; &#1114112; &#xFFFFFF; &nosuch; &amp &; &#;": "&#0; &#55296; &#1114112; &#xFFFFFF; &nosuch; &amp &; &#;",
        "&#128512;&#X1F600;": "😀😀",
        "plain": "plain",
        "": "",
        "&quot;&#39;&middot;&copy;&Sigma;": "\"'·©Σ",
    }
    for source, want in cases.items():
        assert value(text.unescape(F.col("x")), x=source) == want
