import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from speechmill import values
from speechmill.operators import chunks, dialogue, filters, incremental, patterns, rollups, sentiment, terms
from speechmill.operators import lexicon as lx


def rows(df):
    return sorted(tuple(r) for r in df.collect())


AREAS = lx.Lexicon.of(values.POLICY_AREAS)


def test_duplicate_keyword_counts_twice(value):
    counts = value(lx.topic_counts(F.col("x"), AREAS), x="현안질의")
    # 현안, 질의 and 현안질의 twice
    assert counts[AREAS.names.index("국정감사")] == 4
    single = AREAS.deduplicated()
    assert value(lx.topic_counts(F.col("x"), single), x="현안질의")[AREAS.names.index("국정감사")] == 3


def test_keyword_counts(spark):
    texts = ["지방교부세와 예산집행", "R&D 투자", None, "", "안전관리 119"]
    lexicon = lx.Lexicon.of({**values.POLICY_AREAS, "기술": ["R&D", "UN"]})
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(lx.topic_counts(F.col("x"), lexicon)).collect()]
    for shown, counts in zip(texts, got):
        folded = (shown or "").lower()
        assert counts == [sum(k.lower() in folded for k in t.keywords) for t in lexicon.topics]


def test_dominant_topic_ties_and_default(value):
    lexicon = lx.Lexicon.of({"a": ["x1"], "b": ["x2"], "c": {"keywords": ["x3"], "weight": 3.0}})
    area = lx.dominant_topic(lx.topic_counts(F.col("x"), lexicon), lexicon)
    assert value(area, x="x2 x1") == "a"
    assert value(area, x="x1 x3") == "c"
    assert value(area, x="nothing") == "기타"
    assert value(area, x=None) == "기타"


def test_matched_keywords_keep_their_spelling(value):
    lexicon = lx.Lexicon.of({"기술": ["R&D", "과학"]})
    found = value(lx.topic_matches(F.col("x"), lexicon), x="r&d 예산")
    assert [(h["topic"], h["matched"]) for h in found] == [("기술", ["R&D"])]


def test_scores_count_hits_and_speeches_apart(spark):
    lexicon = lx.Lexicon.of({"t": {"keywords": ["가", "나"], "weight": 0.5}})
    df = spark.createDataFrame([("p", "가나"), ("p", "가"), ("p", None), ("p", "다")], "party string, x string")
    cell = lx.topic_scores(df.withColumn("topic_counts", lx.topic_counts(F.col("x"), lexicon)), lexicon, ["party"]).first()
    assert (cell["speeches"], cell["hits"], cell["covered"]) == (4, 3, 2)
    assert cell["score"] == pytest.approx(3 * 0.5 / 4)
    assert cell["coverage_pct"] == 50.0
    assert cell["hits_per_100"] == 75.0


def test_many_topics_equal_few(spark, monkeypatch):
    lexicon = lx.Lexicon.of({"t": ["가", "나"], "u": ["다"], "v": ["없"]}, weights={"u": 0.5})
    df = spark.createDataFrame([("p", "가나"), ("p", "가"), ("p", None), ("q", "다"), (None, "라"), (None, "다")], "party string, x string")
    counted = df.withColumn("topic_counts", lx.topic_counts(F.col("x"), lexicon)).unionByName(
        spark.createDataFrame([("q", None, None)], "party string, x string, topic_counts array<int>")
    )
    few = lx.topic_cells(counted, lexicon, ["party"])
    monkeypatch.setattr(lx, "MANY_TOPICS", 2)
    many = lx.topic_cells(counted, lexicon, ["party"])
    zero = lambda frame: sorted(tuple(r) for r in frame.fillna({"party": "", "hits": 0, "covered": 0}).collect())
    assert many.dtypes == few.dtypes and zero(many) == zero(few) and len(zero(many)) == 9


def test_lexicon_table_round_trip(spark):
    stored = AREAS.to_table(spark, "areas")
    assert lx.Lexicon.from_table(stored, "areas") == AREAS
    with pytest.raises(ValueError):
        lx.Lexicon.from_table(stored, "areas", max_topics=3)


def test_sentiment_rules(value):
    plain = lx.Lexicon.of(values.SENTIMENT)
    weighted = lx.Lexicon.of(values.CONVERSATION_SENTIMENT, weights={"neutral": 0.5})

    def of(lexicon, shown):
        s = value(sentiment.sentiment(F.col("x"), lexicon), x=shown)
        return s["label"], round(s["score"], 4)

    assert of(plain, "성공 성과 실패")[0] == "positive"
    assert of(plain, "반대")[0] == "negative"
    assert of(plain, "성공 검토")[0] == "neutral"
    assert of(plain, "성공 실패")[0] == "neutral"
    assert of(weighted, "성공 검토") == ("positive", round(1 / 1.5, 4))
    assert of(weighted, "실패 위기 검토") == ("negative", round(-2 / 2.5, 4))
    assert of(weighted, "") == ("neutral", 0.0)
    assert of(weighted, None) == ("neutral", 0.0)


def test_policy_reason_order(spark):
    long = "예산과 정책을 논의합니다 " * 5
    data = [
        (1, None, "위원"), (2, "회의를 개회 " + long, "위원장"), (3, "회의를 개회 " + long, "위원"),
        (4, ("예산 정책 " + "가" * 50)[:49], "위원"), (5, ("예산 정책 " + "가" * 50)[:50], "위원"),
        (6, "가" * 60 + "예산", "위원"), (7, "정책 네", "위원장대리"),
    ]
    df = spark.createDataFrame(data, "k int, x string, p string")
    got = df.select("k", filters.policy_reason(filters.policy_features(F.col("x")), F.col("p")).alias("r"))
    assert dict(rows(got)) == {
        1: "null_text", 2: "procedural", 3: "keep", 4: "short", 5: "keep", 6: "few_policy_words", 7: "procedural",
    }


def test_quality_length(value):
    ok = filters.is_substantive(F.col("x"))
    assert value(ok, x="\n" + "가" * 30 + " ")
    assert not value(ok, x="가" * 29 + "   ")
    assert not value(ok, x="   ")
    assert not value(ok, x=None)


def test_group_filters(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 9 + [("미분류",)] * 20 + [("",), (None,)], "party string")
    named = df.filter(filters.is_named_group(F.col("party")))
    assert filters.eligible_groups(named, "party", 10).distinct().collect()[0][0] == "a"
    assert filters.select_groups(df, "party", []).count() == df.count()
    assert filters.select_groups(df, "party", ["b"]).count() == 9


def test_pattern_lengths(value):
    spoken = "가" * 5 + "." + "나" * 6 + "!" + "다" * 10 + "?" + "라" * 11 + "." + "마" * 30 + "." + "바" * 31
    p = value(patterns.speech_patterns(F.col("x")), x=spoken)
    assert (p["questions"], p["exclamations"], p["sentences"]) == (1, 1, 5)
    assert (p["long_sentences"], p["short_sentences"]) == (1, 2)


def speech(spark, data):
    return spark.createDataFrame(
        data, "session_name string, file_name string, speech_order int, speaker_name string, party string, "
        "agenda_item_titles string, speech_text string"
    )


@pytest.mark.parametrize("block", [1, 2, 3, 65_536])
def test_qa_pairs_cross_files_and_blocks(spark, block):
    data = [
        ("s", "1", 1, "a", "p", "t", "질문 있습니다"), ("s", "1", 2, "b", "q", "t", "답변드리겠습니다"),
        ("s", "1", 5, "a", "p", "t", "무엇입니까?"), ("s", "2", 1, "c", "q", "t", "설명드리겠습니다"),
        ("s", "2", 2, "c", "q", "t", "혼잣말"), ("r", "1", 1, "x", "p", "t", "답변"), ("r", "1", 9, "x", "p", "t", "질의"),
    ]
    df = speech(spark, data)

    def keys(**options):
        return rows(dialogue.qa_pairs(df, block=block, **options).select("session_name", "question_file", "question_order", "answer_speaker_name"))

    assert keys() == [("s", "1", 1, "b"), ("s", "1", 5, "c")]
    assert keys(across_files=False) == [("s", "1", 1, "b")]
    assert dialogue.qa_pairs(df, block=block).filter("question = '무엇입니까?'").first()["answer"] == "설명드리겠습니다"


def test_pair_numbers(spark):
    pairs = spark.createDataFrame(
        [("s", "1", o) for o in (1, 4, 9)] + [("s", "2", o) for o in (1, 2)], "session_name string, question_file string, question_order int"
    )
    got = chunks.numbered_pairs(pairs, block=2)
    assert [r[3] for r in rows(got.select("session_name", "question_file", "question_order", "pair_index"))] == [0, 1, 2, 3, 4]


def test_session_sample_sizes(spark):
    data = [("s", f"{f}", o, f"u{o}", f"p{(f + o) % 7}", "t", f"t{f}{o}") for f in range(3) for o in range(1, 40)]
    df = speech(spark, data).withColumn("speech_key", F.monotonically_increasing_id())
    picked = dialogue.session_sample(df).collect()
    assert len(picked) == 20
    sizes = Counter(r["party"] for r in picked)
    assert list(sizes.values()) == [5, 5, 5, 5]
    assert {r["speech_key"] for r in dialogue.session_sample(df.repartition(3)).collect()} == {r["speech_key"] for r in picked}


def test_leading_agendas_drop_blank_after_the_cut(spark):
    data = [("s", "1", i, "a", "p", t, "x") for i, t in enumerate(["", "", "", "A", "A", "B", "C"])]
    got = dialogue.leading_agendas(speech(spark, data), k=2)
    assert rows(got.select("agenda_item_titles", "speeches")) == [("A", 2)]


@pytest.mark.parametrize("length", [0, 1, 800, 801, 1500, 2300])
def test_chunks(value, length):
    whole = "".join(chr(0xAC00 + i % 3000) for i in range(length))
    cut = value(chunks.chunk_array(F.col("x")), x=whole)
    starts = list(range(0, length, 700)) if length > 800 else [0] if length else []
    assert cut == [whole[s : s + 800] for s in starts]
    assert "".join(c[:700] for c in cut[:-1]) + (cut[-1] if cut else "") == whole


def test_rank_slices(spark):
    top = spark.createDataFrame([("p", f"w{i:02}", i) for i in range(1, 31)] + [("q", f"w{i}", i) for i in range(1, 4)], "party string, term string, rank int")
    got = {(r["party"], r["topic_id"]): r["words"] for r in terms.rank_slices(top, ["party"]).collect()}
    assert got[("p", 0)] == [f"w{i:02}" for i in range(1, 7)]
    assert got[("p", 4)] == [f"w{i:02}" for i in range(25, 31)]
    assert got[("q", 4)] == ["w1", "w2", "w3"] and ("q", 0) not in got


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"])], "k int, t array<string>")
    got = {r["term"]: r["weight"] for r in terms.tfidf_keywords(df, F.col("t"), "k", max_features=3).collect()}
    idf_a, idf_x = 1.0, math.log(3 / 2) + 1
    n1, n2 = math.hypot(2 * idf_a, idf_x), math.hypot(idf_a, idf_x)
    assert got["a"] == pytest.approx((2 / n1 + 1 / n2) / 2)
    assert got["b"] == pytest.approx(idf_x / n1 / 2)


def test_tfidf_of_pairs_by_group(spark):
    rows = [("p", 1, ["a", "b", "a", "b"]), ("p", 2, ["b", "c"]), ("p", 3, []), ("p", 4, None), ("q", 5, ["c", "c", "é"]), ("q", 6, ["a"]), ("r", 7, ["a"])]
    grams = [(g, k, t and t + [f"{a} {b}" for a, b in zip(t, t[1:])]) for g, k, t in rows]
    got, same = (
        {
            (r["g"], r["term"]): r["weight"]
            for r in terms.tfidf_keywords(spark.createDataFrame(x, "g string, k int, t array<string>"), F.col("t"), "k", ["g"], 3, 3, 1, pairs=p).collect()
        }
        for x, p in ((rows, True), (grams, False))
    )
    want = {}
    for group, n in (("p", 4), ("q", 2)):
        bags = [Counter(t or []) for g, _, t in grams if g == group]
        total, held = sum(bags, Counter()), Counter(t for b in bags for t in b)
        idf = {t: math.log((1 + n) / (1 + held[t])) + 1 for t in sorted(total, key=lambda t: (-total[t], t))[:3]}
        for bag in bags:
            norm = math.sqrt(sum((bag[t] * idf[t]) ** 2 for t in idf))
            for t in idf.keys() & bag.keys():
                want[group, t] = want.get((group, t), 0) + bag[t] * idf[t] / norm / n
    assert got == same == {x: pytest.approx(w) for x, w in want.items()}


def test_month_extremes_take_the_first_month(spark):
    df = spark.createDataFrame([("t", "2024-02", 1.0), ("t", "2024-01", 1.0), ("t", "2024-03", 0.0), ("t", "2024-04", 0.0)], "topic string, month string, score double")
    r = rollups.month_extremes(df, "month").first()
    assert (r["max_month"], r["min_month"], r["mean_score"]) == ("2024-01", "2024-03", 0.5)


def test_cohort_totals_leave_the_session_number_out(spark):
    df = spark.createDataFrame([(415, "기타")] * 3 + [(416, "안전관리")] * 2, "session int, area string")
    got = rollups.cohorts(df, "session", "area", {"early": (415, 416)})
    assert rows(got.select("cohort", "area", "speeches")) == [("early", "기타", 3), ("early", "안전관리", 2)]


def test_default_party(spark):
    dim = spark.createDataFrame(list(values.PARTY_OF_SPEAKER.items()), "speaker_name string, party string")
    df = spark.createDataFrame([("용혜인",), ("아무개",), (None,)], "speaker_name string")
    got = {r["speaker_name"]: r["party"] for r in rollups.attach_group(df, dim, "speaker_name", "party").collect()}
    assert got == {"용혜인": "기본소득당", "아무개": "미분류", None: "미분류"}


def test_speakers_count_once_per_file(spark):
    df = spark.createDataFrame(
        [("s", "1", "a", "p"), ("s", "1", "a", "p"), ("s", "2", "a", "p"), ("r", "1", "b", "p")], "s string, f string, n string, party string"
    )
    got = {(r["scope"], r["measure"]): r["n"] for r in rollups.speaker_tallies(df, "s", "f", "n", "party").collect()}
    assert got == {("all", "speakers"): 2, ("s", "speakers"): 1, ("r", "speakers"): 1, ("s", "party"): 2, ("r", "party"): 1, ("all", "party"): 3}


def test_digest_is_independent_of_partitioning(spark):
    df = spark.createDataFrame([("s", i, f"text {i}") for i in range(200)] + [("r", 1, None)], "s string, o int, x string")
    one = rows(incremental.session_digests(df.repartition(7), "s", ["o", "x"]))
    assert one == rows(incremental.session_digests(df.coalesce(1), "s", ["x", "o"]))
    changed = df.withColumn("x", F.when(F.col("o") == 7, "").otherwise(F.col("x")))
    other = dict((r[0], r[2]) for r in rows(incremental.session_digests(changed, "s", ["o", "x"])))
    before = dict((r[0], r[2]) for r in one)
    assert other["s"] != before["s"] and other["r"] == before["r"]
    blank = incremental.session_digests(spark.createDataFrame([("r", 1, "")], "s string, o int, x string"), "s", ["o", "x"])
    assert blank.first()["hash_digest"] != before["r"]


def test_work_list(spark):
    incoming = spark.createDataFrame([("new", "h"), ("same", "h"), ("other", "h"), ("bare", None), ("old", "h")], "session_name string, hash_digest string")
    stored = spark.createDataFrame(
        [("same", "h", "v1"), ("other", "g", "v1"), ("bare", "h", "v1"), ("old", "h", "v0")], "session_name string, hash_digest string, analysis_version string"
    )
    got = {r["session_name"]: r["reason"] for r in incremental.sessions_to_process(incoming, stored, "v1").collect()}
    assert got == {"new": "new", "same": "unchanged", "other": "content_changed", "bare": "no_hash", "old": "version_changed"}
    forced = incremental.sessions_to_process(incoming, stored, "v1", force=True)
    assert {r["reason"] for r in forced.collect()} == {"forced"}


def test_upsert_and_deletes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    merged = incremental.upsert(old, new, ["k"])
    assert rows(merged) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(incremental.upsert(merged, new, ["k"])) == rows(merged)
    assert rows(incremental.delete_keys(merged, new, ["k"])) == [(1, "a")]
    meta = spark.createDataFrame([('{"session_name":"s"}',), ('{"session_name":"r"}',), (None,)], "m string")
    assert incremental.delete_where(meta, incremental.in_session(F.col("m"), "s")).count() == 2


def test_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "k int, embedding array<float>")
    queries = spark.createDataFrame([("q", [2.0, 0.0])], "name string, embedding array<double>")
    got = incremental.nearest(df, incremental.query_list(queries, "name"), "k", k=2)
    assert [r["k"] for r in got.orderBy("rank").collect()] == [1, 2]
    two = queries.unionAll(queries)
    with pytest.raises(Exception, match="more than 1 query"):
        incremental.nearest(df, incremental.query_list(two, "name", limit=1), "k").collect()


def test_top_terms_of_large_groups_only(spark):
    df = spark.createDataFrame([("a", ["x", "y", "x"]), ("a", []), ("a", None), ("b", ["x"])], "g string, t array<string>")
    got = rows(terms.top_terms(df, F.col("t"), ["g"], 1, at_least=3))
    assert got == [("a", "x", 2, 1)]
    assert len(rows(terms.top_terms(df, F.col("t"), ["g"], 5))) == 3


def test_grid_and_missing_vectors(spark):
    df = spark.createDataFrame([("s", "r1", "c1"), ("s", "r2", "c2"), ("s", "r2", None), ("t", "r1", "c3")], "s string, r string, c string")
    grid = rows(rollups.dense_grid(df, "s", "r", "c", F.count(F.lit(1)), "n"))
    assert grid == [("s", "r1", "c1", 1), ("s", "r1", "c2", 0), ("s", "r2", "c1", 0), ("s", "r2", "c2", 1), ("t", "r1", "c3", 1)]
    hashes = spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 3)], "content_hash string, k int")
    assert rows(incremental.missing_vectors(hashes, hashes.filter("k = 3"))) == [("h1",)]


def test_group_rank_over_several_parts(spark):
    """Ranks go on across range parts; ties by group, a null topic is a topic."""
    rows = [(t, f"g{i:03d}", float(i % 7)) for t in ("a", "b", None) for i in range(120)]
    scores = spark.createDataFrame(rows, "topic string, party string, score double")
    got = {(r["topic"], r["party"]): r["rank"] for r in rollups.group_rank(scores, "party").collect()}
    want = {}
    for t in ("a", "b", None):
        for place, (_, g) in enumerate(sorted((-s, g) for u, g, s in rows if u == t), 1):
            want[t, g] = place
    assert got == want


def test_repeated_hash_in_vectors_adds_no_rows(spark):
    rows = spark.createDataFrame([(1, "h"), (2, "h"), (3, "x"), (4, None)], "id int, content_hash string")
    vectors = spark.createDataFrame([("h", [2.0]), ("h", [1.0]), ("h", [1.0])], "content_hash string, embedding array<double>")
    got = sorted((r["id"], r["embedding"]) for r in incremental.attach_vectors(rows, vectors).collect())
    assert got == [(1, [1.0]), (2, [1.0]), (3, None), (4, None)]


def test_session_payload(spark):
    rows = [("s", "a", "p", "x", "one"), ("s", "a", None, "y", "two"), ("s", " ", "q", "z", "three"), ("t", None, None, "w", None)]
    df = spark.createDataFrame(rows, "session_name string, agenda_item_titles string, party string, speaker_name string, speech_text string")
    sample = spark.createDataFrame([("s", 2, "q", "z", "three"), ("s", 1, "p", "x", "one"), ("s", 3, "p", "x", "late")], "session_name string, sample_no int, party string, speaker_name string, speech_text string")
    got = {r["session_name"]: r for r in dialogue.session_payload(df, sample, cut=2, most=2).collect()}
    assert got["s"]["total_speeches"] == 3 and got["s"]["agenda_stats"] == {"a": 2} and got["s"]["party_stats"] == {"p": 1, "q": 1}
    assert [tuple(x) for x in got["s"]["speeches_sample"]] == [("p", "x", "on"), ("q", "z", "th")]
    assert got["t"]["total_speeches"] == 1 and got["t"]["agenda_stats"] == {} and got["t"]["party_stats"] == {} and got["t"]["speeches_sample"] == []
