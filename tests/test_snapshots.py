import random

import pytest
from pyspark.sql import functions as F

from speechmill.operators import incremental, retractable, rollups
from speechmill.operators import lexicon as lx
from speechmill.plans import refresh
from speechmill.sources import snapshots

SCHEMA = "name string, n int"
LEXICON = lx.Lexicon.of({"a": {"keywords": ["apple", "pear"], "weight": 2.0}, "b": ["plum"]})


def state(spark, root, table="t", number=None):
    return sorted((str(r["name"]), r["n"]) for r in snapshots.read(spark, root, table, SCHEMA, "name", number).collect())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_runs_take_effect_by_their_commit_alone(spark, tmp_path):
    root = str(tmp_path)
    assert state(spark, root) == [] and snapshots.newest(spark, root) is None
    first = snapshots.Run(spark, root)
    first.write("t", frame(spark, ("x/y=z", 1), ("제1회", 2), (None, 3), ("x/y=z", 1)), "name")
    first.write("u", frame(spark, ("p", 9)), "name")
    assert state(spark, root) == []
    assert first.commit() == 1
    begun = state(spark, root)
    assert begun == [("None", 3), ("x/y=z", 1), ("x/y=z", 1), ("제1회", 2)] and state(spark, root, "u") == [("p", 9)]

    # A run that stops after it wrote files, and one that stops inside its commit, change nothing.
    snapshots.Run(spark, root).write("t", frame(spark, ("제1회", 5)), "name")
    (tmp_path / "snapshots" / "000000000002").mkdir()
    assert state(spark, root) == begun

    # Keys to replace lose their rows, with new ones or without; other keys and tables stay.
    last = snapshots.Run(spark, root)
    written = last.write("t", frame(spark, ("제1회", 7)), "name", frame(spark, ("제1회", 0), (None, 0), ("absent", 0)))
    assert [tuple(r) for r in written.collect()] == [("제1회", 7)]
    assert last.commit() == 3 and snapshots.newest(spark, root) == 3
    assert state(spark, root) == [("x/y=z", 1), ("x/y=z", 1), ("제1회", 7)] and state(spark, root, "u") == [("p", 9)]
    assert state(spark, root, number=1) == begun


def test_run_without_rows(spark, tmp_path):
    root = str(tmp_path)
    run = snapshots.Run(spark, root)
    run.write("t", frame(spark, ("a", 1)).limit(0), "name")
    run.commit()
    assert state(spark, root) == [] and state(spark, root, "never written") == []


def speeches(spark, seed, sessions):
    random.seed(seed)
    rows = [
        (s, random.choice(["2024-01", "2024-02", None]), random.choice(["p", "q", None]), " ".join(random.choice(["apple", "pear", "plum", "fig"]) for _ in range(3)))
        for s in sessions for _ in range(12)
    ]
    df = spark.createDataFrame(rows, "session_name string, month string, party string, speech_text string")
    return df.withColumn("d", F.to_date(F.concat("month", F.lit("-03"))))


def scored(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(set(df.columns) - {"level", "first_date", "last_date"})).collect())


@pytest.fixture
def counts():
    return lx.topic_counts(F.col("speech_text"), LEXICON)


def test_updates_equal_a_full_recomputation(spark, tmp_path, counts):
    root, now = str(tmp_path), None
    # Sessions come, change and go; the last run finds nothing to do.
    for seed, sessions in ((1, "abc"), (2, "bcd"), (3, "d"), (3, "d")):
        now = speeches(spark, seed, sessions)
        digests = incremental.session_digests(now, "session_name", ["month", "party", "speech_text"])
        work = refresh.update_topics(now.withColumn("topic_counts", counts), digests, root, LEXICON, "v1")
        reasons = {r["session_name"]: r["reason"] for r in work.collect()}
        cells, sums = refresh.topic_table(spark, "topic_cells", root), refresh.topic_table(spark, "topic_totals", root)
        full = rollups.topic_rollup(now.withColumn("topic_counts", counts), LEXICON, "session_name", "month", "party", "d")
        columns = retractable.session_scores(cells).columns
        assert scored(retractable.session_scores(cells)) == scored(full.filter("level = 'session'").select(columns))
        columns = retractable.group_scores(sums, ["month", "party"]).columns
        assert scored(retractable.group_scores(sums, ["month", "party"])) == scored(full.filter("level = 'party_month'").select(columns))
        if seed == 2:
            assert reasons == {"a": "gone", "b": "content_changed", "c": "content_changed", "d": "new"}
    assert reasons == {}


def test_counts_are_taken_after_the_sessions(spark, counts):
    counted = speeches(spark, 1, "ab").withColumn("topic_counts", counts)
    work = spark.createDataFrame([("a", "new")], "session_name string, reason string")
    plan = retractable.session_cells(incremental.changed_rows(counted, work), LEXICON)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("topic_counts") < plan.index("LeftSemi")


def test_gone_groups_vanish(spark):
    one = retractable.session_cells(speeches(spark, 4, "a").withColumn("topic_counts", F.array(F.lit(1), F.lit(0))), LEXICON)
    before = retractable.totals(one)
    assert before.count() > 0 and retractable.advanced(before, one, one.limit(0)).count() == 0
