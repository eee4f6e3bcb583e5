"""Aggregations, pivots and rankings over classified speeches and topic cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.fields import session_number
from speechmill.operators.lexicon import Lexicon, topic_columns, topic_measures, with_scores
from speechmill.session import kept


# Up to this rank Spark limits ranked groups inside each task (its windowGroupLimitThreshold).
TASK_LIMIT = 1000
SPLITS = 64


def attach_group(df: DataFrame, dimension: DataFrame, key: str, group: str, default: str = values.NO_PARTY) -> DataFrame:
    """Left join to a dimension with one row per key; keys it lacks get ``default``.

    No broadcast hint: the dimension is broadcast when its size at run time is below the session's
    threshold, and above it adaptive execution splits the partitions of very frequent keys.
    """
    return df.join(dimension.select(key, group), key, "left").withColumn(
        group, F.coalesce(F.col(group), F.lit(default))
    )


def counts_with_share(df: DataFrame, by: str, out: str = "speeches") -> DataFrame:
    """Rows per value and share of all rows."""
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias(out))
    total = counted.agg(F.sum(out).alias("t")).scalar()
    return counted.withColumn("share_pct", F.col(out) / total * 100)


def area_matrix(df: DataFrame, session: str, area: str, areas: Sequence[str]) -> DataFrame:
    """Session by area counts, absent combinations 0, with the number taken from the session name."""
    counted = df.groupBy(session).agg(*[F.count_if(F.col(area) == a).alias(a) for a in areas])
    return counted.withColumn("session_num", session_number(F.col(session)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    Up to a thousand rows Spark applies the limit inside every task before the shuffle. A longer
    list is first ranked in ``SPLITS`` parts of each group, so that no task sorts a whole group.
    """
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if k > TASK_LIMIT:
        part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in by]), F.lit(SPLITS))
        within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
        df = df.withColumn("_part", part).withColumn(rank, within).filter(F.col(rank) <= k).drop("_part", rank)
    return df.withColumn(rank, first).filter(F.col(rank) <= k)


def top_topics(scores: DataFrame, group: Sequence[str], k: int = 5) -> DataFrame:
    return top_k(scores, group, [F.desc("score"), F.asc("topic_ord")], k)


def group_rank(scores: DataFrame, group: str) -> DataFrame:
    """Rank of every group inside each topic; rank 1 leads, ties by group.

    Rows are dealt by ranges of (topic, score, group) and stored, so a topic may lie in many parts. A row's
    rank is its place in its part and the number of the topic's rows in the parts before.
    """
    order = [F.desc("score"), F.asc(group)]
    dealt = scores.repartitionByRange(F.asc("topic"), *order).withColumn("_part", F.spark_partition_id())
    dealt = kept(dealt, "rank-parts")
    # One row for each topic and part.
    counted = dealt.groupBy("topic", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("topic").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(F.col("topic").alias("_topic"), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("topic", "_part").orderBy(*order))
    same = F.col("topic").eqNullSafe(F.col("_topic")) & (F.col("_part") == F.col("_at"))
    placed = dealt.withColumn("_place", place).join(offsets, same)
    return placed.withColumn("rank", (F.col("_before") + F.col("_place")).cast("int")).drop("_topic", "_part", "_at", "_place", "_before")


def peak(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Where ``value`` is largest for each ``by``; the earliest wins a tie."""
    return (
        df.groupBy(by, at)
        .agg(F.sum(value).alias("v"))
        .groupBy(by)
        .agg(F.min(F.struct((-F.col("v")).alias("neg"), F.col(at).alias("at"))).alias("best"))
        .select(by, F.col("best.at").alias(f"peak_{at}"), (-F.col("best.neg")).alias("peak_value"))
    )


def leading_peaks(cells: DataFrame, by: str, at: str, value: str, k: int) -> DataFrame:
    """Peaks of the ``k`` values of ``by`` with the largest totals."""
    totals = cells.groupBy(by).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), F.asc(by)).limit(k)
    return peak(cells, by, at, value).join(totals, by, "left_semi")


def leading_values(df: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(by)).limit(k)


def cohorts(df: DataFrame, session: str, area: str, members: Mapping[str, Sequence], k: int = 3) -> DataFrame:
    """Top areas of named sets of sessions."""
    cohort = F.lit(None).cast("string")
    for name, sessions in members.items():
        cohort = F.when(F.col(session).isin(list(sessions)), name).otherwise(cohort)
    counted = (
        df.select(cohort.alias("cohort"), area)
        .filter(F.col("cohort").isNotNull())
        .groupBy("cohort", area)
        .agg(F.count(F.lit(1)).alias("speeches"))
    )
    return top_k(counted, ["cohort"], [F.desc("speeches"), F.asc(area)], k)


def speaker_tallies(df: DataFrame, session: str, file: str, speaker: str, party: str) -> DataFrame:
    """Distinct speakers, and party tallies that count a speaker once per file.

    Rows: scope (``all`` or a session), measure (``speakers`` or ``party``), party, n. The distinct
    speakers of the files are stored, so the speeches are read once.
    """
    seen = kept(df.select(session, file, speaker, party).distinct(), "speakers-seen")
    tallies = seen.groupBy(session, party).agg(F.count(F.lit(1)).alias("n"))
    in_session = seen.select(session, speaker).distinct()
    per_session = in_session.groupBy(session).agg(F.count(F.lit(1)).alias("n"))
    overall = in_session.select(speaker).distinct().agg(F.count(F.lit(1)).alias("n"))

    def shape(frame: DataFrame, scope: Column, measure: str, group: Column) -> DataFrame:
        return frame.select(
            scope.cast("string").alias("scope"), F.lit(measure).alias("measure"), group.alias("party"), "n"
        )

    every = F.lit("all")
    return (
        shape(overall, every, "speakers", F.lit(""))
        .unionByName(shape(per_session, F.col(session), "speakers", F.lit("")))
        .unionByName(shape(tallies, F.col(session), "party", F.col(party)))
        .unionByName(
            shape(tallies.groupBy(party).agg(F.sum("n").alias("n")), every, "party", F.col(party))
        )
    )


def topic_rollup(
    df: DataFrame, lexicon: Lexicon, session: str, month: str, party: str, date: str, counts: str = "topic_counts"
) -> DataFrame:
    """Topic scores by session, by month and by party and month in one pass over the speeches.

    The speeches are reduced to (session, month, party) first; the three groupings are computed
    from that small result, so the table is read and shuffled once.
    """
    keyed = df.filter(F.col(date).isNotNull())
    finest = keyed.groupBy(session, month, party).agg(
        F.count(F.lit(1)).alias("speeches"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        *topic_measures(lexicon, counts),
    )
    additive = [c for c in finest.columns if c == "speeches" or c.startswith(("_h", "_c"))]
    measures = [F.sum(c).alias(c) for c in additive]
    measures += [F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")]
    sets = [[F.col(session)], [F.col(month)], [F.col(month), F.col(party)]]
    grouped = finest.groupingSets(sets, session, month, party).agg(
        *measures, F.grouping(session).alias("_s"), F.grouping(party).alias("_p")
    )
    level = F.when(F.col("_s") == 0, "session").when(F.col("_p") == 0, "party_month").otherwise("month")
    return with_scores(
        grouped.select(
            level.alias("level"), session, month, party, "speeches", "first_date", "last_date", topic_columns(lexicon)
        )
    )


def month_extremes(monthly: DataFrame, month: str) -> DataFrame:
    """Month of the highest and lowest score and the mean, per topic; the first month wins ties."""
    high = F.min(F.struct((-F.col("score")).alias("s"), F.col(month).alias("m")))
    low = F.min(F.struct(F.col("score").alias("s"), F.col(month).alias("m")))
    return (
        monthly.groupBy("topic")
        .agg(high.alias("high"), low.alias("low"), F.avg("score").alias("mean_score"))
        .select(
            "topic",
            F.col("high.m").alias("max_month"),
            (-F.col("high.s")).alias("max_score"),
            F.col("low.m").alias("min_month"),
            F.col("low.s").alias("min_score"),
            "mean_score",
        )
    )


def mean_topics(party_monthly: DataFrame, party: str, k: int) -> DataFrame:
    """Topics with the highest mean of monthly scores, per party."""
    means = party_monthly.groupBy(party, "topic", "topic_ord").agg(F.avg("score").alias("mean_score"))
    return top_k(means, [party], [F.desc(F.round("mean_score", 9)), F.asc("topic_ord")], k)


def dense_series(party_monthly: DataFrame, party: str, month: str, months: DataFrame, k: int = 3) -> DataFrame:
    """Monthly scores of each party's ``k`` leading topics, months without the party 0.

    A party's scores of a topic become one small map, so the scores are computed once for the
    ranking and for the series. The list of months is an array from a scalar subquery that each
    row explodes; no cross join is planned.
    """
    per_topic = party_monthly.groupBy(party, "topic", "topic_ord").agg(
        F.avg("score").alias("mean_score"),
        F.map_from_entries(F.collect_list(F.struct(month, "score"))).alias("_by_month"),
    )
    top = top_k(per_topic, [party], [F.desc(F.round("mean_score", 9)), F.asc("topic_ord")], k)
    every = months.filter(F.col(month).isNotNull()).agg(F.collect_set(month).alias("months")).scalar()
    return top.select(party, "topic", "_by_month", F.explode(every).alias(month)).select(
        party, "topic", month, F.coalesce(F.try_element_at("_by_month", F.col(month)), F.lit(0.0)).alias("score")
    )


def dense_grid(df: DataFrame, scope: str, row: str, column: str, value: Column, out: str) -> DataFrame:
    """Every row label against every column label of the same scope; absent cells 0. Cells are stored."""
    cells = kept(df.groupBy(scope, row, column).agg(value.alias(out)), "grid-cells")
    labels = cells.select(scope, column).filter(F.col(column).isNotNull()).distinct()
    grid = cells.select(scope, row).distinct().join(labels, scope)
    return grid.join(cells, [scope, row, column], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def session_tiles(df: DataFrame, kept: Column) -> DataFrame:
    """One row: all speeches, kept speeches, kept share."""
    return df.agg(F.count(F.lit(1)).alias("total_speeches"), F.count_if(kept).alias("quality_speeches")).withColumn(
        "kept_pct", F.coalesce(F.try_divide(F.col("quality_speeches") * 100, F.col("total_speeches")), F.lit(0.0))
    )


def load_totals(df: DataFrame, kind: str, session: str) -> DataFrame:
    return df.groupBy(kind, session).agg(F.count(F.lit(1)).alias("rows"))
