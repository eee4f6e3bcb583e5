"""Keyword sentiment: labels, scores and their distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechmill.functions.expr import let
from speechmill.operators.lexicon import Lexicon, topic_counts

LABELS = ("positive", "negative", "neutral")


def sentiment(text: Column, lexicon: Lexicon) -> Column:
    """STRUCT<label, score>; the lexicon's topics are positive, negative, neutral in this order.

    A label wins only when its weighted count is strictly above both others. The score is the
    signed share of the winner in the total, 0 for neutral.
    """
    weight = [t.weight for t in lexicon.topics]

    def judge(n: Column) -> Column:
        pos, neg, neu = (F.get(n, F.lit(i)) * F.lit(weight[i]) for i in range(3))
        total = pos + neg + neu
        is_pos = (pos > neg) & (pos > neu)
        is_neg = (neg > pos) & (neg > neu)
        return F.struct(
            F.when(is_pos, LABELS[0]).when(is_neg, LABELS[1]).otherwise(LABELS[2]).alias("label"),
            F.when(is_pos, pos / total).when(is_neg, -neg / total).otherwise(F.lit(0.0)).alias("score"),
        )

    return let(topic_counts(text, lexicon), judge)


def label_distribution(df: DataFrame, by: Sequence[str] = (), label: str = "label", more_than: int = 0) -> DataFrame:
    """Rows and share per label, over everything or per group of more than ``more_than`` rows."""
    counted = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("speeches"))
    # The window sees one row per group and label.
    scope = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    totalled = counted.withColumn("group_speeches", F.sum("speeches").over(scope))
    return totalled.filter(F.col("group_speeches") > more_than).select(
        *by, label, "speeches", (F.col("speeches") / F.col("group_speeches") * 100).alias("share_pct")
    )


def label_matrix(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    """One row per group, one column per label, absent combinations 0."""
    return df.groupBy(by).agg(*[F.count_if(F.col(label) == name).alias(name) for name in LABELS])


def tone(df: DataFrame, by: Sequence[str], score: str = "score", edge: float = 0.1) -> DataFrame:
    """Mean score per group and the tone it stands for."""
    mean = F.col("mean_score")
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("speeches"), F.avg(score).alias("mean_score"))
        .withColumn("tone", F.when(mean > edge, "positive").when(mean < -edge, "negative").otherwise("neutral"))
    )


def issue_trend(mentions: DataFrame, by: Sequence[str] = ("session_name", "issue"), speakers: int = 3) -> DataFrame:
    """Frequency, mean sentiment and most frequent speakers per session and issue.

    ``mentions`` carries ``speaker_name`` and ``score``. Speakers are counted first, so the ranking
    sees one row per speaker.
    """
    by = list(by)
    per_speaker = mentions.groupBy(*by, "speaker_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum")
    )
    totals = per_speaker.groupBy(*by).agg(
        F.sum("n").alias("frequency"), (F.sum("score_sum") / F.sum("n")).alias("sentiment_score")
    )
    rank = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("speaker_name"))
    notes = (
        per_speaker.withColumn("rn", F.row_number().over(rank))
        .filter(F.col("rn") <= speakers)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("rn", "speaker_name"))).alias("top"))
        .select(*by, F.array_join(F.transform("top", lambda s: s["speaker_name"]), ", ").alias("notes"))
    )
    return totals.join(notes, by)
