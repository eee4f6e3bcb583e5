"""Topic scores kept as sums, from which a changed session can be taken out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmill.operators.lexicon import Lexicon, topic_columns, topic_measures, with_scores

MEASURES = ("speeches", "hits", "covered")
TOPIC = ("topic", "topic_ord", "weight")


def session_cells(
    df: DataFrame, lexicon: Lexicon, session: str = "session_name", by: Sequence[str] = ("month", "party"), date: str = "d", counts: str = "topic_counts"
) -> DataFrame:
    """Sums of each session by ``by`` and topic, with the cell's first and last date; speeches without a date are left out."""
    dates = [F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    reduced = df.filter(F.col(date).isNotNull()).groupBy(session, *by).agg(F.count(F.lit(1)).alias("speeches"), *dates, *topic_measures(lexicon, counts))
    return reduced.select(session, *by, "speeches", "first_date", "last_date", topic_columns(lexicon))


def _summed(cells: DataFrame, by: Sequence[str], *more) -> DataFrame:
    return cells.groupBy(*by, *TOPIC).agg(*[F.sum(m).alias(m) for m in MEASURES], *more)


def totals(cells: DataFrame, by: Sequence[str] = ("month", "party")) -> DataFrame:
    """Sums over all sessions."""
    return _summed(cells, by)


def advanced(before: DataFrame, retracted: DataFrame, added: DataFrame, by: Sequence[str] = ("month", "party")) -> DataFrame:
    """``totals`` after the cells of ``retracted`` left and those of ``added`` came.

    Groups without speeches are gone. Sums are whole numbers, so nothing drifts however often this is repeated.
    """
    columns = [*by, *TOPIC]
    minus = retracted.select(*columns, *[(-F.col(m)).alias(m) for m in MEASURES])
    moved = before.select(*columns, *MEASURES).unionByName(minus).unionByName(added.select(*columns, *MEASURES))
    return _summed(moved, by).filter(F.col("speeches") != 0)


def session_scores(cells: DataFrame, session: str = "session_name") -> DataFrame:
    """Scores of each session with its first and last date."""
    return with_scores(_summed(cells, [session], F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")))


def group_scores(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores by some of the columns of ``totals``."""
    return with_scores(_summed(sums, by))
