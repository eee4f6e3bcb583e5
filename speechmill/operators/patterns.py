"""How groups speak: marks, sentences, repetitions and lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.expr import let
from speechmill.functions.text import conversation_clean, count_of, repeated_words, sentences


def speech_patterns(text: Column, fillers: Sequence[str] = values.FILLER_WORDS) -> Column:
    """STRUCT of the pattern counts of one speech.

    Repeated words are counted on the text cleaned once more, as cleaning is not idempotent.
    """

    def measured(t: Column) -> Column:
        return let(
            sentences(t),
            lambda s: F.struct(
                count_of(t, "?").alias("questions"),
                count_of(t, "!").alias("exclamations"),
                F.size(s).alias("sentences"),
                F.size(F.filter(s, lambda x: F.length(x) > 30)).alias("long_sentences"),
                F.size(F.filter(s, lambda x: F.length(x) <= 10)).alias("short_sentences"),
                repeated_words(conversation_clean(t, fillers)).alias("repeated_words"),
                F.size(F.filter(F.split(t, " "), lambda w: w != "")).alias("words"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), measured)


SUMS = ("questions", "exclamations", "sentences", "long_sentences", "short_sentences", "repeated_words")


def pattern_profile(df: DataFrame, by: Sequence[str], patterns: str = "patterns", at_least: int = 0) -> DataFrame:
    """Sums per group, the mean length in words and the ratios; a zero denominator gives 0."""
    out = (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("speeches"),
            *[F.sum(f"{patterns}.{name}").alias(name) for name in SUMS],
            F.avg(f"{patterns}.words").alias("mean_words"),
        )
        .filter(F.col("speeches") >= at_least)
    )

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    return out.select(
        "*",
        ratio("sentences", "speeches").alias("sentences_per_speech"),
        ratio("questions", "speeches").alias("questions_per_speech"),
        ratio("long_sentences", "sentences").alias("long_share"),
    )
