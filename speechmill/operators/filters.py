"""Row filters and eligibility rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.expr import computed_if, let, text_array
from speechmill.functions.text import strip
from speechmill.operators.lexicon import Lexicon, found_keywords

KEEP = "keep"


def policy_features(
    text: Column,
    policy_words: Sequence[str] = values.POLICY_WORDS,
    procedural_words: Sequence[str] = values.PROCEDURAL_WORDS,
) -> Column:
    """What :func:`policy_reason` needs to know about a text, small enough to carry through joins."""
    # Only the text is folded; the listed words are compared as they are.
    words = Lexicon.of({"procedural": procedural_words, "policy": policy_words}, fold_case=False)
    procedural, policy = (text_array(t.keywords) for t in words.topics)
    return let(
        found_keywords(F.lower(text), words),
        lambda found: F.struct(
            text.isNull().alias("missing"),
            F.arrays_overlap(found, procedural).alias("procedural"),
            F.length(F.lower(text)).alias("length"),
            F.size(F.filter(policy, lambda k: F.array_contains(found, k))).alias("policy_words"),
        ),
    )


def policy_reason(
    features: Column, position: Column, chair: str = values.CHAIR, min_length: int = 50, min_words: int = 2
) -> Column:
    """Why a speech is left out of the policy speeches, or ``keep``. The first reason wins."""
    is_chair = F.contains(F.lower(F.coalesce(position, F.lit(""))), F.lit(chair))
    return (
        F.when(features["missing"], "null_text")
        .when(is_chair & features["procedural"], "procedural")
        .when(features["length"] < min_length, "short")
        .when(features["policy_words"] < min_words, "few_policy_words")
        .otherwise(KEEP)
    )


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Speeches per reason and their share of all speeches."""
    counted = df.groupBy(reason).agg(F.count(F.lit(1)).alias("speeches"))
    everything = F.sum("speeches").over(Window.partitionBy(F.lit(1)))
    return counted.select(reason, "speeches", (F.col("speeches") / everything * 100).alias("share_pct"))


def is_substantive(text: Column, min_length: int = 30) -> Column:
    """Not blank and long enough without outer white space."""
    return F.length(strip(F.coalesce(text, F.lit("")))) >= min_length


def cleaned_longer_than(df: DataFrame, out: str, cleaned: Column, n: int) -> DataFrame:
    """Add the cleaned text and keep the rows where it has more than ``n`` characters."""
    return computed_if(df, out, cleaned, lambda t: F.length(t) > n)


def is_named_group(group: Column, skip: Sequence[str] = (values.NO_PARTY,)) -> Column:
    return group.isNotNull() & (group != "") & ~group.isin(list(skip))


def eligible_groups(df: DataFrame, by: str, at_least: int = 10) -> DataFrame:
    """Rows of the groups that have at least ``at_least`` rows.

    One row per group comes out of the count; at run time Spark chooses how to join it.
    """
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    return df.join(sizes.select(by), by, "left_semi")


def select_groups(df: DataFrame, by: str, chosen: Sequence[str]) -> DataFrame:
    """Rows of the chosen groups; no choice means all."""
    return df.filter(F.col(by).isin(list(chosen))) if chosen else df
