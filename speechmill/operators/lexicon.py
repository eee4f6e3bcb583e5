"""Scoring text against keyword lexicons.

A keyword counts when it is contained in the text, once per text however often it occurs; a
keyword listed twice counts twice. The counts become one small array column per text, so the text
itself never has to travel through a later join or aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.expr import let, text_array, unnest
from speechmill.functions.text import preview

LEXICON_SCHEMA = "lexicon_id string, topic string, topic_ord int, keywords array<string>, weight double"


@dataclass(frozen=True)
class Topic:
    name: str
    keywords: tuple[str, ...]
    weight: float = 1.0


@dataclass(frozen=True)
class Lexicon:
    """Ordered topics; the order decides ties."""

    topics: tuple[Topic, ...]
    fold_case: bool = True

    @classmethod
    def of(cls, table: Mapping, weights: Mapping[str, float] | None = None, fold_case: bool = True) -> Lexicon:
        """From ``{topic: [keywords]}`` or ``{topic: {"keywords": [...], "weight": 1.0}}``."""
        topics = []
        for name, entry in table.items():
            words, weight = entry, 1.0
            if isinstance(entry, Mapping):
                words, weight = entry["keywords"], float(entry.get("weight", 1.0))
            if weights:
                weight = float(weights.get(name, weight))
            topics.append(Topic(name, tuple(w for w in words if w), weight))
        return cls(tuple(topics), fold_case)

    @classmethod
    def from_table(cls, df: DataFrame, lexicon_id: str, max_topics: int = 10_000, fold_case: bool = True) -> Lexicon:
        """Read one lexicon out of a lexicon table; it is configuration, so its size is checked."""
        rows = df.filter(F.col("lexicon_id") == lexicon_id).orderBy("topic_ord").limit(max_topics + 1).collect()
        if len(rows) > max_topics:
            raise ValueError(f"lexicon {lexicon_id!r} has more than {max_topics} topics")
        return cls(tuple(Topic(r["topic"], tuple(r["keywords"]), r["weight"]) for r in rows), fold_case)

    def to_table(self, spark: SparkSession, lexicon_id: str) -> DataFrame:
        rows = [(lexicon_id, t.name, i, list(t.keywords), t.weight) for i, t in enumerate(self.topics)]
        return spark.createDataFrame(rows, LEXICON_SCHEMA)

    def deduplicated(self) -> Lexicon:
        return replace(self, topics=tuple(replace(t, keywords=tuple(dict.fromkeys(t.keywords))) for t in self.topics))

    @property
    def names(self) -> list[str]:
        return [t.name for t in self.topics]

    def folded(self, word: str) -> str:
        return word.lower() if self.fold_case else word

    def vocabulary(self) -> list[str]:
        return list(dict.fromkeys(self.folded(k) for t in self.topics for k in t.keywords))

    def column(self) -> Column:
        """ARRAY<STRUCT<topic, topic_ord, weight, keywords, folded>> literal."""
        return F.array(
            *[
                F.struct(
                    F.lit(t.name).alias("topic"),
                    F.lit(i).alias("topic_ord"),
                    F.lit(t.weight).alias("weight"),
                    text_array(t.keywords).alias("keywords"),
                    text_array(self.folded(k) for k in t.keywords).alias("folded"),
                )
                for i, t in enumerate(self.topics)
            ]
        )


def found_keywords(text: Column, lexicon: Lexicon) -> Column:
    """Distinct lexicon keywords contained in the text, in folded spelling.

    Every keyword is tested inside the JVM, whatever the number of keywords.
    """
    source = F.coalesce(text, F.lit(""))
    if lexicon.fold_case:
        source = F.lower(source)
    return let(source, lambda t: F.filter(text_array(lexicon.vocabulary()), lambda k: F.contains(t, k)))


def topic_counts(text: Column, lexicon: Lexicon) -> Column:
    """ARRAY<INT>: listed keywords contained in the text, per topic in lexicon order."""
    return let(
        found_keywords(text, lexicon),
        lambda found: F.transform(
            lexicon.column(), lambda t: F.size(F.filter(t["folded"], lambda k: F.array_contains(found, k)))
        ),
    )


def topic_matches(text: Column, lexicon: Lexicon) -> Column:
    """ARRAY<STRUCT<topic, topic_ord, matched>> of the topics with at least one hit."""

    def per_topic(found: Column) -> Column:
        hits = F.transform(
            lexicon.column(),
            lambda t: F.struct(
                t["topic"].alias("topic"),
                t["topic_ord"].alias("topic_ord"),
                F.transform(
                    F.filter(F.arrays_zip(t["keywords"], t["folded"]), lambda z: F.array_contains(found, z["folded"])),
                    lambda z: z["keywords"],
                ).alias("matched"),
            ),
        )
        return F.filter(hits, lambda h: F.size(h["matched"]) > 0)

    return let(found_keywords(text, lexicon), per_topic)


def dominant_topic(counts: Column, lexicon: Lexicon, default: str = values.OTHER_AREA) -> Column:
    """Topic with the highest weighted count; the earlier topic wins a tie."""
    weights = F.array(*[F.lit(t.weight) for t in lexicon.topics])
    ranked = F.transform(counts, lambda n, i: F.struct((n * F.get(weights, i)).alias("score"), (-i).alias("order")))
    return let(
        F.array_max(ranked),
        lambda best: F.when(best["score"] > 0, F.get(text_array(lexicon.names), -best["order"])).otherwise(
            F.lit(default)
        ),
    )


#: Above this, two aggregates a topic make code that is too long to compile.
MANY_TOPICS = 100


def topic_measures(lexicon: Lexicon, counts: str = "topic_counts") -> list[Column]:
    """Additive measures per topic: hits, and speeches with a hit."""
    n = [F.get(F.col(counts), F.lit(i)) for i in range(len(lexicon.topics))]
    return [F.sum(c).alias(f"_h{i}") for i, c in enumerate(n)] + [
        F.sum((c > 0).cast("int")).alias(f"_c{i}") for i, c in enumerate(n)
    ]


def topic_columns(lexicon: Lexicon) -> Column:
    """The measures of :func:`topic_measures` turned into one row per topic."""
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(t.name).alias("topic"),
                    F.lit(i).alias("topic_ord"),
                    F.lit(t.weight).alias("weight"),
                    F.col(f"_h{i}").alias("hits"),
                    F.col(f"_c{i}").alias("covered"),
                )
                for i, t in enumerate(lexicon.topics)
            ]
        )
    )


def topic_cells(df: DataFrame, lexicon: Lexicon, by: Sequence[str], counts: str = "topic_counts") -> DataFrame:
    """One row per group and topic with the additive measures ``speeches, hits, covered``.

    Each speech enters the aggregation as one row whose measures are the elements of its count
    array, and the topics are unpivoted only after the groups have been reduced. With more than
    ``MANY_TOPICS`` topics the measures are rows instead of columns, with equal results.
    """
    if len(lexicon.topics) > MANY_TOPICS:
        return _many_topic_cells(df, lexicon, by, counts)
    reduced = df.groupBy(*by).agg(F.count(F.lit(1)).alias("speeches"), *topic_measures(lexicon, counts))
    return reduced.select(*by, "speeches", topic_columns(lexicon))


def _many_topic_cells(df: DataFrame, lexicon: Lexicon, by: Sequence[str], counts: str) -> DataFrame:
    """The cells by (group, topic) from the topics a speech hits; a topic-less entry of each speech counts the speeches.

    A group's sums meet in one map, which is no longer than the lexicon; topics it lacks are 0.
    """
    found = F.filter(F.transform(counts, lambda n, i: F.struct(i.alias("_ord"), n.cast("long").alias("_n"))), lambda x: x["_n"] > 0)
    speech = F.array(F.struct(F.lit(None).cast("int").alias("_ord"), F.lit(0).cast("long").alias("_n")))
    entries = df.select(*by, F.inline(F.concat(speech, F.coalesce(found, F.array().cast("array<struct<_ord:int,_n:bigint>>")))))
    sums = entries.groupBy(*by, "_ord").agg(F.sum("_n").alias("hits"), F.count(F.lit(1)).alias("covered"))
    hit = F.when(F.col("_ord").isNotNull(), F.struct("_ord", F.struct("hits", "covered")))
    grouped = sums.groupBy(*by).agg(
        F.max(F.when(F.col("_ord").isNull(), F.col("covered"))).alias("speeches"),
        F.map_from_entries(F.collect_list(hit)).alias("_sums"),
    )
    topics = F.array(*[F.struct(F.lit(t.name).alias("topic"), F.lit(i).alias("topic_ord"), F.lit(t.weight).alias("weight")) for i, t in enumerate(lexicon.topics)])
    rows = grouped.select(*by, "speeches", "_sums", F.inline(topics))
    cell = F.try_element_at("_sums", F.col("topic_ord"))
    zero = F.lit(0).cast("long")
    return rows.select(
        *by, "speeches", "topic", "topic_ord", "weight", F.coalesce(cell["hits"], zero).alias("hits"), F.coalesce(cell["covered"], zero).alias("covered")
    )


def with_scores(cells: DataFrame) -> DataFrame:
    """``score`` counts hits per speech; ``coverage_pct`` speeches with a hit; ``hits_per_100`` hits."""
    return cells.select(
        "*",
        (F.col("hits") * F.col("weight") / F.col("speeches")).alias("score"),
        (F.col("covered") / F.col("speeches") * 100).alias("coverage_pct"),
        (F.col("hits") / F.col("speeches") * 100).alias("hits_per_100"),
    )


def topic_scores(df: DataFrame, lexicon: Lexicon, by: Sequence[str], counts: str = "topic_counts") -> DataFrame:
    return with_scores(topic_cells(df, lexicon, by, counts))


def topic_examples(
    df: DataFrame, group: str, order: Sequence[str], carry: Sequence[str], top: DataFrame | None = None, n: int = 3
) -> DataFrame:
    """First ``n`` matching speeches of each group and topic.

    ``df`` has a ``matches`` column from :func:`topic_matches`. The rank filter is applied per
    task before the shuffle, so a group that holds most of the table sends ``n`` rows per task and
    topic only. ``top`` (group, topic) keeps those pairs and is joined to what is left.
    """
    rows = unnest(df, [group, *dict.fromkeys([*order, *carry])], F.col("matches"))
    window = Window.partitionBy(group, "topic").orderBy(*order)
    first = rows.withColumn("example", F.row_number().over(window)).filter(F.col("example") <= n)
    if top is None:
        return first
    return first.join(top.select(group, "topic"), [group, "topic"], "left_semi")


def example_preview(text: Column) -> Column:
    return preview(text, 100, "...")


def issue_mentions(df: DataFrame, issues: Lexicon, text: str, carry: Sequence[str]) -> DataFrame:
    """One row per speech and issue for which any keyword is contained; case is significant."""
    lexicon = replace(issues, fold_case=False)
    hits = topic_matches(F.col(text), lexicon)
    return unnest(df, carry, F.transform(hits, lambda h: h["topic"]), "issue")
