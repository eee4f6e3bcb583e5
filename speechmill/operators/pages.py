"""From raw pages to header and speech rows.

The markup is described by patterns, so the same job runs on any page layout. A page is one input
row; its markers are exploded and every window and group below is keyed by the page, which needs a
single exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.expr import blank_to_null, unnest, unnest_numbered
from speechmill.functions.text import markup_text, squeeze, strip


@dataclass(frozen=True)
class Markup:
    """Patterns of a page layout; group 1 is the wanted part unless said otherwise.

    The defaults are fixed values: class names and labels of the pages they were written for.
    """

    # header
    turn: str = r'(?s)<p[^>]*class="[^"]*\bturn\b[^"]*"[^>]*>(.*?)</p>'
    session: str = r"제\s*(\d+)\s*회"
    session_type: str = r"\(([^)]+)\)"
    meeting: str = r'(?s)<p[^>]*class="[^"]*\bnum\b[^"]*"[^>]*>(.*?)</p>'
    meeting_fallback: str = r"(제\s*\d+\s*[차호])"
    date: str = r'(?s)일시.*?<p[^>]*class="[^"]*\bcon\b[^"]*"[^>]*>(.*?)</p>'
    sections: tuple[tuple[str, str], ...] = (
        ("의사일정", r'(?s)의사일정.*?<ul[^>]*class="[^"]*\blist_num\b[^"]*"[^>]*>(.*?)</ul>'),
        ("상정된 안건", r'(?s)상정된 안건.*?<ul[^>]*class="[^"]*\blist_num\b[^"]*"[^>]*>(.*?)</ul>'),
    )
    list_item: str = r"(?s)<li\b[^>]*>(.*?)</li>"
    date_section: str = "일시"
    # body: opening tags of the three kinds of markers
    speaker: str = r'<div[^>]*class="[^"]*\bspeaker\b[^"]*"[^>]*>'
    bar: str = r'<p[^>]*class="[^"]*\btit_sm\b[^"]*\bangun\b[^"]*"[^>]*>'
    time: str = r'<p[^>]*class="[^"]*\btit_sm\b[^"]*\btaR\b[^"]*"[^>]*>'
    bar_text: str = r"(?s)^<p[^>]*>(.*?)</p>"
    time_text: str = r"(?s)^<p[^>]*>(.*?)</p>"
    # inside a speaker block
    member_id: str = r'^<div[^>]*\bdata[-_]mem[-_]id="([^"]*)"'
    name: str = r'(?s)<strong[^>]*class="[^"]*\bname\b[^"]*"[^>]*>(.*?)</strong>'
    name_fallback: str = r'^<div[^>]*\bdata-name="([^"]*)"'
    position: str = r'(?s)class="[^"]*\bposition\b[^"]*"[^>]*>(.*?)</'
    position_fallback: str = r'^<div[^>]*\bdata-pos="([^"]*)"'
    area: str = r'(?s)class="[^"]*\barea\b[^"]*"[^>]*>(.*?)</'
    talk: str = r'(?s)class="[^"]*\btalk\b[^"]*".*?class="[^"]*\btxt\b[^"]*"[^>]*>(.*?)</div>'


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def numbered_title(title: Column) -> tuple[Column, Column]:
    """Number and rest of ``N. title``; no number leaves the title whole."""
    pattern = r"(?s)^(\d+)\.\s*(.+)"
    number = _first(title, pattern)
    return number, F.when(number == "", title).otherwise(squeeze(_first(title, pattern, 2)))


def page_headers(pages: DataFrame, markup: Markup = Markup(), page: str = "page_id", html: str = "html") -> DataFrame:
    """Session number, type, meeting and date of every page."""
    turn = markup_text(_first(F.col(html), markup.turn))
    return pages.select(
        page,
        _first(turn, markup.session).try_cast("int").alias("session"),
        squeeze(_first(turn, markup.session_type)).alias("session_type"),
        F.coalesce(
            blank_to_null(markup_text(_first(F.col(html), markup.meeting))),
            _first(markup_text(F.col(html)), markup.meeting_fallback),
        ).alias("meeting_no"),
        markup_text(_first(F.col(html), markup.date)).alias("date"),
        html,
    )


def _listed_items(block: Column, label: str, list_item: str) -> Column:
    return F.transform(
        F.regexp_extract_all(block, F.lit(list_item), 1),
        lambda item, i: F.struct(
            F.lit(label).alias("section"),
            (i + 1).alias("item_order"),
            F.regexp_replace(markup_text(item), r"^\d+\.\s*", "").alias("item_text"),
        ),
    )


HEADER_COLUMNS = ("session", "session_type", "meeting_no", "date")


def header_rows(headers: DataFrame, markup: Markup = Markup(), page: str = "page_id", html: str = "html") -> DataFrame:
    """The date row of every page and one row per listed agenda item, numbered from 1."""
    items = F.array(
        F.struct(
            F.lit(markup.date_section).alias("section"),
            F.lit(None).cast("int").alias("item_order"),
            F.col("date").alias("item_text"),
        )
    )
    for label, pattern in markup.sections:
        items = F.concat(items, _listed_items(_first(F.col(html), pattern), label, markup.list_item))
    return unnest(headers, [page, *HEADER_COLUMNS], items)


def body_markers(pages: DataFrame, markup: Markup = Markup(), page: str = "page_id", html: str = "html") -> DataFrame:
    """One row per marker in page order, with the marker's piece of markup and running numbers.

    ``speakers_before`` numbers the stretches between speakers; ``stretch`` also breaks at agenda
    bars; ``element`` counts the elements opened before the marker.
    """
    cut = f"(?=(?:{markup.speaker})|(?:{markup.bar})|(?:{markup.time}))"
    pieces = unnest_numbered(pages, [page], F.split(html, cut), "pos", "piece")
    kind = (
        F.when(F.col("piece").rlike(f"^(?:{markup.speaker})"), "speaker")
        .when(F.col("piece").rlike(f"^(?:{markup.bar})"), "bar")
        .when(F.col("piece").rlike(f"^(?:{markup.time})"), "time")
        .otherwise("none")
    )
    before = Window.partitionBy(page).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(page).orderBy("pos")
    return (
        pieces.withColumn("kind", kind)
        .withColumn("opened", F.regexp_count("piece", F.lit("<[A-Za-z]")))
        .withColumn("element", F.coalesce(F.sum("opened").over(before), F.lit(0)))
        .withColumn("speakers_before", F.coalesce(F.count_if(F.col("kind") == "speaker").over(before), F.lit(0)))
        .withColumn("stretch", F.count_if(F.col("kind").isin("speaker", "bar")).over(upto))
        .filter(F.col("kind") != "none")
    )


AGENDA_COLUMNS = ("agenda_item_orders", "agenda_item_titles", "agenda_item_times")


def _stretches(markers: DataFrame, markup: Markup, page: str, reach: int) -> DataFrame:
    """One row per stretch between speakers: its agenda bars, joined, and the speaker ending it.

    A bar's time is the first time mark among the ``reach`` elements after it and before the next
    bar or speaker. Bars without a speech between them are in the same stretch.
    """
    ahead = Window.partitionBy(page, "stretch").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    next_time = F.first(F.when(F.col("kind") == "time", F.struct("element", "piece")), ignorenulls=True).over(ahead)
    number, title = numbered_title(markup_text(_first(F.col("piece"), markup.bar_text)))
    time = F.when(
        F.col("_next_time.element") - F.col("element") <= reach,
        markup_text(_first(F.col("_next_time.piece"), markup.time_text)),
    ).otherwise("")
    bar = F.struct("pos", number.alias("number"), title.alias("title"), time.alias("time"))

    def joined(field: str, sep: str) -> Column:
        return F.array_join(F.filter(F.transform("_bars", lambda b: b[field]), lambda x: x != ""), sep)

    return (
        markers.withColumn("_next_time", next_time)
        .groupBy(page, "speakers_before")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("kind") == "bar", bar))).alias("_bars"),
            F.max(F.when(F.col("kind") == "speaker", F.col("piece"))).alias("piece"),
        )
        .select(
            page,
            (F.col("speakers_before") + 1).alias("speech_order"),
            "piece",
            F.when(
                F.size("_bars") > 0,
                F.struct(
                    joined("number", ",").alias("agenda_item_orders"),
                    joined("title", " / ").alias("agenda_item_titles"),
                    joined("time", " / ").alias("agenda_item_times"),
                ),
            ).alias("_agenda"),
        )
        .filter(F.col("piece").isNotNull())
    )


def agenda_groups(
    pages: DataFrame, markup: Markup = Markup(), page: str = "page_id", html: str = "html", reach: int = 12
) -> DataFrame:
    """Joined agenda bars and the speech they start at; groups after the last speech are dropped."""
    return (
        _stretches(body_markers(pages, markup, page, html), markup, page, reach)
        .filter(F.col("_agenda").isNotNull())
        .select(page, F.col("speech_order").alias("start_order"), "_agenda.*")
    )


def speech_rows(
    pages: DataFrame, markup: Markup = Markup(), page: str = "page_id", html: str = "html", reach: int = 12
) -> DataFrame:
    """One row per speaker block with its order, speaker fields, text and the agenda in force."""
    so_far = Window.partitionBy(page).orderBy("speech_order")
    blocks = _stretches(body_markers(pages, markup, page, html), markup, page, reach).withColumn(
        "_agenda", F.last("_agenda", ignorenulls=True).over(so_far)
    )
    piece = F.col("piece")

    def either(first: str, fallback: str) -> Column:
        return F.coalesce(blank_to_null(markup_text(_first(piece, first))), squeeze(_first(piece, fallback)))

    return blocks.select(
        page,
        "speech_order",
        either(markup.name, markup.name_fallback).alias("speaker_name"),
        either(markup.position, markup.position_fallback).alias("speaker_position"),
        markup_text(_first(piece, markup.area)).alias("speaker_area"),
        _first(piece, markup.member_id).alias("data_mem_id"),
        markup_text(_first(piece, markup.talk), breaks=True).alias("speech_text"),
        *[F.coalesce(F.col(f"_agenda.{c}"), F.lit("")).alias(c) for c in AGENDA_COLUMNS],
    )


def page_keys(headers: DataFrame, bodies: DataFrame, page: str = "page_id") -> DataFrame:
    """Session and meeting of a page from whichever parse gave them, else ``unknown``."""
    a = headers.select(page, F.col("session").alias("_s1"), F.col("meeting_no").alias("_m1"))
    b = bodies.select(page, F.col("session").alias("_s2"), F.col("meeting_no").alias("_m2"))
    unknown = F.lit(values.UNKNOWN)
    return a.join(b, page, "full_outer").select(
        page,
        F.coalesce(F.col("_s1").cast("string"), F.col("_s2").cast("string"), unknown).alias("session"),
        F.coalesce(blank_to_null(strip("_m1")), blank_to_null(strip("_m2")), unknown).alias("meeting_no"),
    )
