"""Cleaning, tokenising and counting on text columns.

Patterns spell out Unicode classes instead of using the shorthand word class, because the
shorthand is ASCII-only by default and would delete Hangul and accented letters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.expr import let

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def squeeze(text: Column) -> Column:
    """Every run of white space, no-break spaces included, becomes one blank."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def plain_clean(text: Column) -> Column:
    """Keep word characters only, separated by single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{NOT_WORD}+", " "))


def escape_word(word: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", word)


def conversation_clean(text: Column, fillers: Sequence[str] = values.FILLER_WORDS) -> Column:
    """Delete fillers wherever they occur, keep words and sentence marks, drop short words.

    Fillers are deleted as substrings together with the blanks after them, so they also vanish
    inside longer words. Words of one or two characters are dropped last.
    """
    out = F.coalesce(text, F.lit(""))
    if fillers:
        out = F.regexp_replace(out, f"({'|'.join(escape_word(w) for w in fillers)}){SPACE}*", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_.!?]+", " ")
    return F.array_join(F.filter(F.split(out, " "), lambda w: F.length(w) > 2), " ")


def remove_phrases(text: Column, patterns: Sequence[str] = values.PROCEDURAL_PATTERNS) -> Column:
    """Delete each pattern in turn; ``.`` stops at a line feed only."""
    out = F.coalesce(text, F.lit(""))
    for pattern in patterns:
        out = F.regexp_replace(out, f"(?d){pattern}", "")
    return strip(out)


def preview(text: Column, limit: int, marker: str = "") -> Column:
    """First ``limit`` characters, with ``marker`` behind when something was cut."""
    cut = F.substring(text, 1, limit)
    if not marker:
        return cut
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(marker))).otherwise(text)


def pattern_tokens(text: Column, pattern: str = values.HANGUL_WORD) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)


def blank_tokens(text: Column, min_length: int = 3) -> Column:
    """Blank-separated words of at least ``min_length`` characters."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{SPACE}+"), lambda w: F.length(w) >= min_length)


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    # Splitting costs less than a match object for every word.
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{NOT_WORD}+"), lambda w: F.length(w) >= 2)


def one_and_two_grams(text: Column) -> Column:
    """Word tokens followed by their adjacent pairs."""

    def with_pairs(tokens: Column) -> Column:
        n = F.size(tokens)
        pairs = F.zip_with(
            F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b)
        )
        return F.when(n > 1, F.concat(tokens, pairs)).otherwise(tokens)

    return let(word_tokens(text), with_pairs)


def term_counts(tokens: Column) -> Column:
    """ARRAY<STRUCT<term, tf>> of one row's tokens.

    Sorting the row's own array and measuring the runs keeps the counting inside the row: there
    is no shuffle by document.
    """

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(s, k + 1), n) - at).alias("tf"),
                ),
            ),
        )

    return let(
        F.sort_array(F.coalesce(tokens, F.array().cast("array<string>"))),
        lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(F.array().cast("array<struct<term:string,tf:int>>")),
    )


def count_of(text: Column, mark: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(escape_word(mark)))


def sentences(text: Column, longer_than: int = 5) -> Column:
    """Stripped pieces between sentence marks, the short ones dropped."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?]"), strip)
    return F.filter(pieces, lambda s: F.length(s) > longer_than)


def repeated_words(text: Column, times: int = 3) -> Column:
    """Number of words that occur at least ``times`` times in the row's text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")
    return F.size(F.filter(term_counts(words), lambda t: t["tf"] >= times))


#: Decimal, hexadecimal and named references.
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,31});"
#: Characters of named references: the fixed table, and the names of HTML 4.
NAMED = {name: chr(point) for name, point in name2codepoint.items()} | {
    entity[1:-1]: char for entity, char in values.HTML_ENTITIES.items() if not entity.startswith("&#")
}


def _character(reference: Column) -> Column:
    """The character that a reference (without ``&`` and ``;``) stands for, null if there is none."""
    digits = F.regexp_extract(reference, "^#[xX]?([0-9a-fA-F]+)$", 1)
    number = F.when(F.lower(F.substring(reference, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    coded = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0)), 8, "0")), "UTF-32")
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    return F.when(F.startswith(reference, F.lit("#")), F.when(valid, coded)).otherwise(F.try_element_at(named, reference))


def unescape(text: Column) -> Column:
    """Character references decoded in one scan, so nothing is decoded twice; unknown ones stay.

    The fixed table goes first, then the names of HTML 4; a no-break space becomes a blank.
    """
    between = F.split(text, REFERENCE, -1)
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    decoded = F.zip_with(between, found, lambda part, r: F.concat(part, F.coalesce(F.replace(_character(r), F.lit("\u00a0"), F.lit(" ")), F.concat(F.lit("&"), r, F.lit(";")), F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def markup_text(markup: Column, breaks: bool = False) -> Column:
    """Text of a piece of markup.

    With ``breaks`` a line-break tag becomes a line feed and blank lines collapse; without it all
    white space collapses to single blanks.
    """
    out = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    if breaks:
        out = F.regexp_replace(out, r"(?i)<br\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    out = unescape(out)
    if not breaks:
        return squeeze(out)
    out = F.replace(out, F.lit(" "), F.lit(" "))
    out = F.regexp_replace(out, rf"\n{SPACE}*\n+", "\n")
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def path_safe(key: Column) -> Column:
    """Separators become underscores, other forbidden characters vanish."""
    return strip(F.translate(key, '/\\:?*"<>|', "___"))
