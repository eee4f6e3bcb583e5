"""Dates, numbers, ordinals and JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechmill import values
from speechmill.functions.expr import lookup
from speechmill.functions.text import strip


def korean_date(text: Column) -> Column:
    """DATE from a text such as ``2024년 6월 13일(목)``; null when absent or impossible."""
    parts = [F.regexp_extract(text, values.KOREAN_DATE, g) for g in (1, 2, 3)]
    return F.concat_ws("-", *parts).try_cast("date")


def any_date(text: Column, formats: tuple[str, ...] = ("yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd")) -> Column:
    """DATE from ISO text or one of ``formats``; null when none fits."""
    return F.coalesce(text.try_cast("date"), *[F.try_to_date(text, f) for f in formats])


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def session_number(name: Column) -> Column:
    return F.regexp_extract(name, values.SESSION_NAME, 1).try_cast("int")


def number(text: Column) -> Column:
    """Number from text such as ``40%`` or ``6.5``; 0 when there is none."""
    return F.coalesce(F.replace(strip(text), F.lit("%"), F.lit("")).try_cast("double"), F.lit(0.0))


def importance(label: Column) -> Column:
    return lookup(label, values.IMPORTANCE, 2)


def stance(label: Column) -> Column:
    return lookup(label, values.STANCE, 0)


def parsed(json: Column, schema: str) -> Column:
    """JSON text as a struct; malformed text gives a struct of nulls."""
    return F.from_json(F.coalesce(json, F.lit("{}")), schema, {"mode": "PERMISSIVE"})


def list_or_empty(items: Column, element: str = "string") -> Column:
    return F.coalesce(items, F.array().cast(f"array<{element}>"))


def natural_key(*parts: Column) -> Column:
    """Deterministic row key, so that a repeated task writes the same row."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)
