"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("scores", "speeches", "words", "dialogues", "pages", "studies", "upkeep", "stored")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"speechmill.plans.{name}"), attribute))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
