"""Registered queries over the test tables, each with its check in SQL where SQL can express it."""

from __future__ import annotations

from .registry import ENTRIES, Entry


def all_entries() -> dict[str, Entry]:
    from . import fleet_queries, learning_queries, model_queries, survival_queries  # noqa: F401

    return dict(ENTRIES)
