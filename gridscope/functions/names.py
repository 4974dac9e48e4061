"""What a column's *name* says about it.

Names are metadata, so they are looked at in Python. A word counts only when it stands
alone between characters that are neither ASCII letters nor digits, so ``stop_id`` holds
``id`` but ``Operating`` does not hold ``rating``.
"""

from __future__ import annotations

import re

# Words that mark identifiers, averages, totals and storage sizes.
IDENTIFIER_WORDS = frozenset({"id", "key", "no", "number", "code", "footnote", "flag"})
AVERAGE_WORDS = frozenset({
    "rating", "score", "percent", "rate", "ratio", "index", "avg", "average",
    "satisfaction", "grade", "star", "stars", "gpa", "margin", "per",
})
TOTAL_WORDS = frozenset({
    "total", "amount", "revenue", "sales", "price", "cost", "expense", "quantity", "qty",
    "unit", "units", "count", "volume", "spend", "profit",
})
SIZE_WORDS = frozenset({"size", "storage", "memory", "capacity", "filesize", "disk", "ram"})


def words_of(name: str) -> set[str]:
    """Lower-case ASCII words of a column name."""
    return {w.lower() for w in re.findall(r"[A-Za-z0-9]+", name)}


def names_identifier(name: str) -> bool:
    return not IDENTIFIER_WORDS.isdisjoint(words_of(name))


def names_size(name: str) -> bool:
    """True where K and M would mean kilobyte and megabyte."""
    return not SIZE_WORDS.isdisjoint(words_of(name))


def agg_kind_of(name: str) -> tuple[str, bool, float]:
    """``(kind, confident, confidence)``; average words win over total words."""
    words = words_of(name)
    if not AVERAGE_WORDS.isdisjoint(words):
        return "average", True, 0.9
    if not TOTAL_WORDS.isdisjoint(words):
        return "sum", True, 0.9
    return "sum", False, 0.5


def default_label(name: str) -> str:
    """Display label: separators become spaces, words are capitalised."""
    return re.sub(r"[_-]", " ", name).title()
