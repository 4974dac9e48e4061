"""Corrections on top of inferred columns: reviewed aggregation kinds and user overrides."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from gridscope.functions.clean import kind_of
from gridscope.functions.names import default_label
from gridscope.operators.profile import (
    Profile, date_pass, distinct_counts, first_pass, measure_stats, top_values,
)

AGG_KINDS = ("sum", "average")
PLAIN_TYPES = ("identifier", "free_text", "boolean")


def merge_overrides(*rounds: Mapping[str, Mapping[str, Any]]) -> dict[str, Mapping[str, Any]]:
    """Overrides of several rounds; the last word on a column wins."""
    merged: dict[str, Mapping[str, Any]] = {}
    for one in rounds:
        merged.update(one)
    return merged


def apply_review(prof: Profile, reviewed: Mapping[str, Mapping[str, Any]]) -> Profile:
    """Take a reviewer's ``agg_kind`` for measures; anything but sum/average is ignored."""
    columns = {}
    for c, info in prof.columns.items():
        kind = reviewed.get(c, {}).get("agg_kind")
        if info["type"] == "numeric_measure" and kind in AGG_KINDS:
            info = {**info, "agg_kind": kind}
        columns[c] = info
    return Profile(prof.df, prof.n_rows, columns, prof.counts, prof.exact)


def labels_for(prof: Profile, reviewed: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, str]:
    """Reviewed label where given, else one made from the column name."""
    reviewed = reviewed or {}
    return {c: reviewed.get(c, {}).get("label") or default_label(c) for c in prof.columns}


def apply_overrides(
    prof: Profile, overrides: Mapping[str, Mapping[str, Any]]
) -> Profile:
    """Retype columns as the user says, recomputing only what the new types need.

    Unknown columns and types are ignored. A forced measure or date without any readable
    value becomes categorical with a note.
    """
    df = prof.df
    physical = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    wanted = {
        c: o["type"] for c, o in overrides.items()
        if c in prof.columns and physical[c] != "other"
        and o.get("type") in ("numeric_measure", "date", "categorical", *PLAIN_TYPES)
    }
    empty = [c for c in wanted if prof.counts[c] == 0]
    alive = [c for c in wanted if prof.counts[c] > 0]
    measures = [c for c in alive if wanted[c] == "numeric_measure"]
    dates = [c for c in alive if wanted[c] == "date"]

    basics = first_pass(df, measures) if measures else {}
    found_dates = date_pass(df, dates)
    bad_measures = [c for c in measures if basics[c]["n_num"] == 0]
    bad_dates = [c for c in dates if found_dates[c]["n_date"] == 0]
    stats = measure_stats(df, [c for c in measures if c not in bad_measures], basics)
    tops = top_values(df, [c for c in alive if wanted[c] == "categorical"] + bad_measures + bad_dates)
    uncounted = [c for c in alive if prof.columns[c].get("cardinality") is None]
    distincts = distinct_counts(df, uncounted)

    columns = dict(prof.columns)
    for c in empty:
        columns[c] = {
            "type": "empty", "cardinality": 0, "null_fraction": 1.0, "type_confidence": 1.0, "user_corrected": True,
        }
    for c in alive:
        before = prof.columns[c]
        info: dict[str, Any] = {
            "type": wanted[c],
            "cardinality": distincts.get(c, before.get("cardinality")),
            "null_fraction": round(1 - prof.counts[c] / prof.n_rows, 3),
            "type_confidence": 1.0,
            "user_corrected": True,
        }
        if c in stats:
            kind = overrides[c].get("agg_kind")
            info.update(
                agg_kind=kind if kind in AGG_KINDS else "sum", agg_kind_confident=True, agg_kind_confidence=1.0,
                **stats[c],
            )
        elif c in bad_measures:
            info.update(type="categorical", top_values=tops[c], correction_note=(
                f"No value of '{c}' could be read as a number, so it is kept as a category."
            ))
        elif c in bad_dates:
            info.update(type="categorical", top_values=tops[c], correction_note=(
                f"No value of '{c}' could be read as a date, so it is kept as a category."
            ))
        elif wanted[c] == "date":
            info.update(min_date=str(found_dates[c]["min_date"]), max_date=str(found_dates[c]["max_date"]))
        elif wanted[c] == "categorical":
            info["top_values"] = tops[c]
        columns[c] = info
    return Profile(df, prof.n_rows, columns, prof.counts, prof.exact)
