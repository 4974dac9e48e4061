"""A structured query: filters, then one aggregate, a grouped aggregate, or a look-up."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from gridscope.errors import TableError
from gridscope.functions.clean import kind_of, number_of, quoted, value_of
from gridscope.operators.filters import OPERATORS, where_all
from gridscope.operators.profile import Profile
from gridscope.sources.records import inferred_types

OPERATIONS = ("sum", "average", "count", "min", "max")
LOOKUP_ROWS = 5
EXPOSED_TYPES = ("numeric_measure", "categorical", "free_text", "date", "boolean", "identifier")


def exposed_columns(prof: Profile) -> list[str]:
    """Columns a question may name: all but constant and empty ones."""
    return prof.of_type(*EXPOSED_TYPES)


def validate_spec(spec: Mapping[str, Any], columns: list[str]) -> None:
    """Every named column must exist and every operation be known."""
    if spec.get("operation") not in OPERATIONS:
        raise TableError(f"Unknown operation: {spec.get('operation')}", "UNKNOWN_OPERATION")
    named = [spec.get("target_column"), spec.get("group_by"), *(spec.get("return_columns") or [])]
    for c in named:
        if c and c not in columns:
            raise TableError(f"Unknown column: {c}", "UNKNOWN_COLUMN")
    for f in spec.get("filters") or []:
        if f.get("column") not in columns:
            raise TableError(f"Unknown column in a filter: {f.get('column')}", "UNKNOWN_COLUMN")
        if f.get("operator") not in OPERATORS:
            raise TableError(f"Unknown operator: {f.get('operator')}", "UNKNOWN_OPERATOR")


@dataclass
class Answer:
    """``kind`` is single, grouped or lookup.

    ``result`` holds ``value, matched_rows`` / ``group, value, n`` / the found records.
    ``counts`` is one row with ``matched_rows``; for look-ups also ``total_matching`` and
    ``truncated``.
    """

    kind: str
    result: DataFrame
    counts: DataFrame


def _target(df: DataFrame, column: str | None) -> Column:
    """Target as a number; day numbers are not used, so sums over dates are NULL."""
    if not column:
        return F.lit(None).cast("double")
    return number_of(column, df.schema[column].dataType)


def _aggregate(df: DataFrame, operation: str, column: str | None) -> Column:
    """Plain aggregate: ``count`` counts rows, the others skip unreadable targets.

    ``min`` and ``max`` of a date column give its first and last day.
    """
    if operation == "count":
        return F.count("*")
    if column and operation in ("min", "max") and kind_of(df.schema[column].dataType) == "date":
        day = F.to_date(F.col(quoted(column)))
        return (F.min(day) if operation == "min" else F.max(day)).cast("string")
    value = _target(df, column)
    return {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}[operation](value)


def run_spec(df: DataFrame | Profile, spec: Mapping[str, Any], tie_break: list[str] | None = None) -> Answer:
    """Validate ``spec`` and turn it into a plan over ``df``.

    Given a profile, its table is queried by the inferred types: text that holds dates or
    amounts is filtered, aggregated and shown as days and numbers. ``tie_break`` orders
    records with equal extremes; by default all returned columns do.
    """
    df = inferred_types(df) if isinstance(df, Profile) else df
    validate_spec(spec, df.columns)
    rows = where_all(df, spec.get("filters") or [])
    operation, target, group = spec["operation"], spec.get("target_column"), spec.get("group_by")
    matched = rows.agg(F.count("*").alias("matched_rows"))

    if spec.get("return_columns") and operation in ("min", "max") and not group:
        return _lookup(rows, operation, target, spec["return_columns"], tie_break)
    if group:
        key = value_of(group, df.schema[group].dataType)
        result = (
            rows.where(key.isNotNull()).groupBy(key.alias("group"))
            .agg(_aggregate(rows, operation, target).alias("value"), F.count("*").alias("n"))
        )
        return Answer("grouped", result, matched)
    result = rows.agg(_aggregate(rows, operation, target).alias("value"), F.count("*").alias("matched_rows"))
    return Answer("single", result, matched)


def _lookup(
    rows: DataFrame, operation: str, target: str | None, columns: list[str], tie_break: list[str] | None
) -> Answer:
    """The records holding the extreme, found with one scalar aggregate and one filter."""
    by_day = target and kind_of(rows.schema[target].dataType) == "date"
    value = F.to_date(F.col(quoted(target))) if by_day else _target(rows, target)
    extreme = rows.agg((F.max(value) if operation == "max" else F.min(value)).alias("x"))
    holders = rows.where(value == extreme.scalar())
    shown = list(dict.fromkeys(c for c in [target, *columns] if c))
    order = [quoted(c) for c in (tie_break or shown)]
    result = holders.orderBy(*order).limit(LOOKUP_ROWS).select(*[quoted(c) for c in shown])
    found = holders.agg(F.count("*").alias("n"))
    counts = rows.agg(F.count("*").alias("matched_rows")).select(
        "matched_rows", found.scalar().alias("total_matching"), (found.scalar() > LOOKUP_ROWS).alias("truncated")
    )
    return Answer("lookup", result, counts)
