"""Row filters as predicates that Catalyst can push to the scan.

A null cell never matches, whatever the operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from datetime import date, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from gridscope.errors import TableError
from gridscope.functions.clean import FALSE_WORDS, TRUE_WORDS, kind_of, plain_number, quoted, truth_of

ORDERED = (">", "<", ">=", "<=")
OPERATORS = ("==", "!=", *ORDERED)


def _truth(value: Any) -> bool | None:
    word = str(value).strip().lower()
    return True if word in TRUE_WORDS else False if word in FALSE_WORDS else None


def _number(value: Any) -> float | None:
    if isinstance(value, bool):
        return float(value)
    try:
        return float(str(value).strip() or 0)
    except ValueError:
        return None


def _text(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def _compare(left: Column, op: str, right: Any) -> Column:
    if op == "==":
        return left == right
    if op == "!=":
        return left != right
    if op == ">":
        return left > right
    if op == "<":
        return left < right
    return left >= right if op == ">=" else left <= right


def _day_filter(cell: Column, op: str, day: date) -> Column:
    """Comparison of the day of a date or timestamp, as bounds on the column itself."""
    start, end = F.lit(day), F.lit(day + timedelta(days=1))
    if op == "==":
        return (cell >= start) & (cell < end)
    if op == "!=":
        return (cell < start) | (cell >= end)
    if op in (">", "<="):
        return _compare(cell, ">=" if op == ">" else "<", end)
    return _compare(cell, op, start)


def _number_filter(cell: Column, op: str, target: Any) -> Column:
    truth, number = _truth(target), _number(target)
    if number is not None and number.is_integer() and abs(number) < 2**53:
        number = int(number)  # comparisons of whole-number columns then reach the scan
    if op in ORDERED:
        if number is None:
            return _compare(cell.cast("string"), op, _text(target))
        return _compare(cell, op, number)
    if truth is not None:
        equal = cell == (1 if truth else 0)
    elif number is not None:
        equal = cell == number
    else:
        equal = F.lit(False)
    return equal if op == "==" else ~equal


def _text_filter(cell: Column, op: str, target: Any) -> Column:
    number, truth = _number(target), _truth(target)
    if op in ORDERED:
        as_text = _compare(cell, op, _text(target))
        if number is None or isinstance(target, bool):
            return as_text
        return F.coalesce(_compare(plain_number(cell), op, number), as_text)
    if isinstance(target, (int, float)) and not isinstance(target, bool):
        equal = F.coalesce(plain_number(cell) == float(target), F.lit(False))
    else:
        equal = F.lower(cell) == _text(target).lower()
    if truth is not None:
        equal = F.coalesce(truth_of(cell) == F.lit(truth), equal)
    return equal if op == "==" else ~equal


def matches(df: DataFrame, column: str, operator: str, value: Any) -> Column:
    """Predicate for one filter on column ``column`` of ``df``.

    ``==`` and ``!=`` compare yes-no words as truth values when both sides are such words,
    else numbers with a numeric target, else text without regard to case. Ordered operators
    compare numbers when both sides are numbers, days on date columns, else text.
    """
    if operator not in OPERATORS:
        raise TableError(f"Unknown operator: {operator}", "UNKNOWN_OPERATOR")
    if column not in df.columns:
        raise TableError(f"Unknown column in a filter: {column}", "UNKNOWN_COLUMN")
    if value is None:
        return F.lit(False)
    dtype = df.schema[column].dataType
    cell, kind = F.col(quoted(column)), kind_of(dtype)
    if kind == "number":
        test = _number_filter(cell, operator, value)
    elif kind == "date" and re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(value)):
        test = _day_filter(cell, operator, date.fromisoformat(str(value)))
    elif kind == "date":
        test = _text_filter(F.to_date(cell).cast("string"), operator, value)
    elif kind == "bool":
        test = _text_filter(cell.cast("string"), operator, value)
    else:
        test = _text_filter(cell.cast("string") if kind == "other" else cell, operator, value)
    return cell.isNotNull() & test


def where_all(df: DataFrame, filters: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Rows that pass every ``{column, operator, value}`` filter."""
    tests = [matches(df, f["column"], f["operator"], f.get("value")) for f in filters]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def cross_filter(
    df: DataFrame,
    date_column: str | None = None,
    start: str | None = None,
    end: str | None = None,
    category_column: str | None = None,
    category: Any = None,
) -> DataFrame:
    """Rows within an inclusive day range and with exactly this category.

    With a bound set, rows without a date are dropped. Text date columns hold ISO days; for
    other texts, filter ``sources.records.inferred_types`` of the table's profile.
    """
    tests = []
    if date_column and (start or end):
        cell, typed = F.col(quoted(date_column)), kind_of(df.schema[date_column].dataType) == "date"
        for op, bound in ((">=", start), ("<=", end)):
            if bound:
                tests.append(_day_filter(cell, op, date.fromisoformat(bound)) if typed else _compare(cell, op, bound))
    if category_column:
        tests.append(F.col(quoted(category_column)) == category)
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df
