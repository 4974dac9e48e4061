"""How numbers are written in labels and statements."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def report_number(value: Column) -> Column:
    """No decimals from 1000 up or for whole numbers, otherwise two; thousands separated."""
    whole = (F.abs(value) >= 1000) | (value == F.floor(value))
    return F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2))


def axis_number(value: Column) -> Column:
    """Like :func:`report_number`, but without trailing zeros and rounding halves up."""
    short = F.regexp_replace(F.format_number(F.round(value, 2), 2), r"\.?0+$", "")
    return F.when(F.abs(value) >= 1000, F.format_number(F.floor(value + 0.5).cast("long"), 0)).otherwise(short)


def fixed_number(value: Column, digits: int = 1) -> Column:
    """Fixed decimals without separators."""
    return F.replace(F.format_number(F.round(value, digits), digits), F.lit(","), F.lit(""))
