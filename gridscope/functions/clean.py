"""Turning messy cells into values: null tokens, numbers, truth words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from gridscope.functions.names import names_size

# Cell texts that mean "no value" on read. They match whole cells exactly.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_WORDS = ["true", "yes", "y", "1"]
FALSE_WORDS = ["false", "no", "n", "0"]

MONEY_MARKS = "$,€£%"
_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SHORTHAND = r"^\s*([+-]?\d*\.?\d+)\s*([KkMmBb])\s*$"


def kind_of(dtype: T.DataType) -> str:
    """Physical family of a Spark type: number, text, date, bool or other."""
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "other"


def null_tokens(cell: Column) -> Column:
    """NULL for the texts in :data:`NULL_TOKENS`; anything else, such as ``-``, stays."""
    return F.when(~cell.isin(NULL_TOKENS), cell)


def plain_number(cell: Column) -> Column:
    """Number text without any cleaning, else NULL.

    The pattern guards the cast, which alone would accept ``1d`` or ``Infinity``.
    """
    return F.when(cell.rlike(_PLAIN_NUMBER), F.trim(cell).try_cast("double"))


def number_from_text(cell: Column, shorthand: bool = True) -> Column:
    """Strip ``$ , € £ %``, read ``1.2K / 3M / 2B`` when ``shorthand``, else plain numbers.

    ``12%`` is 12; ``1,200 USD`` is NULL.
    """
    bare = F.translate(cell, MONEY_MARKS, "")
    plain = plain_number(bare)
    if not shorthand:
        return plain
    # the last letter decides, so that plain numbers meet one pattern only
    unit = F.upper(F.right(F.rtrim(bare), F.lit(1)))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1e9)
    short = F.regexp_extract(bare, _SHORTHAND, 1).try_cast("double") * scale
    return F.when(unit.isin("K", "M", "B"), short).otherwise(plain)


def number_of(name: str, dtype: T.DataType) -> Column:
    """Column ``name`` as a double measure; NaN, infinite and unreadable cells are NULL."""
    cell = F.col(quoted(name))
    kind = kind_of(dtype)
    if kind == "number":
        value = cell.cast("double")
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            # adding zero turns -0.0 into 0.0, so both count as one value
            return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value + F.lit(0.0))
        return value
    if kind == "text":
        return number_from_text(cell, shorthand=not names_size(name))
    return F.lit(None).cast("double")


def truth_of(cell: Column) -> Column:
    """TRUE / FALSE for yes-no style words (trimmed, any case), else NULL."""
    word = F.lower(F.trim(cell.cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def value_of(name: str, dtype: T.DataType) -> Column:
    """Column ``name`` with NaN read as NULL and everything else untouched."""
    cell = F.col(quoted(name))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(cell), cell + F.lit(0.0).cast(dtype))
    return cell


def quoted(name: str) -> str:
    """Back-quoted column reference, safe for names with dots, spaces or quotes."""
    return "`" + name.replace("`", "``") + "`"
