"""Dates in mixed formats, and calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from gridscope.functions.clean import kind_of, quoted

# Texts that cannot be dates are told apart cheaply by these two shapes.
THREE_DIGITS = "[0-9](?:[^0-9]*[0-9]){2}"
MAYBE_DATE = r"^[0-9A-Za-z][-0-9A-Za-z/., :+]{4,}$"
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
# Rewrites of a text whose separators are single spaces. Years get four
# digits (69 to 99 are 19xx, 00 to 68 are 20xx); a day that cannot be a month moves back.
REWRITES = [
    (r"^(\d{1,2} \d{1,2}|\d{1,2} [A-Za-z]{3,9}) (69|[7-9]\d)(?=$| \d{1,2}:)", "$1 19$2"),
    (r"^(\d{1,2} \d{1,2}|\d{1,2} [A-Za-z]{3,9}) ([0-6]\d)(?=$| \d{1,2}:)", "$1 20$2"),
    (r"^(1[3-9]|[23]\d) (\d{1,2}) (\d{4})", "$2 $1 $3"),
]
# The rewritten shapes and their formats.
_TIME = r"( \d{1,2}:.*)?$"
_CLOCK = "[ h:mm[:ss] a][ H:mm[:ss[ SSS]]]"
_MONTH = "[MMMM][MMM]"
NUMERIC_SHAPES = [
    (r"^\d{1,2} \d{1,2} \d{4}" + _TIME, "M d yyyy" + _CLOCK),
    (r"^\d{4} \d{1,2} \d{1,2}" + _TIME, "yyyy M d" + _CLOCK),
    (r"^\d{8}$", "yyyyMMdd"),
]
NAMED_SHAPES = [
    (r"^[A-Za-z]{3,9} \d{1,2} \d{4}" + _TIME, _MONTH + " d yyyy" + _CLOCK),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}" + _TIME, "d " + _MONTH + " yyyy" + _CLOCK),
    (r"^[A-Za-z]{3,9} \d{4}$", _MONTH + " yyyy"),
]


def _by_shape(text: Column, shapes: list[tuple[str, str]]) -> Column:
    parsed = F
    for shape, form in shapes:
        parsed = parsed.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)))
    return parsed


def date_from_text(cell: Column) -> Column:
    """Timestamp of a text in any of the known formats, chosen per value, else NULL.

    Shape tests pick one parse per value. Numbers such as ``1200`` and time-only texts are
    not dates. Offsets are converted to the session time zone.
    """
    text = F.trim(cell)
    spaced = F.regexp_replace(text, "[-/., ]+", " ")
    for pattern, rewritten in REWRITES:
        spaced = F.regexp_replace(spaced, pattern, rewritten)
    iso = F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp"))
    # a one-element array binds the rewritten text, so that it is computed once per value
    bound = F.array(spaced)
    other = F.when(
        text.rlike("[A-Za-z]{3}"), F.transform(bound, lambda t: _by_shape(t, NAMED_SHAPES))[0]
    ).otherwise(F.transform(bound, lambda t: _by_shape(t, NUMERIC_SHAPES))[0])
    possible = (F.length(text) >= 5) & text.rlike(MAYBE_DATE) & text.rlike(THREE_DIGITS)
    return F.when(possible, F.when(text.rlike(r"^\d{4}-"), iso).otherwise(other))


def date_of(name: str, dtype: T.DataType) -> Column:
    """Column ``name`` as a date or timestamp: typed columns as they are, text parsed."""
    cell = F.col(quoted(name))
    kind = kind_of(dtype)
    if kind == "date":
        return cell
    if kind == "text":
        return date_from_text(cell)
    return F.lit(None).cast("timestamp")


def pick_grouping(min_date, max_date) -> str:
    """Month above 180 days of span, week above 21, else day."""
    span = (max_date - min_date).days
    if span > 180:
        return "M"
    return "W" if span > 21 else "D"


def period_start(moment: Column, grouping: str, week_start: str = "monday") -> Column:
    """First day of the day / week / month of ``moment``; the key to group by."""
    if grouping == "M":
        return F.trunc(moment, "month")
    day = F.to_date(moment)
    if grouping == "W":
        if week_start == "sunday":
            return F.date_sub(day, F.dayofweek(day) - 1)
        return F.trunc(day, "week")
    return day


def period_label(start: Column, grouping: str, week_start: str = "monday") -> Column:
    """``2024-01`` / ``2024-01-01/2024-01-07`` (Sunday weeks: first day) / ``2024-01-01``."""
    text = start.cast("string")
    if grouping == "M":
        return F.substring(text, 1, 7)
    if grouping == "W" and week_start == "monday":
        return F.concat(text, F.lit("/"), F.date_add(start, 6).cast("string"))
    return text
