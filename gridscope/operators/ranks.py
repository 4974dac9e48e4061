"""Rows at evenly spaced ranks, found by counting ranges of the sort key instead of sorting the table."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridscope.errors import TableError
from gridscope.functions.clean import quoted

RANGES = 65_536  # ranges counted together, about
RANKED = 20_000  # rows of one range that are ranked by a window
SHOWN = 512  # characters of a key that reach the driver
_DIGITS = "0123456789ABCDEF"
_SIGNS = 17  # a digit, or the end of a text


def _digits(number: Column, width: int) -> Column:
    return F.lpad(F.hex(number), width, "0")


def _below_zero(digits: Column) -> Column:
    return F.translate(digits, _DIGITS, _DIGITS[::-1])


def _whole_text(v: Column) -> Column:
    """Negative numbers have their sign bit set in hexadecimal form; their digits already ascend."""
    return F.concat(F.when(v < 0, "0").otherwise("1"), _digits(v, 16))


def _with_scaled(df: DataFrame, doubles: dict[str, str]) -> DataFrame:
    """Exponent ``<name>e`` and mantissa ``<name>m`` (1 up to 2) of finite doubles, exact as scaling is by powers of two.

    The steps are columns of their own: written as one expression they would repeat each other.
    """
    for name, c in doubles.items():
        size, near, m, e = F.abs(F.col(quoted(c)).cast("double")), F.col(f"{name}n"), F.col(f"{name}s"), f"{name}e"
        half = (near / 2).cast("int")  # in two steps, as 2 ** 1074 is no double
        df = df.withColumn(f"{name}n", F.when(size < float("inf"), F.floor(F.log2(size))).cast("int"))
        df = df.withColumn(f"{name}s", size * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - near))
        # the logarithm may be off by one beside a power of two
        df = df.withColumn(e, near + F.when(m >= 2, 1).when(m < 1, -1).otherwise(0))
        df = df.withColumn(f"{name}m", m * F.when(m >= 2, 0.5).when(m < 1, 2.0).otherwise(1.0))
    return df


def _double_text(v: Column, name: str) -> Column:
    """Exponent and mantissa of a double in digits that ascend with it."""
    digits = F.concat(_digits(F.col(f"{name}e") + 1100, 3), _digits((F.col(f"{name}m") * float(2**52)).cast("long"), 14))
    flipped = F.when(v < 0, F.concat(F.lit("0"), _below_zero(digits))).otherwise(F.concat(F.lit("1"), digits))
    return (
        F.when(F.isnan(v), "3").when(v == float("inf"), "2").when(v == float("-inf"), F.lit("0" * 18))
        .when(v == 0, F.lit("1" + "0" * 17)).otherwise(flipped)
    )


def _decimal_text(v: Column) -> Column:
    digits = F.lpad(F.regexp_replace(F.abs(v).cast("string"), r"\.", ""), 38, "0")
    return F.when(v < 0, F.concat(F.lit("0"), _below_zero(digits))).otherwise(F.concat(F.lit("1"), digits))


def with_sort_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``_key``, a text that sorts like ``columns`` ascending, nulls first, and is equal where they are; then ``df``."""
    names = df.columns
    doubles = {f"_f{i}": c for i, c in enumerate(columns) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))}
    df = _with_scaled(df, doubles)
    pieces = []
    for i, c in enumerate(columns):
        v, dtype = F.col(quoted(c)), df.schema[c].dataType
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            text = _double_text(v.cast("double"), f"_f{i}")
        elif isinstance(dtype, T.DecimalType):
            # all values of a column have the same number of decimals
            text = _decimal_text(v)
        elif isinstance(dtype, T.IntegralType):
            text = _whole_text(v.cast("long"))
        elif isinstance(dtype, T.BooleanType):
            text = v.cast("int").cast("string")
        elif isinstance(dtype, T.DateType):
            text = _whole_text(F.unix_date(v).cast("long"))
        elif isinstance(dtype, T.TimestampType):
            text = _whole_text(F.unix_micros(v))
        elif isinstance(dtype, T.TimestampNTZType):
            text = _whole_text(F.unix_micros(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), v).cast("timestamp")))
        elif isinstance(dtype, (T.StringType, T.BinaryType)):
            # the blank sorts below every digit, so that a text comes before its continuations
            text = F.concat(F.hex(v.cast("binary")), F.lit(" "))
        else:
            raise TableError(f"rows cannot be ordered by {c}: {dtype.simpleString()}", "UNKNOWN_OPERATION")
        pieces.append(F.when(v.isNull(), "0").otherwise(F.coalesce(F.concat(F.lit("1"), text), F.lit(""))))
    return df.select(F.concat(*pieces).alias("_key"), *map(quoted, names))


@dataclass(frozen=True)
class _Range:
    """Rows whose key starts with ``cell``; ``start`` rows sort before them."""

    cell: str
    start: int
    n: int
    shared: int  # so many leading characters are the same in all of them
    alike: bool = False

    @property
    def done(self) -> bool:
        return self.alike or self.n <= RANKED


def every_kth(rows: DataFrame, order_by: list[str], points: int) -> DataFrame:
    """``row`` and the columns of ``rows``: every ``ceil(n / points)``-th row, counted from 0.

    The order is that of ``order_by``, then of all other columns, so rows that tie are equal
    and the result does not depend on the partitioning. Every pass counts the leading
    characters of the sort key with map-side combine and keeps the ranges that hold a wanted
    rank, at most ``points``, until each is short or holds one repeated row. Rows are never
    sorted or shuffled as a whole; only the short ranges are ranked.
    """
    spark = rows.sparkSession
    keyed = with_sort_text(rows, [*order_by, *[c for c in rows.columns if c not in order_by]])
    whole = keyed.agg(
        F.count("*").alias("n"), F.substring(F.min("_key"), 1, SHOWN).alias("low"), F.substring(F.max("_key"), 1, SHOWN).alias("high"),
        (F.min("_key") == F.max("_key")).alias("alike"),
    ).first()
    wanted = range(0, whole.n, max(1, math.ceil(whole.n / points)))
    shared = len(os.path.commonprefix([whole.low or "", whole.high or ""]))
    ranges = [_Range("", 0, whole.n, shared, bool(whole.alike))] if whole.n else []
    level = keyed.withColumn("_cell", F.lit(""))
    while not all(r.done for r in ranges):
        level, ranges = _split(level, ranges, wanted)

    sought = [(r.cell, k - r.start, k, r.alike) for r in ranges for k in _within(wanted, r.start, r.n)]
    look_up = F.broadcast(spark.createDataFrame(sought, "_cell string, _place long, row long, _alike boolean"))  # at most ``points``
    short = spark.createDataFrame([(r.cell,) for r in ranges if not r.alike], "_cell string")
    order = Window.partitionBy("_cell").orderBy("_key")
    numbered = level.join(F.broadcast(short), "_cell").withColumn("_place", F.row_number().over(order).cast("long") - 1)
    found = numbered.join(look_up.where(~F.col("_alike")), ["_cell", "_place"]).select("row", *map(quoted, rows.columns))
    if not any(r.alike for r in ranges):
        return found
    one = level.join(look_up.where("_alike").select("_cell").distinct(), "_cell").dropDuplicates(["_cell"])
    repeated = one.join(look_up.where("_alike"), "_cell").select("row", *map(quoted, rows.columns))
    return found.unionByName(repeated)


def _within(wanted: range, start: int, n: int) -> range:
    """The wanted ranks from ``start`` up to ``start + n``."""
    first = -(-start // wanted.step) * wanted.step
    return range(first, min(start + n, wanted.stop), wanted.step)


def _split(level: DataFrame, ranges: list[_Range], wanted: range) -> tuple[DataFrame, list[_Range]]:
    """One pass: longer leading texts for the ranges that are not done, and the new ranges."""
    spark = level.sparkSession
    more = max(1, int(math.log(max(_SIGNS, RANGES / sum(not r.done for r in ranges)), _SIGNS)))
    lengths = [(r.cell, len(r.cell) if r.done else r.shared + more) for r in ranges]
    # a range of each wanted rank at most
    cut = F.broadcast(spark.createDataFrame(lengths, "_cell string, _length int"))
    level = level.join(cut, "_cell").withColumn("_cell", F.substring(F.col("_key"), F.lit(1), F.col("_length"))).drop("_length")
    counted = sorted((r["_cell"], r["n"]) for r in level.groupBy("_cell").agg(F.count("*").alias("n")).collect())

    parents, found, seen = sorted(ranges, key=lambda r: r.start), [], 0
    # cells sort like their keys, so the parts of a range follow one another
    parts = iter(counted)
    for parent in parents:
        seen = parent.start
        while seen < parent.start + parent.n:
            cell, n = next(parts)
            if parent.done:
                found.append(parent)
            elif _within(wanted, seen, n):
                found.append(_Range(cell, seen, n, len(cell)))
            seen += n
    known = {(r.start, r.n) for r in ranges}
    stuck = [r for r in found if not r.done and (r.start, r.n) in known]
    if stuck:
        some = F.broadcast(spark.createDataFrame([(r.cell,) for r in stuck], "_cell string"))
        bounds = level.join(some, "_cell").groupBy("_cell").agg(F.min("_key").alias("low"), F.max("_key").alias("high")).select(
            "_cell", (F.col("low") == F.col("high")).alias("alike"),
            *[F.substring(c, F.length("_cell") + 1, F.lit(SHOWN)).alias(c) for c in ("low", "high")],
        ).collect()
        ends = {b["_cell"]: (len(b["_cell"]) + len(os.path.commonprefix([b["low"], b["high"]])), b["alike"]) for b in bounds}
        found = [_Range(r.cell, r.start, r.n, *ends[r.cell]) if r.cell in ends else r for r in found]
    return level, found
