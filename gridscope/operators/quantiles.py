"""Exact quantiles with linear interpolation, for groups of any size.

Values are counted once per group with map-side combine and written: one row per group and
distinct value, however often it occurs. All else is read from that table, never from the
rows again. Where it is short, a running sum per group tells which value holds a rank. Where
it is long, it is dealt out in order of group and value; the totals of each range give the
range that holds a wanted rank, and a running sum inside that range gives the value, so that
a large group is spread over many ranges and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridscope.functions.clean import quoted
from gridscope.session import scratch_path


#: A counted table of at most this many rows is ranked by one sort per group.
SHORT = 2_000_000


@dataclass
class Quantiles:
    """``frame`` has ``by..., n, v_min, v_max, q`` where ``q`` is an array over the probs.

    ``groups`` is the number of its rows; ``counted`` has ``by..., value, m`` for every
    distinct value and its number of rows.
    """

    frame: DataFrame
    groups: int
    counted: DataFrame


def counted_values(rows: DataFrame, by: Sequence[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """``by..., value, m``: every distinct non-null value and its number of rows, written once.

    A row of counted rows stands for as many as its ``weight`` tells.
    """
    size = F.count("*") if weight is None else F.sum(weight)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(size.alias("m"))
    return written(counts, "counted-values")


def written(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written once to the shared scratch folder and read back."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def exact_quantiles(
    rows: DataFrame, by: Sequence[str], probs: Sequence[float], value: str = "value", known: tuple[int, int] | None = None,
    weight: str | None = None,
) -> Quantiles:
    """Quantiles of non-null ``value`` per group of the non-null keys ``by``.

    ``known`` is ``(number of groups, rows of the largest)`` where the caller has counted them
    already; ``weight`` names a column that tells how many rows a row stands for.
    """
    by = list(by)
    counted = counted_values(rows, by, value, weight)
    total = counted.count()  # from the file footers
    ranked = _ranked_by_group if total <= SHORT else _ranked_by_range
    groups = known[0] if known is not None else counted.select(*by).distinct().count()
    return Quantiles(ranked(counted, by, probs, value), groups, counted)


def _interpolated(low: Column, high: Column, position: Column) -> Column:
    return low + (position - F.floor(position)) * (high - low)


def _ranked_by_group(counted: DataFrame, by: list[str], probs: Sequence[float], value: str) -> DataFrame:
    running = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("m").over(running)).withColumn("n", F.sum("m").over(Window.partitionBy(*by)))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    positions = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    found = ranked.groupBy(*by).agg(
        F.any_value("n").alias("n"), F.min(value).alias("v_min"), F.max(value).alias("v_max"),
        *[at(side(p)).alias(f"_{name}{i}") for i, p in enumerate(positions) for name, side in (("lo", F.floor), ("hi", F.ceil))],
    )
    q = F.array(*[_interpolated(F.col(f"_lo{i}"), F.col(f"_hi{i}"), p) for i, p in enumerate(positions)])
    return found.select(*by, "n", "v_min", "v_max", q.alias("q"))


def _ranked_by_range(counted: DataFrame, by: list[str], probs: Sequence[float], value: str) -> DataFrame:
    order = [*map(quoted, by), quoted(value)]
    counted = written(counted.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges-of-values")
    ranges = counted.groupBy(*by, "part").agg(F.sum("m").alias("m"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    # As many rows per group as the group has ranges.
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumn("upto", F.sum("m").over(before))
    sizes = ranges.groupBy(*by).agg(F.sum("m").alias("n"), F.min("lo").alias("v_min"), F.max("hi").alias("v_max"))
    ranked = sizes.withColumn("_pos", F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in probs]))
    wanted = F.array_union(F.transform("_pos", lambda p: F.floor(p)), F.transform("_pos", lambda p: F.ceil(p)))
    inside = (F.col("k") >= F.col("upto") - F.col("m")) & (F.col("k") < F.col("upto"))
    targets = (
        ranked.select(*by, F.explode(wanted).alias("k")).join(ranges, by).where(inside)
        .select(*by, "part", "k", (F.col("upto") - F.col("m")).alias("below"))
    )
    held = Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (
        counted.join(targets.select(*by, "part").distinct(), [*by, "part"], "left_semi").withColumn("upto", F.sum("m").over(held))
    )
    at = F.col("k") - F.col("below")
    found = targets.join(running, [*by, "part"]).where((at >= F.col("upto") - F.col("m")) & (at < F.col("upto")))
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", F.col(value).alias("v")))).alias("_at"))
    interpolated = F.transform("_pos", lambda p: _interpolated(F.element_at("_at", F.floor(p)), F.element_at("_at", F.ceil(p)), p))
    return ranked.join(values, by).select(*by, "n", "v_min", "v_max", interpolated.alias("q"))
