"""Outlier-resistant statistics built on quartiles.

Rows come in long form ``(by..., value)``. ``spread`` gives one row of quartiles per
group; everything else is an expression over that row, or an aggregate over the counted values
``(by..., value, m)`` that the quartiles come from, so the rows are read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridscope.operators.keys import attach
from gridscope.operators.quantiles import Quantiles, exact_quantiles

TRIM = 3.0  # fences for trimming
FLAG = 1.5  # fences for reporting outliers


def spread(
    rows: DataFrame, by: Sequence[str], known: tuple[int, int] | None = None, weight: str | None = None
) -> Quantiles:
    """``by..., n, v_min, v_max, q1, q2, q3`` per group."""
    found = exact_quantiles(rows, by, [0.25, 0.5, 0.75], known=known, weight=weight)
    frame = found.frame.select(
        *by, "n", "v_min", "v_max",
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"),
    )
    return Quantiles(frame, found.groups, found.counted)


SPREAD_FIELDS = "n long, v_min double, v_max double, q1 double, q2 double, q3 double"


def known_spread(spark: SparkSession, facts: Mapping[str, Mapping[str, float]], counted: DataFrame) -> Quantiles:
    """The spread of measures whose quartiles are known already, one row per measure."""
    fields = ["n", "v_min", "v_max", "q1", "q2", "q3"]
    rows = [(m, *[f[k] for k in fields]) for m, f in facts.items()]
    return Quantiles(spark.createDataFrame(rows, f"measure string, {SPREAD_FIELDS}"), len(rows), counted)


def measured_spread(rows: DataFrame, weight: str | None = None) -> Quantiles:
    """Spread per ``measure``, computed once and kept: one row per measure column."""
    found = spread(rows, ["measure"], weight=weight)
    kept = found.frame.collect()
    return Quantiles(rows.sparkSession.createDataFrame(kept, found.frame.schema), len(kept), found.counted)


def fence(side: str, multiplier: float = TRIM) -> Column:
    iqr = F.col("q3") - F.col("q1")
    return F.col("q1") - multiplier * iqr if side == "low" else F.col("q3") + multiplier * iqr


def outside(multiplier: float) -> Column:
    """Strictly beyond the fences; nothing is, when the quartiles coincide."""
    far = (F.col("value") < fence("low", multiplier)) | (F.col("value") > fence("high", multiplier))
    return (F.col("q3") != F.col("q1")) & far


def trimmed_range() -> tuple[Column, Column]:
    """Fences clamped into [min, max]; the full range when they degenerate."""
    low = F.greatest("v_min", fence("low"))
    high = F.least("v_max", fence("high"))
    usable = (F.col("q3") != F.col("q1")) & (low < high)
    return F.when(usable, low).otherwise(F.col("v_min")), F.when(usable, high).otherwise(F.col("v_max"))


def zero_anchor() -> Column:
    """Whether an axis should start at zero, judged on the trimmed range."""
    low, high = trimmed_range()
    width = high - low
    return (width <= 0) | (low <= 0) | (low / width <= 2.0)


def trimmed_stats(
    rows: DataFrame, by: Sequence[str], known: tuple[int, int] | None = None, weight: str | None = None
) -> DataFrame:
    """Per group: the spread plus ``total``, ``mean``, ``trimmed_mean``, ``n_extreme``, ``n_values``."""
    return stats_of(spread(rows, by, known, weight), by)


def stats_of(found: Quantiles, by: Sequence[str]) -> DataFrame:
    """The same for a spread that is known, from its counted values."""
    joined = attach(found.counted, found.frame, by, found.groups)
    stats = ["n", "v_min", "v_max", "q1", "q2", "q3"]
    inner, weighted = ~outside(TRIM), F.col("value") * F.col("m")
    return (
        joined.groupBy(*by)
        .agg(
            *[F.any_value(c).alias(c) for c in stats],
            F.count(F.lit(1)).alias("n_values"),
            F.sum(weighted).alias("total"),
            F.sum(F.when(inner, weighted)).alias("_sum"),
            F.sum(F.when(inner, F.col("m"))).alias("_n"),
            F.coalesce(F.sum(F.when(outside(TRIM), F.col("m"))), F.lit(0)).alias("n_extreme"),
        )
        .withColumn("mean", F.col("total") / F.col("n"))
        .withColumn("trimmed_mean", F.coalesce(F.col("_sum") / F.col("_n"), "mean"))
        .drop("_sum", "_n")
    )


def trimmed_means(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., n, trimmed_mean`` of many groups, averaged over the rows in the order they are read.

    Means of small groups often lie on a rounding border, where a sum in another order can
    fall to the other side; counted values meet in an order that differs from run to run.
    """
    found = spread(rows, by)
    return (
        attach(rows, found.frame, by, found.groups).groupBy(*by)
        .agg(F.any_value("n").alias("n"), F.avg(F.when(~outside(TRIM), F.col("value"))).alias("_inner"), F.avg("value").alias("_mean"))
        .select(*by, "n", F.coalesce("_inner", "_mean").alias("trimmed_mean"))
    )
