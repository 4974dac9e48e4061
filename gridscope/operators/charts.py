"""The aggregations behind charts: breakdowns, trends, histograms, proportions, cards.

Every function takes whole rows, groups them with map-side combine, and returns a small
long DataFrame. ``kind`` is ``"sum"``, ``"average"`` (trimmed mean of groups with at least
:data:`MIN_GROUP` values) or ``"count"``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridscope.functions import dates, formats
from gridscope.functions.clean import number_of, value_of
from gridscope.operators import robust
from gridscope.operators.keys import attach, measures_long
from gridscope.operators.quantiles import Quantiles

MIN_GROUP = 5
TOP_CATEGORIES = 8
PIE_SLICES = 7
BINS = 10


def _number(df: DataFrame, column: str) -> Column:
    return number_of(column, df.schema[column].dataType)


def _text(df: DataFrame, column: str) -> Column:
    return value_of(column, df.schema[column].dataType).cast("string")


def grouped(
    rows: DataFrame, by: Sequence[str], kind: str, min_group: int = MIN_GROUP
) -> DataFrame:
    """``by..., value, n`` for rows ``(by..., value)`` without nulls. Values are unrounded."""
    if kind == "average":
        stats = robust.trimmed_means(rows, by).where(F.col("n") >= min_group)
        return stats.select(*by, F.col("trimmed_mean").alias("value"), "n")
    return rows.groupBy(*by).agg(F.sum("value").alias("value"), F.count("*").alias("n"))


def breakdown(
    df: DataFrame, category: str, measure: str | None = None, kind: str = "sum", top: int = TOP_CATEGORIES,
) -> DataFrame:
    """``category, value``: the ``top`` categories by ``value``, ties by category.

    Without a measure the value is the number of rows. Ranking happens before rounding.
    """
    key = _text(df, category).alias("category")
    if measure is None:
        counts = df.select(key).where(F.col("category").isNotNull()).groupBy("category")
        return counts.agg(F.count("*").alias("value")).orderBy(F.desc("value"), "category").limit(top)
    rows = df.select(key, _number(df, measure).alias("value")).dropna()
    ranked = grouped(rows, ["category"], kind).orderBy(F.desc("value"), "category").limit(top)
    return ranked.select("category", F.round("value", 2).alias("value"))


def breakdowns(
    df: DataFrame, pairs: Sequence[tuple[str, str, str]], top: int = TOP_CATEGORIES
) -> DataFrame:
    """Many breakdowns at once: ``category_column, measure, rank, category, value``.

    ``pairs`` holds ``(category column, measure, kind)``. Pairs of one kind share a scan and
    a shuffle; the rank filter is applied in every task before the ranking shuffle.
    """
    parts = []
    for kind in ("sum", "average"):
        chosen = [(c, m) for c, m, k in pairs if k == kind]
        if not chosen:
            continue
        cells = F.array(*[
            F.struct(
                F.lit(c).alias("category_column"), F.lit(m).alias("measure"),
                _text(df, c).alias("category"), _number(df, m).alias("value"),
            ) for c, m in chosen
        ])
        rows = df.select(F.inline(cells)).where(F.col("category").isNotNull() & F.col("value").isNotNull())
        parts.append(grouped(rows, ["category_column", "measure", "category"], kind))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    order = Window.partitionBy("category_column", "measure").orderBy(F.desc("value"), "category")
    return (
        merged.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("category_column", "measure", "rank", "category", F.round("value", 2).alias("value"))
    )


def trend(
    df: DataFrame, date_column: str, measure: str, kind: str, grouping: str, week_start: str = "monday",
) -> DataFrame:
    """``period, value`` in period order. Periods without rows do not appear."""
    moment = dates.date_of(date_column, df.schema[date_column].dataType)
    rows = df.select(
        dates.period_start(moment, grouping, week_start).alias("start"), _number(df, measure).alias("value")
    ).dropna()
    values = grouped(rows, ["start"], kind)
    label = dates.period_label(F.col("start"), grouping, week_start).alias("period")
    return values.orderBy("start").select(label, F.round("value", 2).alias("value"))


def trends(
    df: DataFrame, date_column: str, measures: Sequence[tuple[str, str]], grouping: str,
    week_start: str = "monday",
) -> DataFrame:
    """Trends of several ``(measure, kind)`` over one date column: ``measure, period, value``."""
    moment = dates.date_of(date_column, df.schema[date_column].dataType)
    keep = {"start": dates.period_start(moment, grouping, week_start)}
    parts = []
    for kind in ("sum", "average"):
        chosen = {m: _number(df, m) for m, k in measures if k == kind}
        if chosen:
            rows = measures_long(df, chosen, keep).where(F.col("start").isNotNull())
            parts.append(grouped(rows, ["measure", "start"], kind))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    label = dates.period_label(F.col("start"), grouping, week_start).alias("period")
    return merged.orderBy("measure", "start").select("measure", label, F.round("value", 2).alias("value"))


def distinct_days(df: DataFrame, date_column: str, stop_at: int) -> int:
    """Number of distinct days, counted no further than ``stop_at``."""
    moment = dates.date_of(date_column, df.schema[date_column].dataType)
    days = df.select(F.to_date(moment).alias("d")).where(F.col("d").isNotNull()).distinct()
    return days.limit(stop_at).count()


# How the two bounds of a bin are written.
BIN_STYLES = {
    "report": formats.report_number,
    "axis": formats.axis_number,
    "fixed": lambda v: formats.fixed_number(v, 1),
}


def histograms(
    df: DataFrame, measures: Sequence[str], bins: int = BINS, style: str = "report",
    spread: Quantiles | None = None,
) -> DataFrame:
    """Equal-width bins over the trimmed range of each measure.

    ``measure, bin, label, count, total, trimmed``; empty bins are listed, values beyond the
    range fall into the outer bins, and a measure of one single value has one bin. A
    ``spread`` known from profiling saves computing the quartiles again.
    """
    found = spread or robust.measured_spread(measures_long(df, {m: _number(df, m) for m in measures}))
    low, high = robust.trimmed_range()
    ranges = found.frame.select(
        "measure", F.col("n").alias("total"), "v_min", "v_max", low.alias("lo"), high.alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    single = F.col("v_min") == F.col("v_max")
    place = F.greatest(F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)), F.lit(0))
    counts = (
        attach(found.counted, ranges, ["measure"], found.groups)
        .groupBy("measure", F.when(single, 0).otherwise(place).cast("int").alias("bin"))
        .agg(F.sum("m").alias("count"))
    )
    write = BIN_STYLES[style]
    edge_low, edge_high = F.col("lo") + F.col("bin") * width, F.col("lo") + (F.col("bin") + 1) * width
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.when(single, 0).otherwise(bins - 1))))
    return (
        grid.join(F.broadcast(counts), ["measure", "bin"], "left")  # at most bins rows per measure
        .select(
            "measure", "bin",
            F.when(single, write(F.col("v_min")))
            .otherwise(F.concat(write(edge_low), F.lit("-"), write(edge_high))).alias("label"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
            "total",
            ((F.col("lo") > F.col("v_min")) | (F.col("hi") < F.col("v_max"))).alias("trimmed"),
        )
    )


def proportions(df: DataFrame, category: str, keep: int = PIE_SLICES - 1, whole: int = PIE_SLICES) -> DataFrame:
    """``rank, category, value, total``: row counts per category, small ones as ``Other``.

    With at most ``whole`` categories all are listed; otherwise the ``keep`` largest and
    ``Other``. Only the top ``whole + 1`` counts are ever ranked together.
    """
    counts = (
        df.select(_text(df, category).alias("category")).where(F.col("category").isNotNull())
        .groupBy("category").agg(F.count("*").alias("value"))
    )
    order = Window.orderBy(F.desc("value"), "category")
    head = counts.orderBy(F.desc("value"), "category").limit(whole + 1)
    ranked = head.withColumn("rank", F.row_number().over(order)).withColumn("seen", F.count("*").over(Window.partitionBy()))
    shown = ranked.where((F.col("seen") <= whole) | (F.col("rank") <= keep))
    total = counts.agg(F.sum("value").alias("total"))
    other = shown.agg(F.sum("value").alias("shown"), F.max("rank").alias("rank")).select(
        (F.col("rank") + 1).alias("rank"), F.lit("Other").alias("category"),
        (total.scalar() - F.col("shown")).alias("value"),
    ).where(F.col("value") > 0)
    slices = shown.select("rank", "category", "value").unionByName(other)
    return slices.withColumn("total", total.scalar()).orderBy("rank")


def explore_proportions(df: DataFrame, category: str, keep: int = PIE_SLICES) -> DataFrame:
    """Like :func:`proportions`, but always the ``keep`` largest before ``Other``."""
    return proportions(df, category, keep=keep, whole=keep)


def summary_cards(
    df: DataFrame, measures: Sequence[tuple[str, str]], plain_sums: bool = False
) -> DataFrame:
    """``measure, agg_kind, sum, mean, min, max`` for ``(measure, kind)`` pairs.

    The mean is trimmed; with ``plain_sums`` (filtered cards) only that of averages is.
    """
    rows = measures_long(df, {m: _number(df, m) for m, _ in measures})
    stats = robust.trimmed_stats(rows, ["measure"])
    kinds = F.create_map(*[F.lit(x) for pair in measures for x in pair])
    kind = F.element_at(kinds, F.col("measure"))
    mean = F.when((kind == "average") | F.lit(not plain_sums), F.col("trimmed_mean")).otherwise(F.col("mean"))
    return stats.select(
        "measure", kind.alias("agg_kind"),
        F.round("total", 2).alias("sum"), F.round(mean, 2).alias("mean"),
        F.round("v_min", 2).alias("min"), F.round("v_max", 2).alias("max"),
    )
