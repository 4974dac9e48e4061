"""A filtered dashboard without another scan: a small table of counted cells answers any filter.

A cell is a day, the value of every charted category, a measure and one of its values; the
table tells how many rows share it. Cards, trends, breakdowns and histograms under a day range
and a category are aggregates over the cells that pass, exact and with the operators that made
the whole charts. Proportions show the whole table and stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window, functions as F

from gridscope.functions import dates
from gridscope.functions.clean import number_of, value_of
from gridscope.operators import charts as C, robust
from gridscope.operators.filters import cross_filter
from gridscope.operators.keys import measures_long
from gridscope.operators.quantiles import written
from gridscope.plans.dashboard import MAX_CATEGORIES, Analysis
from gridscope.errors import TableError

#: The measure of cells that count rows; every row has it once.
ROWS = ""


@dataclass
class FilterCube:
    """``cells`` has ``day, c0.., measure, value, m``; ``categories`` names the columns ``c0..``."""

    cells: DataFrame
    charts: list[dict[str, Any]]
    categories: dict[str, str]
    dated: bool


def filter_cube(analysis: Analysis) -> FilterCube:
    """The cells of a dashboard, counted in one scan and written once."""
    prof, charts = analysis.profile, analysis.charts
    df, types = prof.df, {f.name: f.dataType for f in prof.df.schema.fields}
    days = prof.of_type("date")
    shown = [c["category_column"] for c in charts if c["type"] == "bar"]
    chosen = dict.fromkeys([*shown, *prof.of_type("categorical")[:MAX_CATEGORIES]])
    categories = {c: f"c{i}" for i, c in enumerate(chosen)}
    measures = dict.fromkeys(c["measure_column"] for c in charts if c.get("measure_column"))
    keep = {"day": F.to_date(dates.date_of(days[0], types[days[0]])) if days else F.lit(None).cast("date")}
    keep |= {short: value_of(c, types[c]).cast("string") for c, short in categories.items()}
    values = {ROWS: F.lit(1.0)} | {m: number_of(m, types[m]) for m in measures}
    cells = measures_long(df, values, keep).groupBy(*keep, "measure", "value").agg(F.count(F.lit(1)).alias("m"))
    return FilterCube(written(cells, "filter-cube"), charts, categories, bool(days))


def filtered_charts(
    cube: FilterCube, start: str | None = None, end: str | None = None, category_column: str | None = None, category: Any = None,
    top: int = C.TOP_CATEGORIES,
) -> DataFrame:
    """``type, measure, category_column, position, label, value`` of every chart under a filter.

    ``start`` and ``end`` are inclusive days of the table's first date column, and ``category``
    is one value of a charted category. Trends keep the periods of the whole chart, weeks from
    Sunday; means are trimmed only for averages, and averages need five values. Cards have
    the labels ``sum, mean, min, max``.
    """
    if category_column is not None and category_column not in cube.categories:
        raise TableError(f"'{category_column}' is not among the charted categories", "UNKNOWN_COLUMN")
    if (start or end) and not cube.dated:
        raise TableError("the table has no dates to filter by", "UNKNOWN_COLUMN")
    cells = cross_filter(cube.cells, "day", start, end, cube.categories.get(category_column), category)
    by_type = lambda kind: [c for c in cube.charts if c["type"] == kind]
    parts = []
    cards = {c["measure_column"]: c["agg_kind"] for c in by_type("summary_card")}
    if cards:
        parts.append(_cards(_of(cells, cards), cards))
    lines = {c["measure_column"]: c["agg_kind"] for c in by_type("line")}
    if lines:
        grouping = by_type("line")[0]["grouping"]
        rows = _of(cells, lines).withColumn("period", dates.period_start(F.col("day"), grouping, "sunday")).where(F.col("period").isNotNull())
        label = dates.period_label(F.col("period"), grouping, "sunday")
        found = _grouped(rows, ["measure", "period"], lines)
        order = Window.partitionBy("measure").orderBy("period")
        parts.append(found.select(
            F.lit("line").alias("type"), "measure", F.lit("").alias("category_column"), F.row_number().over(order).alias("position"),
            label.alias("label"), F.round("value", 2).alias("value"),
        ))
    bars: dict[str, dict[str, str]] = {}
    for c in by_type("bar"):
        bars.setdefault(c["category_column"], {})[c["measure_column"] or ROWS] = c.get("agg_kind", "sum")
    for column, kinds in bars.items():
        rows = _of(cells, kinds).withColumn("label", F.col(cube.categories[column])).where(F.col("label").isNotNull())
        order = Window.partitionBy("measure").orderBy(F.desc("value"), "label")
        ranked = _grouped(rows, ["measure", "label"], kinds).withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
        parts.append(ranked.select(
            F.lit("bar").alias("type"), "measure", F.lit(column).alias("category_column"), "position", "label", F.round("value", 2).alias("value"),
        ))
    drawn = [c["measure_column"] for c in by_type("histogram")]
    if drawn:
        spread = robust.measured_spread(_of(cells, drawn), weight="m")
        parts.append(C.histograms(cells, drawn, spread=spread).select(
            F.lit("histogram").alias("type"), "measure", F.lit("").alias("category_column"), (F.col("bin") + 1).alias("position"), "label",
            F.col("count").cast("double").alias("value"),
        ))
    if not parts:
        raise TableError("the dashboard has no chart that a filter changes", "NO_CHARTS")
    return reduce(DataFrame.unionByName, parts)


def _of(cells: DataFrame, measures) -> DataFrame:
    return cells.where(F.col("measure").isin(*measures))


def _cards(cells: DataFrame, kinds: dict[str, str]) -> DataFrame:
    stats = robust.trimmed_stats(cells, ["measure"], weight="m")
    averages = [m for m, kind in kinds.items() if kind == "average"]
    mean = F.when(F.col("measure").isin(averages), F.col("trimmed_mean")).otherwise(F.col("mean"))
    numbers = {"sum": F.col("total"), "mean": mean, "min": F.col("v_min"), "max": F.col("v_max")}
    pairs = F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("label"), F.round(value, 2).alias("value"))
        for i, (label, value) in enumerate(numbers.items())
    ])
    return stats.select(F.lit("summary_card").alias("type"), "measure", F.lit("").alias("category_column"), F.inline(pairs))


def _grouped(rows: DataFrame, by: list[str], kinds: dict[str, str]) -> DataFrame:
    """``by..., value``: sums, and trimmed means of groups with enough values."""
    averages = [m for m, kind in kinds.items() if kind == "average"]
    sums = rows.where(~F.col("measure").isin(averages)).groupBy(*by).agg(F.sum(F.col("value") * F.col("m")).alias("value"))
    if not averages:
        return sums
    means = robust.trimmed_stats(_of(rows, averages), by, weight="m").where(F.col("n") >= C.MIN_GROUP)
    return sums.unionByName(means.select(*by, F.col("trimmed_mean").alias("value")))
