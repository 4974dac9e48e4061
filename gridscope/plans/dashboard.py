"""Choosing and computing a dashboard for any table.

What to chart is decided on the driver from the profile, one small dictionary per column.
The chosen charts are then computed in a few fused jobs over whole data; only their points
come back. Charts are plain dictionaries with a ``type`` of ``summary_card``, ``line``,
``bar``, ``histogram`` or ``pie``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession, types as T

from gridscope.functions.dates import pick_grouping
from gridscope.operators import charts as C, statements as S
from gridscope.operators.overrides import apply_overrides, apply_review, labels_for
from gridscope.operators.profile import Profile, profile, top_values
from gridscope.operators.quality import quality_report
from gridscope.session import run_together
from gridscope.sources.records import typed_records

# How many charts of each kind a dashboard may hold.
MAX_CARDS = 6
MAX_TRENDS = 2
MAX_CATEGORIES = 4
MAX_MEASURES_PER_CATEGORY = 3
MAX_BARS = 10
MAX_HISTOGRAMS = 3
MAX_PIES = 2
MAX_PIE_CARDINALITY = 10
MIN_PERIODS = 7
PERIOD_NAMES = {"D": "Day", "W": "Week", "M": "Month"}

CHART_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("category_column", T.StringType()),
    T.StructField("date_column", T.StringType()),
    T.StructField("measure_column", T.StringType()),
    T.StructField("agg_kind", T.StringType()),
    T.StructField("grouping", T.StringType()),
    T.StructField("n_points", T.IntegerType()),
    T.StructField("stat_summary", T.StringType()),
    T.StructField("warning", T.StringType()),
])


@dataclass
class Analysis:
    """Everything known about one table."""

    profile: Profile
    labels: dict[str, str]
    quality: dict[str, Any]
    overview: dict[str, Any]
    charts: list[dict[str, Any]]
    records: DataFrame
    about: str = ""
    corrected: list[str] = field(default_factory=list)
    notes: dict[str, str] = field(default_factory=dict)

    def charts_df(self) -> DataFrame:
        """One row per chart."""
        return charts_frame(self.profile.df.sparkSession, self.charts)


def charts_frame(spark: SparkSession, charts: list[dict[str, Any]]) -> DataFrame:
    rows = []
    for i, c in enumerate(charts):
        points = c.get("points") or c.get("bars") or c.get("bins") or c.get("slices") or []
        rows.append((
            i, c["type"], c["title"], c.get("category_column"), c.get("date_column"), c.get("measure_column"),
            c.get("agg_kind"), c.get("grouping"), len(points), c.get("stat_summary"), c.get("warning"),
        ))
    return spark.createDataFrame(rows, CHART_SCHEMA)


def analyze(
    df: DataFrame,
    overrides: Mapping[str, Mapping[str, Any]] | None = None,
    reviewed: Mapping[str, Mapping[str, Any]] | None = None,
    about: str = "",
    quality_first: bool = False,
    distinct: str = "exact",
) -> Analysis:
    """Profile, quality, charts and records of ``df``.

    ``reviewed`` may hold ``{column: {label, agg_kind}}`` from a reviewer and ``about`` a text
    on the table; ``overrides`` hold the user's own ``{column: {type, agg_kind}}`` and win.
    Quality is judged on the final types, or before both with ``quality_first``.
    """
    inferred = profile(df, distinct=distinct)
    final = apply_overrides(apply_review(inferred, reviewed or {}), overrides or {})
    labels = labels_for(final, reviewed)
    quality, charts = run_together(
        df.sparkSession,
        lambda: quality_report(df, inferred if quality_first else final),
        lambda: build_charts(final, labels),
    )
    warn_inflated(charts, quality, labels)
    return Analysis(
        profile=final,
        labels=labels,
        quality=quality,
        overview=overview_of(final),
        charts=charts,
        records=typed_records(final),
        about=guard_row_count(about, final.n_rows),
        corrected=[c for c, info in final.columns.items() if info.get("user_corrected")],
        notes={c: info["correction_note"] for c, info in final.columns.items() if info.get("correction_note")},
    )


def overview_of(prof: Profile) -> dict[str, Any]:
    """How many measures, categories and dates there are, and the range of the first date."""
    days = prof.of_type("date")
    first = prof.columns[days[0]] if days else None
    return {
        "n_numeric": len(prof.of_type("numeric_measure")),
        "n_categorical": len(prof.of_type("categorical")),
        "n_date": len(days),
        "date_range": {"min": first["min_date"], "max": first["max_date"]} if first else None,
    }


def build_charts(prof: Profile, labels: Mapping[str, str]) -> list[dict[str, Any]]:
    """The charts of a dashboard, in display order."""
    def bars_and_pies() -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
        bars = _bars(prof, labels)
        return bars, _pies(prof, labels, {b["category_column"] for b in bars})

    lines, (bars, pies), histograms = run_together(
        prof.df.sparkSession, lambda: _lines(prof, labels), bars_and_pies, lambda: _histograms(prof, labels)
    )
    return [*_cards(prof, labels), *lines, *bars, *histograms, *pies]


def _outlier_note(prof: Profile, labels: Mapping[str, str], measure: str) -> dict[str, str]:
    info = prof.columns[measure]
    n = info.get("n_extreme_outliers", 0)
    if info["agg_kind"] != "average" or not n:
        return {}
    noun = "value is" if n == 1 else "values are"
    return {"warning": f"{n} extreme {noun} left out of the averages of {labels[measure]}."}


def _titled(kind: str, label: str, rest: str) -> str:
    return f"{'Average ' if kind == 'average' else ''}{label} {rest}"


def _cards(prof: Profile, labels: Mapping[str, str]) -> list[dict[str, Any]]:
    cards = []
    for m in prof.of_type("numeric_measure")[:MAX_CARDS]:
        info = prof.columns[m]
        cards.append({
            "type": "summary_card", "title": labels[m], "measure_column": m,
            **{k: info[k] for k in ("agg_kind", "zero_anchor", "sum", "mean", "min", "max")},
            **_outlier_note(prof, labels, m),
        })
    return cards


def _lines(prof: Profile, labels: Mapping[str, str]) -> list[dict[str, Any]]:
    days, measures = prof.of_type("date"), prof.of_type("numeric_measure")[:MAX_TRENDS]
    if not days or not measures:
        return []
    day, info = days[0], prof.columns[days[0]]
    if C.distinct_days(prof.df, day, stop_at=MIN_PERIODS) < MIN_PERIODS:
        return []
    grouping = pick_grouping(date.fromisoformat(info["min_date"]), date.fromisoformat(info["max_date"]))
    kinds = [(m, prof.columns[m]["agg_kind"]) for m in measures]
    found = C.trends(prof.df, day, kinds, grouping)
    rows = found.collect()  # at most one row per period and measure
    long_enough = {m for m in measures if sum(r["measure"] == m for r in rows) >= MIN_PERIODS}
    if not long_enough:
        return []
    spark = prof.df.sparkSession
    facts = {f["measure"]: f for f in S.trend_statement(spark.createDataFrame(rows, found.schema), ["measure"]).collect()}
    out = []
    for m, kind in kinds:
        if m in long_enough:
            f = facts[m].asDict()
            out.append({
                "type": "line", "title": _titled(kind, labels[m], "over time"), "x_label": PERIOD_NAMES[grouping],
                "date_column": day, "measure_column": m, "agg_kind": kind, "grouping": grouping,
                "zero_anchor": prof.columns[m]["zero_anchor"],
                "points": [{"period": r["period"], "value": r["value"]} for r in rows if r["measure"] == m],
                "summary": f, "stat_summary": f["stat_summary"],
                **_outlier_note(prof, labels, m),
            })
    return out


def _bars(prof: Profile, labels: Mapping[str, str]) -> list[dict[str, Any]]:
    categories = prof.of_type("categorical")[:MAX_CATEGORIES]
    measures = prof.of_type("numeric_measure")[:MAX_MEASURES_PER_CATEGORY]
    if not categories:
        return []
    points: dict[tuple[str, str | None], list[dict[str, Any]]] = {}
    if measures:
        pairs = [(c, m, prof.columns[m]["agg_kind"]) for c, m in product(categories, measures)]
        found = C.breakdowns(prof.df, pairs)
        for r in sorted(found.collect(), key=lambda r: r["rank"]):
            points.setdefault((r["category_column"], r["measure"]), []).append(
                {"category": r["category"], "value": r["value"]}
            )
    else:
        for c, top in top_values(prof.df, categories, C.TOP_CATEGORIES).items():
            points[c, None] = [{"category": v["value"], "value": float(v["count"])} for v in top]
    rows = [(c, m or "", p["category"], p["value"]) for (c, m), bars in points.items() for p in bars]
    if not rows:
        return []
    flat = prof.df.sparkSession.createDataFrame(rows, "c string, m string, category string, value double")
    facts = {(f["c"], f["m"]): f.asDict() for f in S.bar_statement(flat, ["c", "m"]).collect()}
    out = []
    for c, m in product(categories, measures or [None]):
        if (c, m) not in points or len(out) == MAX_BARS:
            continue
        f = facts[c, m or ""]
        chart = {
            "type": "bar", "category_column": c, "measure_column": m, "bars": points[c, m],
            "summary": f, "stat_summary": f["stat_summary"],
        }
        if m is None:
            chart["title"] = f"Count by {labels[c]}"
        else:
            kind = prof.columns[m]["agg_kind"]
            chart.update(
                title=_titled(kind, labels[m], f"by {labels[c]}"), agg_kind=kind,
                zero_anchor=prof.columns[m]["zero_anchor"], **_outlier_note(prof, labels, m),
            )
        out.append(chart)
    return out


def _histograms(prof: Profile, labels: Mapping[str, str]) -> list[dict[str, Any]]:
    measures = prof.of_type("numeric_measure")[:MAX_HISTOGRAMS]
    if not measures:
        return []
    found = C.histograms(prof.df, measures, spread=prof.spreads(measures))
    rows = sorted(found.collect(), key=lambda r: r["bin"])
    flat = prof.df.sparkSession.createDataFrame(rows, found.schema)
    facts = {f["measure"]: f for f in S.histogram_statement(flat).collect()}
    out = []
    for m in measures:
        bins = [r for r in rows if r["measure"] == m]
        chart = {
            "type": "histogram", "title": f"Distribution of {labels[m]}", "measure_column": m,
            "bins": [{"bin": r["label"], "count": r["count"]} for r in bins],
            "stat_summary": facts[m]["stat_summary"],
        }
        if bins[0]["trimmed"]:
            n = prof.columns[m]["n_extreme_outliers"]
            chart["warning"] = f"{n} extreme {'value sits' if n == 1 else 'values sit'} in the outer bins."
        out.append(chart)
    return out


def pie_columns(prof: Profile, used_in_bars: set[str]) -> list[str]:
    """Low-cardinality categories, those without bars first."""
    few = [c for c in prof.of_type("categorical") if prof.columns[c]["cardinality"] <= MAX_PIE_CARDINALITY]
    return sorted(few, key=lambda c: c in used_in_bars)[:MAX_PIES]


def _pies(prof: Profile, labels: Mapping[str, str], used_in_bars: set[str]) -> list[dict[str, Any]]:
    chosen = pie_columns(prof, used_in_bars)
    rows = []
    for c, top in top_values(prof.df, chosen, C.PIE_SLICES).items():
        total = prof.counts[c]
        if prof.columns[c]["cardinality"] > C.PIE_SLICES:
            top = top[:C.PIE_SLICES - 1]
            top.append({"value": "Other", "count": total - sum(v["count"] for v in top)})
        rows += [(c, i + 1, v["value"], v["count"], total) for i, v in enumerate(top)]
    if not rows:
        return []
    flat = prof.df.sparkSession.createDataFrame(rows, "c string, rank int, category string, value long, total long")
    facts = {f["c"]: f["stat_summary"] for f in S.proportion_statement(flat, by=["c"]).collect()}
    return [
        {
            "type": "pie", "title": f"Proportion of {labels[c]}", "category_column": c,
            "slices": [{"category": r[2], "value": r[3]} for r in rows if r[0] == c], "stat_summary": facts[c],
        }
        for c in chosen
    ]


def warn_inflated(charts: list[dict[str, Any]], quality: Mapping[str, Any], labels: Mapping[str, str]) -> None:
    """Add a warning to every total when entities repeat."""
    for column, found in quality["duplicate_entities"].items():
        text = (
            f"Totals may count something twice: {found['n_affected_rows']} rows repeat a value of "
            f"'{labels[column]}' with differing details."
        )
        for c in charts:
            if c["type"] in ("summary_card", "line", "bar") and c.get("agg_kind") == "sum":
                c["warning"] = f"{c['warning']} {text}" if c.get("warning") else text


def guard_row_count(about: str, n_rows: int) -> str:
    """A supplied description must state the true number of rows; otherwise it is put first."""
    if about and str(n_rows) not in about.replace(",", ""):
        return f"{n_rows:,} rows. {about}"
    return about


def headline(charts: list[dict[str, Any]]) -> dict[str, Any] | None:
    """The card to show first: one named total or revenue, else the largest sum, else the one
    with a trend, else the one with most breakdowns, else the first."""
    cards = [c for c in charts if c["type"] == "summary_card"]
    if not cards:
        return None
    trending = {c["measure_column"] for c in charts if c["type"] == "line"}
    broken_down = [c["measure_column"] for c in charts if c["type"] == "bar"]
    named = [c for c in cards if re.search("total|revenue", c["title"], re.I)]
    if named:
        return named[0]
    sums = [c for c in cards if c["agg_kind"] == "sum"]
    if sums:
        return max(sums, key=lambda c: c["sum"])
    with_trend = [c for c in cards if c["measure_column"] in trending]
    if with_trend:
        return with_trend[0]
    return max(cards, key=lambda c: broken_down.count(c["measure_column"]))


def trend_of(charts: list[dict[str, Any]], measure: str) -> dict[str, Any] | None:
    """The line chart of a measure, if there is one."""
    return next((c for c in charts if c["type"] == "line" and c["measure_column"] == measure), None)


def insights(charts: list[dict[str, Any]], exclude_titles: tuple[str, ...] = ()) -> list[dict[str, str]]:
    """Statements of all charts that have one, in chart order."""
    return [
        {"title": c["title"], "text": c["stat_summary"]}
        for c in charts if c.get("stat_summary") and c["title"] not in exclude_titles
    ]
