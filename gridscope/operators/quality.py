"""Data quality: missing values, repeated rows, repeated entities, outliers."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridscope.functions.clean import kind_of, number_of, quoted, value_of
from gridscope.operators import robust
from gridscope.operators.keys import attach, measures_long, narrow_text, row_key
from gridscope.operators.profile import Profile, batches
from gridscope.operators.quantiles import Quantiles
from gridscope.session import run_together

MIN_VALUES = 5
EXAMPLES = 5
ENTITY_RATIO = 0.7


def missing_values(df: DataFrame) -> DataFrame:
    """``column, n_missing, pct`` for columns that miss something. No shuffle of rows; one scan per batch of columns."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def counted(columns: list[str]) -> DataFrame:
        counts = df.agg(
            F.count("*").alias("n_rows"), *[F.count_if(value_of(c, types[c]).isNull()).alias(f"m{i}") for i, c in enumerate(columns)],
        )
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(columns)])
        return counts.select("n_rows", F.inline(cells))

    return (
        reduce(DataFrame.unionByName, map(counted, batches(df.columns)))
        .where(F.col("n_missing") > 0)
        .select("column", "n_missing", F.round(F.col("n_missing") * 100 / F.col("n_rows"), 1).alias("pct"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``n_rows, duplicate_rows``: rows beyond the first of each set of equal rows.

    Rows are compared through a fixed-size digest, counted map-side, so neither wide rows
    nor one row repeated very often makes the shuffle large.
    """
    copies = df.select(row_key(df).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def entity_column(prof: Profile) -> str | None:
    """The most unique identifier or text column, when at least 70 % unique."""
    best, best_ratio = None, 0.0
    for c in prof.of_type("identifier", "free_text"):
        n = prof.counts[c]
        ratio = prof.columns[c]["cardinality"] / n if n else 0.0
        if ratio >= ENTITY_RATIO and ratio > best_ratio:
            best, best_ratio = c, ratio
    return best


def _entity_key(df: DataFrame, column: str) -> Column:
    dtype = df.schema[column].dataType
    value = value_of(column, dtype)
    return narrow_text(value) if kind_of(dtype) == "text" else value


def repeated_entities(df: DataFrame, column: str) -> DataFrame:
    """``key, n``: values of ``column`` on two or more rows that are not all equal.

    Equal rows are merged first, on ``(key, row digest)``, so the rows of one very common
    value are spread over all tasks before they meet per key.
    """
    rows = df.where(value_of(column, df.schema[column].dataType).isNotNull())
    versions = (
        rows.select(_entity_key(df, column).alias("key"), row_key(df).alias("row"))
        .groupBy("key", "row").agg(F.count("*").alias("n"))
    )
    return (
        versions.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("versions"))
        .where((F.col("n") >= 2) & (F.col("versions") > 1))
        .select("key", "n")
    )


def entity_summary(df: DataFrame, column: str) -> DataFrame:
    """``n_repeated_values, n_affected_rows``."""
    return repeated_entities(df, column).agg(
        F.count("*").alias("n_repeated_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_affected_rows")
    )


def entity_examples(df: DataFrame, column: str, k: int = EXAMPLES) -> DataFrame:
    """``value, n`` of the ``k`` most repeated entities, ties by key.

    Ranking uses narrow keys; the full values of the ``k`` winners are fetched afterwards.
    """
    top = repeated_entities(df, column).orderBy(F.desc("n"), F.asc("key")).limit(k)
    text = F.col(quoted(column)).cast("string")
    values = df.select(_entity_key(df, column).alias("key"), text.alias("value"))
    return (
        values.join(F.broadcast(top), "key")  # at most k rows
        .groupBy("key").agg(F.any_value("value").alias("value"), F.any_value("n").alias("n"))
        .orderBy(F.desc("n"), F.asc("key")).select("value", "n")
    )


def _measure_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return measures_long(df, {c: number_of(c, types[c]) for c in columns})


def outlier_report(
    df: DataFrame, columns: list[str], spread: Quantiles | None = None
) -> DataFrame:
    """``measure, n_outliers, pct, lower, upper`` beyond 1.5 IQR, for measures that have some."""
    found = spread or robust.measured_spread(_measure_rows(df, columns))
    usable = found.frame.where((F.col("n") >= MIN_VALUES) & (F.col("q3") != F.col("q1")))
    return (
        attach(found.counted, usable, ["measure"], found.groups)
        .groupBy("measure")
        .agg(
            F.coalesce(F.sum(F.when(robust.outside(robust.FLAG), F.col("m"))), F.lit(0)).alias("n_outliers"),
            F.any_value("n").alias("n"),
            F.any_value(robust.fence("low", robust.FLAG)).alias("lo"),
            F.any_value(robust.fence("high", robust.FLAG)).alias("hi"),
        )
        .where(F.col("n_outliers") > 0)
        .select(
            "measure", "n_outliers",
            F.round(F.col("n_outliers") * 100 / F.col("n"), 1).alias("pct"),
            F.round("lo", 2).alias("lower"), F.round("hi", 2).alias("upper"),
        )
    )


def outlier_examples(
    df: DataFrame, columns: list[str], k: int = EXAMPLES,
    spread: Quantiles | None = None,
) -> DataFrame:
    """``measure, rank, value``: the ``k`` outliers farthest from the median, ties by value."""
    found = spread or robust.measured_spread(_measure_rows(df, columns))
    usable = found.frame.where((F.col("n") >= MIN_VALUES) & (F.col("q3") != F.col("q1")))
    far = attach(found.counted, usable, ["measure"], found.groups).where(robust.outside(robust.FLAG))
    order = Window.partitionBy("measure").orderBy(F.desc(F.abs(F.col("value") - F.col("q2"))), F.asc("value"))
    each = F.explode(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(k)).cast("int")))  # a value is shown as often as it occurs
    return (
        far.withColumn("_copy", each).withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("measure", "rank", F.round("value", 2).alias("value"))
    )


def quality_report(df: DataFrame, prof: Profile) -> dict[str, Any]:
    """The whole report as one dictionary of small results."""
    n_rows = prof.n_rows
    missing = {}
    for c in df.columns:
        n_missing = n_rows - prof.counts[c]
        if n_missing > 0:
            missing[c] = {"count": n_missing, "pct": round(n_missing / n_rows * 100, 1)}
    measures = prof.of_type("numeric_measure")

    def outliers_of() -> dict[str, Any]:
        if not measures:
            return {}
        report = outlier_report(df, measures, spread=prof.spreads(measures)).collect()
        found = {r["measure"]: {
            "count": r["n_outliers"], "pct": r["pct"], "bounds": {"lower": r["lower"], "upper": r["upper"]}, "examples": [],
        } for r in report}
        if found:
            examples = outlier_examples(df, list(found), spread=prof.spreads(found))
            for r in examples.orderBy("measure", "rank").collect():
                found[r["measure"]]["examples"].append(r["value"])
        return found

    def entities_of() -> dict[str, Any]:
        column = entity_column(prof)
        # all values unique: nothing can repeat, no need to look
        if not column or (prof.exact and prof.columns[column]["cardinality"] == prof.counts[column]):
            return {}
        summary = entity_summary(df, column).first()
        if not summary["n_repeated_values"]:
            return {}
        return {column: {
            "n_repeated_values": summary["n_repeated_values"],
            "n_affected_rows": summary["n_affected_rows"],
            "examples": [{"value": r["value"], "count": r["n"]} for r in entity_examples(df, column).collect()],
        }}

    outliers, entities, duplicates = run_together(
        df.sparkSession, outliers_of, entities_of, lambda: duplicate_rows(df).first()["duplicate_rows"]
    )
    return {
        "n_rows": n_rows,
        "missing_values": missing,
        "duplicate_rows": duplicates,
        "outliers": outliers,
        "duplicate_entities": entities,
    }


def is_clean(report: dict[str, Any]) -> bool:
    """No missing values, repeated rows, outliers or repeated entities."""
    return not (
        report["missing_values"] or report["duplicate_rows"] or report["outliers"] or report["duplicate_entities"]
    )
