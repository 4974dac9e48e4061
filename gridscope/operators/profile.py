"""What each column of a table is, decided from its values.

The driver holds one small dictionary per column; rows stay distributed. A profile costs
a handful of aggregates over pruned scans, whatever the number of columns:

1. counts, number parse counts, sums and extremes of every column;
2. date parse counts of the text columns that are not numbers;
3. distinct counts, per family of types, as a two-level aggregate on ``(column, value)``;
4. most frequent values of the low-cardinality text columns;
5. counted values of the measures, and from these quartiles, trimmed means and outlier counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridscope.functions import names
from gridscope.functions.clean import kind_of, number_from_text, number_of, quoted, value_of
from gridscope.functions.dates import date_from_text, date_of
from gridscope.operators import robust
from gridscope.operators.keys import measures_long, narrow_text
from gridscope.session import run_together

GATE = 0.8  # share of values that must parse
MAX_CATEGORIES = 50
MAX_CATEGORY_RATIO = 0.5
TOP_VALUES = 10
# Number types whose values a double holds exactly.
COUNTED_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
BATCH = 100  # columns per aggregate, to keep generated code compilable
HEAD_ROWS = 20  # first rows looked at for each sample asked for
SAMPLE_JOBS = 16  # columns looked up together
# Word pairs that make a text column boolean.
BOOLEAN_PAIRS = [{"yes", "no"}, {"true", "false"}, {"y", "n"}, {"1", "0"}]
COLUMN_TYPES = (
    "date", "numeric_measure", "identifier", "categorical", "boolean", "free_text", "constant", "empty",
)

PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("cardinality", T.LongType()),
    T.StructField("null_fraction", T.DoubleType()),
    T.StructField("type_confidence", T.DoubleType()),
    T.StructField("agg_kind", T.StringType()),
    T.StructField("agg_kind_confident", T.BooleanType()),
    T.StructField("agg_kind_confidence", T.DoubleType()),
    T.StructField("zero_anchor", T.BooleanType()),
    T.StructField("n_extreme_outliers", T.LongType()),
    T.StructField("sum", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("min_date", T.StringType()),
    T.StructField("max_date", T.StringType()),
    T.StructField("top_values", T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("count", T.LongType()),
    ]))),
    T.StructField("value", T.StringType()),
    T.StructField("user_corrected", T.BooleanType()),
    T.StructField("correction_note", T.StringType()),
])


class Profile:
    """Column types and statistics of one table: ``profile.columns[name]["type"]``."""

    def __init__(
        self, df: DataFrame, n_rows: int, columns: dict[str, dict[str, Any]], counts: dict[str, int],
        exact: bool = True,
    ):
        self.df = df
        self.exact = exact  # whether all cardinalities were counted
        self.n_rows = n_rows
        self.columns = columns
        self.counts = counts  # non-null values per column

    def of_type(self, *types: str) -> list[str]:
        return [c for c, info in self.columns.items() if info["type"] in types]

    def spreads(self, measures: Iterable[str]) -> robust.Quantiles:
        """Counts, extremes and quartiles of measures, as found while profiling."""
        measures = list(measures)
        told: dict[int, tuple[DataFrame, list[str]]] = {}  # an override has its measure counted anew
        for m in measures:
            table = self.columns[m]["counted"]
            told.setdefault(id(table), (table, []))[1].append(m)
        counted = reduce(DataFrame.unionByName, [t.where(F.col("measure").isin(held)) for t, held in told.values()])
        return robust.known_spread(self.df.sparkSession, {m: self.columns[m]["spread"] for m in measures}, counted)

    def to_df(self, spark: SparkSession | None = None) -> DataFrame:
        """One row per column."""
        rows = [
            tuple(info.get(f.name) if f.name not in ("position", "column") else (i if f.name == "position" else name)
                  for f in PROFILE_SCHEMA.fields)
            for i, (name, info) in enumerate(self.columns.items())
        ]
        return (spark or self.df.sparkSession).createDataFrame(rows, PROFILE_SCHEMA)


def profile(df: DataFrame, distinct: str = "exact") -> Profile:
    """Type every column of ``df`` and compute its statistics.

    ``distinct="estimate"`` sketches cardinalities and counts exactly only the columns
    whose estimate is small or lies near a ratio that decides something.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    readable = [c for c in df.columns if kind_of(types[c]) != "other"]
    basics = first_pass(df, df.columns)
    n_rows = basics.pop("")["n_rows"]
    filled = [c for c in readable if basics[c]["n"] > 0]
    numeric = [
        c for c in filled
        if kind_of(types[c]) in ("number", "text") and basics[c]["n_num"] / basics[c]["n"] >= GATE
    ]
    measures = [c for c in numeric if not names.names_identifier(c)]
    others = [c for c in filled if c not in set(numeric)]
    # the counted values of such a measure also tell how many there are
    told = [c for c in measures if isinstance(types[c], COUNTED_TYPES)] if distinct != "estimate" else []

    def count_distinct(wanted: list[str]) -> dict[str, int]:
        return estimated_distincts(df, wanted, basics) if distinct == "estimate" else distinct_counts(df, wanted)

    dates, stats, distincts = run_together(
        df.sparkSession,
        lambda: date_pass(df, [c for c in others if kind_of(types[c]) in ("text", "date")]),
        lambda: measure_stats(df, measures, basics),
        lambda: count_distinct([c for c in readable if c not in told]),
    )
    distincts.update({c: stats[c]["n_values"] for c in told})
    # infinite values are no measures, but values they are
    distincts.update(count_distinct([c for c in told if stats[c]["spread"]["n"] != basics[c]["n"]]))

    columns: dict[str, dict[str, Any]] = {}
    open_text = []
    for c in df.columns:
        if c not in distincts:
            columns[c] = {"type": "unsupported"}
            continue
        n = basics[c]["n"]
        if n == 0:
            columns[c] = {"type": "empty", "cardinality": 0, "null_fraction": 1.0, "type_confidence": 1.0}
            continue
        info: dict[str, Any] = {
            "type": None,
            "cardinality": distincts[c],
            "null_fraction": round(1 - n / n_rows, 3),
        }
        columns[c] = info
        if c in numeric:
            info["type_confidence"] = gate_confidence(basics[c]["n_num"] / n)
            if c not in stats:
                info["type"] = "identifier"
            else:
                kind, sure, confidence = names.agg_kind_of(c)
                info.update(
                    type="numeric_measure", agg_kind=kind, agg_kind_confident=sure,
                    agg_kind_confidence=confidence, **stats[c],
                )
        elif c in dates and dates[c]["n_date"] / n >= GATE:
            info.update(
                type="date",
                type_confidence=gate_confidence(dates[c]["n_date"] / n),
                min_date=str(dates[c]["min_date"]),
                max_date=str(dates[c]["max_date"]),
            )
        else:
            open_text.append(c)

    few = [c for c in open_text if columns[c]["cardinality"] <= MAX_CATEGORIES]
    tops = top_values(df, few)
    for c in open_text:
        columns[c].update(text_type(kind_of(types[c]), basics[c]["n"], columns[c]["cardinality"], tops.get(c, [])))
    return Profile(df, n_rows, columns, {c: basics[c]["n"] for c in df.columns}, exact=distinct != "estimate")


def text_type(kind: str, n: int, cardinality: int, top: list[dict[str, Any]]) -> dict[str, Any]:
    """Type of a non-numeric, non-date column from its counts and frequent values."""
    if cardinality == 1:
        return {"type": "constant", "type_confidence": 1.0, "value": top[0]["value"]}
    words = {v["value"].lower() for v in top}
    if kind == "bool" or (cardinality <= 2 and any(words <= pair for pair in BOOLEAN_PAIRS)):
        return {"type": "boolean", "type_confidence": 0.9}
    ratio = cardinality / n
    confidence = round(min(1.0, 0.5 + abs(ratio - 0.5)), 3)
    if cardinality <= MAX_CATEGORIES and ratio <= MAX_CATEGORY_RATIO:
        return {"type": "categorical", "type_confidence": confidence, "top_values": top}
    return {"type": "free_text", "type_confidence": confidence}


def gate_confidence(share: float, gate: float = GATE) -> float:
    """0.5 at the gate, 1.0 when everything parses, linear between."""
    if share >= 1.0:
        return 1.0
    return round(0.5 + max(0.0, share - gate) / (1.0 - gate) * 0.5, 3)


def confidence_tier(confidence: float) -> str:
    if confidence >= 0.9:
        return "high"
    return "medium" if confidence >= 0.7 else "low"


def least_confident_first(prof: Profile) -> DataFrame:
    """Columns with their confidence tier, those worth a look first."""
    c = F.coalesce(F.col("type_confidence"), F.lit(1.0))
    tier = F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")
    return (
        prof.to_df()
        .select("position", "column", "type", c.alias("type_confidence"), tier.alias("tier"))
        .orderBy("type_confidence", "position")
    )


def batches(columns: Iterable[str]) -> Iterable[list[str]]:
    columns = list(columns)
    for start in range(0, len(columns), BATCH):
        yield columns[start:start + BATCH]


def first_pass(df: DataFrame, columns: list[str]) -> dict[str, dict[str, Any]]:
    """Row count (under ``""``) and, per column, ``n``, ``n_num``, ``sum``, ``min``, ``max``.

    Typed columns are aggregated side by side. Text cells are stacked first, so that the
    parsing expression appears once in the plan, however many columns there are.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c in columns if kind_of(types[c]) == "text"]
    typed = [c for c in columns if c not in set(texts)]
    out: dict[str, dict[str, Any]] = {}
    for batch in batches(typed) if typed or not texts else []:
        inputs, aggs = [], [F.count("*").alias("n_rows")]
        for i, c in enumerate(batch):
            inputs.append(value_of(c, types[c]).alias(f"v{i}"))
            aggs.append(F.count(f"v{i}").alias(f"n{i}"))
            if kind_of(types[c]) == "number":
                inputs.append(number_of(c, types[c]).alias(f"x{i}"))
                aggs += [F.sum(f"x{i}").alias(f"s{i}"), F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}")]
        row = df.select(*inputs).agg(*aggs).first().asDict()
        out[""] = {"n_rows": row["n_rows"]}
        for i, c in enumerate(batch):
            out[c] = {
                "n": row[f"n{i}"], "n_num": row[f"n{i}"] if f"s{i}" in row else 0,
                "sum": row.get(f"s{i}"), "min": row.get(f"lo{i}"), "max": row.get(f"hi{i}"),
            }
    if texts:
        cells = {c: F.col(quoted(c)) for c in texts}
        # one more cell per row counts the rows
        stacked = measures_long(df, cells if typed else {"": F.lit("1"), **cells})
        sized = [c for c in texts if names.names_size(c)]
        number = number_from_text(F.col("value"))
        if sized:
            plain = number_from_text(F.col("value"), shorthand=False)
            number = F.when(F.col("measure").isin(sized), plain).otherwise(number)
        found = stacked.select("measure", number.alias("x")).groupBy("measure").agg(
            F.count("*").alias("n"), F.count("x").alias("n_num"), F.sum("x").alias("sum"),
            F.min("x").alias("min"), F.max("x").alias("max"),
        )
        rows = {r["measure"]: r.asDict() for r in found.collect()}
        if not typed:
            out[""] = {"n_rows": rows.pop("", {"n": 0})["n"]}
        nothing = {"n": 0, "n_num": 0, "sum": None, "min": None, "max": None}
        out.update({c: rows.get(c, nothing) for c in texts})
    return out


def date_pass(df: DataFrame, columns: list[str]) -> dict[str, dict[str, Any]]:
    """Per column: number of values that are dates, first and last day."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    texts = {c: F.col(quoted(c)) for c in columns if kind_of(types[c]) == "text"}
    typed = {c: F.to_date(date_of(c, types[c])) for c in columns if c not in texts}
    if texts:
        day = F.to_date(date_from_text(F.col("value"))).alias("value")
        parts.append(measures_long(df, texts).select("measure", day))
    if typed:
        parts.append(measures_long(df, typed))
    if not parts:
        return {}
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = rows.groupBy("measure").agg(
        F.count("value").alias("n_date"), F.min("value").alias("min_date"), F.max("value").alias("max_date")
    )
    seen = {r["measure"]: r.asDict() for r in found.collect()}
    return {c: seen.get(c, {"n_date": 0, "min_date": None, "max_date": None}) for c in columns}


def _families(df: DataFrame, columns: list[str]) -> list[dict[str, Column]]:
    """Columns grouped by a common comparable type, so that one aggregate counts them all."""
    types = {f.name: f.dataType for f in df.schema.fields}
    families: dict[str, dict[str, Column]] = {}
    for c in columns:
        dtype, value = types[c], value_of(c, types[c])
        if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            families.setdefault("integer", {})[c] = value.cast("long")
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            families.setdefault("double", {})[c] = value.cast("double")
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            families.setdefault(dtype.typeName(), {})[c] = value
        elif kind_of(dtype) == "text":
            families.setdefault("text", {})[c] = value
        else:
            families.setdefault("other", {})[c] = value.cast("string")
    return [
        {c: members[c] for c in batch} for members in families.values() for batch in batches(members)
    ]


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact number of distinct non-null values per column.

    Values are first made unique per ``(column, value)``, which spreads every column over
    all tasks and collapses hot values before the shuffle; then counted per column.
    """
    if not columns:
        return {}
    parts = []
    for members in _families(df, columns):
        cells = measures_long(df, members)
        if cells.schema["value"].dataType == T.StringType():
            cells = cells.select("measure", narrow_text(F.col("value")).alias("value"))
        parts.append(cells.distinct().groupBy("measure").agg(F.count("*").alias("n")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    found = {r["measure"]: r["n"] for r in merged.collect()}
    return {c: found.get(c, 0) for c in columns}


def estimated_distincts(
    df: DataFrame, columns: list[str], basics: Mapping[str, Mapping[str, Any]]
) -> dict[str, int]:
    """Sketched cardinalities; counted ones where they decide a type or the entity column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, int] = {}
    for batch in batches(columns):
        row = df.select(*[value_of(c, types[c]).alias(f"v{i}") for i, c in enumerate(batch)]).agg(
            *[F.approx_count_distinct(f"v{i}", 0.02).alias(f"v{i}") for i in range(len(batch))]
        ).first()
        out.update({c: row[f"v{i}"] for i, c in enumerate(batch)})

    def decides(c: str) -> bool:
        n = basics[c]["n"]
        if out[c] <= 20 * MAX_CATEGORIES:
            return True
        is_measure = basics[c]["n_num"] >= GATE * n and not names.names_identifier(c)
        return not is_measure and out[c] >= 0.6 * n

    out.update(distinct_counts(df, [c for c in columns if decides(c)]))
    return out


def top_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> dict[str, list[dict[str, Any]]]:
    """The ``k`` most frequent values per column, ties by value.

    Only ``k`` rows per column reach the driver; the rank filter is applied in every task
    before the ranking shuffle.
    """
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = (
        measures_long(df, {c: value_of(c, types[c]).cast("string") for c in columns})
        .groupBy("measure", "value").agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("measure").orderBy(F.desc("n"), F.asc("value"))
    rows = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).collect()
    out: dict[str, list[dict[str, Any]]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r["measure"]].append({"value": r["value"], "count": r["n"]})
    return out


def measure_stats(
    df: DataFrame, columns: list[str], basics: Mapping[str, Mapping[str, Any]]
) -> dict[str, dict[str, Any]]:
    """Sum, trimmed mean, extremes, outlier count and zero anchor of numeric columns."""
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = measures_long(df, {c: number_of(c, types[c]) for c in columns})
    known = (len(columns), max(basics[c]["n_num"] for c in columns))
    spread = robust.spread(rows, ["measure"], known)
    found = robust.stats_of(spread, ["measure"]).withColumn("anchor", robust.zero_anchor())
    out = {}
    for r in found.collect():
        c = r["measure"]
        out[c] = {
            "zero_anchor": r["anchor"],
            "n_extreme_outliers": r["n_extreme"],
            "sum": round(basics[c]["sum"], 2),
            "mean": round(r["trimmed_mean"], 2),
            "min": round(basics[c]["min"], 2),
            "max": round(basics[c]["max"], 2),
            "spread": {k: r[k] for k in ("n", "v_min", "v_max", "q1", "q2", "q3")},
            "counted": spread.counted,
            "n_values": r["n_values"],
        }
    return out


def _as_text(df: DataFrame, c: str) -> Column:
    """A cell as text; null where it holds no value."""
    dtype = df.schema[c].dataType
    if kind_of(dtype) != "other":
        return value_of(c, dtype).cast("string")
    return F.when(F.col(quoted(c)).isNotNull(), F.to_json(F.struct(quoted(c))))


def column_samples(df: DataFrame, n: int = 5) -> DataFrame:
    """``column, samples``: the first ``n`` non-null values of each column as text.

    The first rows serve all columns in one job. Only a column with too few values among them
    is looked up alone, reading partitions one after the other until it has its values.
    """
    texts = [_as_text(df, c) for c in df.columns]
    head = df.select(*[t.alias(f"v{i}") for i, t in enumerate(texts)]).take(HEAD_ROWS * n)
    found = [[r[i] for r in head if r[i] is not None][:n] for i in range(len(texts))]
    # a head shorter than asked for is the whole table
    short = [i for i, values in enumerate(found) if len(values) < n and len(head) == HEAD_ROWS * n]

    def first_values(i: int) -> list[str]:
        return [r.v for r in df.select(texts[i].alias("v")).where(F.col("v").isNotNull()).take(n)]

    for start in range(0, len(short), SAMPLE_JOBS):
        some = short[start:start + SAMPLE_JOBS]
        for i, values in zip(some, run_together(df.sparkSession, *[partial(first_values, i) for i in some])):
            found[i] = values
    return df.sparkSession.createDataFrame(list(zip(df.columns, found)), "column string, samples array<string>")


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows with every cell as text."""
    return df.limit(n).select(*[_as_text(df, c).alias(c) for c in df.columns])
