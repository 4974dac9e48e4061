"""Registered queries: one per operator, each over whole tables of a data folder.

Every entry takes ``(spark, folder)`` and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridscope.errors import TableError
from gridscope.functions import clean, dates
from gridscope.operators import charts, explore, filters, overrides, quality, robust, roles, statements
from gridscope.operators.keys import measures_long
from gridscope.operators.profile import (
    column_samples, distinct_counts, first_pass, first_rows, least_confident_first, profile,
)
from gridscope.plans import cube, dashboard, kpi, spec
from gridscope.session import scratch_path
from gridscope.sources import delimited, eventlog, records
from gridscope.streaming import usage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def money_text(value: Column) -> Column:
    return value.cast("decimal(12,2)").cast("string")


def holed_customers(spark: SparkSession, folder: str) -> DataFrame:
    """customer with some cells emptied."""
    c = table(spark, folder, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 6 != 2, F.col("c_name")).alias("c_name"),
        F.when(F.col("c_custkey") % 3 != 1, F.col("c_acctbal")).alias("c_acctbal"),
        F.expr("nullif(c_mktsegment, 'MACHINERY')").alias("c_mktsegment"),
    )


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """orders with every column written as text, in several formats and with null tokens."""
    o, key = table(spark, folder, "orders"), F.col("o_orderkey")
    price = money_text(F.col("o_totalprice"))
    return o.select(
        key.cast("string").alias("order_id"),
        F.when(key % 4 == 0, F.concat(F.lit("$"), price)).when(key % 4 == 1, F.concat(price, F.lit("%")))
        .when(key % 50 == 2, F.lit("unknown")).otherwise(price).alias("total_price"),
        F.when(key % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(key % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "MMM d, yyyy")).alias("ordered"),
        F.when(key % 10 == 3, F.lit("N/A")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("filled"),
        F.lit("orders").alias("origin"),
        F.lit("").alias("blank"),
    )


# --- cleaning -------------------------------------------------------------------------

@query
def numeric_clean_currency(spark, folder):
    o, key = table(spark, folder, "orders"), F.col("o_orderkey")
    price = money_text(F.col("o_totalprice"))
    text = (
        F.when(key % 7 == 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
        .when(key % 7 == 1, F.concat(price, F.lit("%")))
        .when(key % 7 == 2, F.concat(price, F.lit("K")))
        .when(key % 7 == 3, F.concat(price, F.lit(" m")))
        .when(key % 7 == 4, F.concat(F.lit("€"), price))
        .when(key % 7 == 5, F.concat(price, F.lit(" USD")))
        .otherwise(price)
    )
    cells = o.select(key, text.alias("amount"), text.alias("disk_size"))
    return cells.select(
        "o_orderkey",
        F.round(clean.number_of("amount", cells.schema["amount"].dataType), 2).alias("amount"),
        F.round(clean.number_of("disk_size", cells.schema["disk_size"].dataType), 2).alias("disk_size"),
    )


@query
def date_parse_mixed(spark, folder):
    o, key, d = table(spark, folder, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 6 == 0, F.date_format(d, "MM/dd/yy")).when(key % 6 == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(key % 6 == 2, F.date_format(d, "MMM dd, yyyy")).when(key % 6 == 3, F.date_format(d, "dd-MMM-yy"))
        .when(key % 6 == 4, F.date_format(d, "MM.dd.yyyy")).otherwise(F.lit("unknown"))
    )
    return o.select("o_orderkey", F.to_date(dates.date_from_text(text)).cast("string").alias("day"))


@query
def null_tokens(spark, folder):
    e, key = table(spark, folder, "events"), F.col("event_id")
    cell = (
        F.when(key % 11 == 0, F.lit("N/A")).when(key % 11 == 1, F.lit("")).when(key % 11 == 2, F.lit("None"))
        .when(key % 11 == 3, F.lit("-")).when(key % 11 == 4, F.lit("unknown")).otherwise(F.col("event_type"))
    )
    return e.select(clean.null_tokens(cell).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


@query
def truth_words(spark, folder):
    lab = table(spark, folder, "labels")
    word = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 2 == 0, " Yes").otherwise("TRUE")).otherwise(
        F.when(F.col("toxic") == 1, "maybe").otherwise("n"))
    return lab.select(clean.truth_of(word).alias("truth")).groupBy("truth").agg(F.count("*").alias("n"))


# --- column profile -------------------------------------------------------------------

@query
def profile_counts(spark, folder):
    df = holed_customers(spark, folder)
    basics, distincts = first_pass(df, df.columns), distinct_counts(df, df.columns)
    n_rows = basics[""]["n_rows"]
    rows = [(c, basics[c]["n"], n_rows - basics[c]["n"], distincts[c]) for c in df.columns]
    return spark.createDataFrame(rows, "column_name string, n long, n_null long, n_distinct long")


def _types_of(df: DataFrame, **options) -> DataFrame:
    return profile(df, **options).to_df().select(
        F.col("column").alias("column_name"), F.col("type").alias("column_type"), "cardinality", "null_fraction",
        "type_confidence", "agg_kind",
    )


@query
def profile_types(spark, folder):
    return _types_of(table(spark, folder, "part"))


@query
def profile_types_estimated(spark, folder):
    return _types_of(table(spark, folder, "part"), distinct="estimate").select("column_name", "column_type")


@query
def profile_text_columns(spark, folder):
    df = messy_orders(spark, folder)
    cells = df.select(*[clean.null_tokens(F.col(c)).alias(c) for c in df.columns])
    return profile(cells).to_df().select(
        F.col("column").alias("column_name"), F.col("type").alias("column_type"), "null_fraction", "agg_kind",
        "sum", "min_date", "max_date",
    )


@query
def profile_measure_stats(spark, folder):
    prof = profile(table(spark, folder, "lineitem").select(*LINE_MEASURES)).to_df()
    return prof.select(
        F.col("column").alias("column_name"), "sum", "mean", "min", "max", "n_extreme_outliers", "zero_anchor"
    )


@query
def profile_top_values(spark, folder):
    prof = profile(table(spark, folder, "part").select("p_brand", "p_type")).to_df()
    return prof.select(F.col("column").alias("column_name"), F.posexplode("top_values")).select(
        "column_name", F.col("pos").alias("rank"), F.col("col.value").alias("value"), F.col("col.count").alias("n")
    )


@query
def confidence_tiers(spark, folder):
    found = least_confident_first(profile(table(spark, folder, "part")))
    return found.select(F.col("column").alias("column_name"), "type_confidence", "tier")


@query
def samples_of_columns(spark, folder):
    found = column_samples(table(spark, folder, "orders"))
    return found.select(F.col("column").alias("column_name"), F.array_join("samples", "|").alias("samples"))


@query
def first_rows_as_text(spark, folder):
    return first_rows(table(spark, folder, "supplier"))


@query
def overrides_applied(spark, folder):
    prof = profile(table(spark, folder, "customer"))
    final = overrides.apply_overrides(prof, overrides.merge_overrides(
        {"c_custkey": {"type": "categorical"}, "nothing": {"type": "date"}},
        {
            "c_custkey": {"type": "identifier"}, "c_acctbal": {"type": "numeric_measure", "agg_kind": "average"},
            "c_name": {"type": "date"}, "c_mktsegment": {"type": "numeric_measure"},
        },
    ))
    return final.to_df().select(
        F.col("column").alias("column_name"), F.col("type").alias("column_type"), "agg_kind", "mean",
        F.coalesce("user_corrected", F.lit(False)).alias("user_corrected"),
        F.col("correction_note").isNotNull().alias("has_note"),
    )


@query
def metadata_merge(spark, folder):
    prof = profile(table(spark, folder, "supplier"))
    reviewed = {
        "s_acctbal": {"agg_kind": "average", "label": "Balance"}, "s_suppkey": {"agg_kind": "median"},
        "s_nationkey": {"agg_kind": "average"},
    }
    merged = overrides.apply_overrides(
        overrides.apply_review(prof, reviewed), {"s_nationkey": {"type": "numeric_measure", "agg_kind": "sum"}}
    )
    labels = overrides.labels_for(merged, reviewed)
    names = spark.createDataFrame(list(labels.items()), "column string, label string")
    return merged.to_df().join(F.broadcast(names), "column").select(
        F.col("column").alias("column_name"), "label", "agg_kind", "agg_kind_confidence"
    )


# --- quality --------------------------------------------------------------------------

@query
def missing_report(spark, folder):
    return quality.missing_values(holed_customers(spark, folder)).withColumnRenamed("column", "column_name")


@query
def duplicate_rows(spark, folder):
    return quality.duplicate_rows(table(spark, folder, "documents").select("text", "lang", "source"))


@query
def duplicate_rows_small_domain(spark, folder):
    return quality.duplicate_rows(table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_discount"))


@query
def duplicate_entities(spark, folder):
    return quality.entity_summary(table(spark, folder, "documents").drop("doc_id"), "text")


@query
def duplicate_entity_examples(spark, folder):
    return quality.entity_examples(table(spark, folder, "documents").drop("doc_id"), "text")


@query
def duplicate_entities_hot_key(spark, folder):
    return quality.entity_summary(table(spark, folder, "events").select("user_id", "event_type", "value"), "user_id")


@query
def outlier_report(spark, folder):
    return quality.outlier_report(table(spark, folder, "events"), ["value"])


@query
def outlier_examples(spark, folder):
    return quality.outlier_examples(table(spark, folder, "events"), ["value"])


@query
def quality_summary(spark, folder):
    df = table(spark, folder, "documents").drop("doc_id")
    report = quality.quality_report(df, profile(df))
    entity = report["duplicate_entities"].get("text", {})
    row = (
        report["n_rows"], len(report["missing_values"]), report["duplicate_rows"],
        report["outliers"]["n_chars"]["count"], entity.get("n_repeated_values", 0), quality.is_clean(report),
    )
    return spark.createDataFrame(
        [row], "n_rows long, n_missing long, duplicate_rows long, n_outliers long, n_repeated long, clean boolean"
    )


# --- robust statistics ----------------------------------------------------------------

@query
def quartiles(spark, folder):
    line = table(spark, folder, "lineitem")
    rows = measures_long(line, {m: F.col(m) for m in LINE_MEASURES}, {"l_returnflag": F.col("l_returnflag")})
    found = robust.spread(rows, ["l_returnflag", "measure"]).frame
    return found.select("l_returnflag", "measure", "n", *[F.round(q, 4).alias(q) for q in ("q1", "q2", "q3")])


@query
def quartiles_narrowed(spark, folder):
    """Few large groups, each spread over ranges of its values."""
    line = table(spark, folder, "lineitem")
    rows = measures_long(line, {"price": F.col("l_extendedprice")}, {"l_linestatus": F.col("l_linestatus")})
    found = robust.spread(rows, ["l_linestatus", "measure"]).frame
    return found.select("l_linestatus", "n", *[F.round(q, 4).alias(q) for q in ("q1", "q2", "q3")])


@query
def quartiles_hot_value(spark, folder):
    """Nine tenths of the rows share a value, and some values are infinite."""
    line = table(spark, folder, "lineitem")
    value = (
        F.when(F.col("l_orderkey") % 10 != 0, 42.0).when(F.col("l_linenumber") == 1, float("inf"))
        .when(F.col("l_linenumber") == 2, float("-inf")).otherwise(F.col("l_extendedprice").cast("double"))
    )
    typed = line.select("l_linestatus", value.alias("v"))
    rows = measures_long(typed, {"v": clean.number_of("v", typed.schema["v"].dataType)}, {"l_linestatus": F.col("l_linestatus")})
    stats = robust.trimmed_stats(rows, ["l_linestatus", "measure"])
    return stats.select(
        "l_linestatus", "n", *[F.round(c, 2).alias(c) for c in ("v_min", "v_max", "q1", "q2", "q3", "trimmed_mean")], "n_extreme"
    )


@query
def trimmed_range(spark, folder):
    rows = measures_long(table(spark, folder, "events"), {"value": F.col("value")}, {"event_type": F.col("event_type")})
    low, high = robust.trimmed_range()
    found = robust.spread(rows, ["event_type"]).frame
    return found.select(
        "event_type", F.round(low, 2).alias("lo"), F.round(high, 2).alias("hi"),
        robust.zero_anchor().alias("zero_anchor"),
    )


@query
def trimmed_mean_by_category(spark, folder):
    return charts.breakdown(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", "average")


@query
def trimmed_mean_by_user(spark, folder):
    df = table(spark, folder, "events").select(F.col("user_id").alias("by"), F.col("value"))
    found = charts.grouped(df, ["by"], "average")
    return found.select(F.col("by").alias("user_id"), F.round(F.col("value"), 2).alias("value"), "n")


# --- breakdowns and trends ------------------------------------------------------------

@query
def sum_by_category_top8(spark, folder):
    return charts.breakdown(table(spark, folder, "part"), "p_brand", "p_retailprice", "sum")


@query
def count_by_category_top8(spark, folder):
    return charts.breakdown(table(spark, folder, "documents"), "source")


@query
def breakdowns_fused(spark, folder):
    return charts.breakdowns(table(spark, folder, "lineitem"), [
        ("l_returnflag", "l_quantity", "sum"), ("l_returnflag", "l_discount", "average"),
        ("l_linestatus", "l_quantity", "sum"), ("l_linestatus", "l_extendedprice", "average"),
    ])


@query
def trend_month_sum(spark, folder):
    return charts.trend(table(spark, folder, "lineitem"), "l_shipdate", "l_extendedprice", "sum", "M")


@query
def trend_month_avg(spark, folder):
    return charts.trend(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity", "average", "M")


@query
def trend_week_sum(spark, folder):
    return charts.trend(table(spark, folder, "events"), "ts", "value", "sum", "W")


@query
def trend_day_avg(spark, folder):
    return charts.trend(table(spark, folder, "events"), "ts", "value", "average", "D")


@query
def trends_fused(spark, folder):
    kinds = [("l_quantity", "sum"), ("l_discount", "average")]
    return charts.trends(table(spark, folder, "lineitem"), "l_shipdate", kinds, "M")


@query
def week_sunday(spark, folder):
    return charts.trend(table(spark, folder, "events"), "ts", "value", "sum", "W", week_start="sunday")


@query
def trend_summary(spark, folder):
    found = statements.trend_statement(trend_month_sum(spark, folder))
    return found.withColumn("change_pct", F.round("change_pct", 4))


@query
def trend_guard(spark, folder):
    """Distinct days and the periods the rules would choose, for two date columns."""
    out = []
    for name, day in (("events", "ts"), ("orders", "o_orderdate")):
        df = table(spark, folder, name)
        info = profile(df.select(day)).columns[day]
        lo, hi = (F.lit(info[k]).cast("date") for k in ("min_date", "max_date"))
        span = F.datediff(hi, lo)
        grouping = F.when(span > 180, "M").when(span > 21, "W").otherwise("D")
        days = charts.distinct_days(df, day, stop_at=dashboard.MIN_PERIODS)
        out.append(spark.range(1).select(
            F.lit(name).alias("table_name"), F.lit(days).cast("long").alias("days_up_to_7"), grouping.alias("grouping")
        ))
    return out[0].unionByName(out[1])


# --- histograms, proportions, cards ---------------------------------------------------

def _bins(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed("count", "n")


@query
def histogram_10(spark, folder):
    return _bins(charts.histograms(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"]))


@query
def histogram_trimmed(spark, folder):
    return _bins(charts.histograms(table(spark, folder, "events"), ["value"]))


@query
def histogram_12(spark, folder):
    return _bins(charts.histograms(table(spark, folder, "lineitem"), ["l_extendedprice"], bins=12, style="axis"))


@query
def histogram_filtered(spark, folder):
    df = filters.cross_filter(table(spark, folder, "lineitem"), category_column="l_returnflag", category="R")
    return _bins(charts.histograms(df, ["l_extendedprice"], style="fixed"))


@query
def histogram_mode(spark, folder):
    found = statements.histogram_statement(charts.histograms(table(spark, folder, "events"), ["value"]))
    return found.withColumnRenamed("count", "n")


@query
def pie_top6_other(spark, folder):
    return charts.proportions(table(spark, folder, "part"), "p_brand")


@query
def pie_all_slices(spark, folder):
    return charts.proportions(table(spark, folder, "part"), "p_type")


@query
def pie_top7_other(spark, folder):
    return charts.explore_proportions(table(spark, folder, "part"), "p_brand")


@query
def pie_statement(spark, folder):
    return statements.proportion_statement(charts.proportions(table(spark, folder, "part"), "p_type"))


@query
def bar_statement(spark, folder):
    return statements.bar_statement(charts.breakdown(table(spark, folder, "part"), "p_type", "p_size", "sum"))


@query
def summary_cards(spark, folder):
    kinds = [("l_quantity", "sum"), ("l_extendedprice", "sum"), ("l_discount", "average"), ("l_tax", "average")]
    return charts.summary_cards(table(spark, folder, "lineitem"), kinds)


@query
def filtered_summary_cards(spark, folder):
    df = filters.cross_filter(table(spark, folder, "events"), "ts", "2024-01-05", "2024-01-20", "event_type", "click")
    values = df.select(F.col("value").alias("as_sum"), F.col("value").alias("as_average"))
    return charts.summary_cards(values, [("as_sum", "sum"), ("as_average", "average")], plain_sums=True)


@query
def filtered_trend(spark, folder):
    df = filters.cross_filter(
        table(spark, folder, "lineitem"), "l_shipdate", "1996-03-01", "1998-06-30", "l_returnflag", "A"
    )
    return charts.trend(df, "l_shipdate", "l_quantity", "sum", "M")


@query
def filtered_breakdown(spark, folder):
    df = filters.cross_filter(table(spark, folder, "orders"), "o_orderdate", "1996-01-01", "1996-12-31")
    return charts.breakdown(df, "o_orderpriority", "o_totalprice", "average")


@query
def dashboard_filtered(spark, folder):
    """Every chart of the orders under a range of days and a priority; one measure is averaged."""
    whole = dashboard.analyze(table(spark, folder, "orders"), overrides={"o_custkey": {"type": "numeric_measure", "agg_kind": "average"}})
    found = cube.filtered_charts(cube.filter_cube(whole), "1995-03-01", "1997-08-31", "o_orderpriority", "1-URGENT")
    label = F.when(F.col("type") == "histogram", "").otherwise(F.col("label"))
    return found.withColumn("label", label)


# --- exploration and samples ----------------------------------------------------------

@query
def corr_fit(spark, folder):
    found = explore.correlation_fit(
        table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "quantity", "price"
    )
    rounded = [F.round(c, 6).alias(c) for c in ("r", "slope")]
    rounded += [F.round(c, 2).alias(c) for c in ("intercept", "trend_at_min", "trend_at_max")]
    return found.select("n", *rounded, "x_min", "x_max", "statement")


@query
def scatter_systematic(spark, folder):
    return explore.scatter_points(
        table(spark, folder, "orders"), "o_custkey", "o_totalprice", order_by=["o_orderkey"]
    )


@query
def sample_hash(spark, folder):
    orders = table(spark, folder, "orders")
    return explore.hash_sample(orders, n=max(1, orders.count() // 4), key=["o_orderkey"])


# --- filters and query specs ----------------------------------------------------------

def _counts(df: DataFrame, tests: list[tuple[str, str, str, object]]) -> DataFrame:
    """Matching rows of many filters, in one scan."""
    hits = df.agg(*[F.count_if(filters.matches(df, c, op, v)).alias(name) for name, c, op, v in tests])
    return hits.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("test"), F.col(name).alias("n")) for name, *_ in tests
    ])))


@query
def filter_boolish(spark, folder):
    lab = table(spark, folder, "labels")
    df = lab.select(
        "quality",
        F.when(F.col("quality") == 1, "Yes").when(F.col("doc_id") % 3 == 0, "NO").otherwise("other").alias("word"),
    )
    return _counts(df, [
        ("number_is_true", "quality", "==", True), ("number_is_yes", "quality", "==", "yes"),
        ("number_not_true", "quality", "!=", "TRUE"), ("word_is_true", "word", "==", True),
        ("word_is_0", "word", "==", "0"), ("word_not_true", "word", "!=", True), ("word_is_1", "word", "==", 1),
    ])


@query
def filter_ordered_text(spark, folder):
    e = table(spark, folder, "events")
    df = e.select(F.to_date("ts").cast("string").alias("day"), F.col("value").cast("string").alias("value_text"), "ts")
    return _counts(df, [
        ("text_after", "day", ">", "2024-01-10"), ("text_upto", "day", "<=", "2024-01-10"),
        ("number_text_above", "value_text", ">", 100), ("number_text_below", "value_text", "<", "9.5"),
        ("typed_after", "ts", ">", "2024-01-10"), ("typed_from", "ts", ">=", "2024-01-10"),
        ("typed_on", "ts", "==", "2024-01-10"), ("typed_not_on", "ts", "!=", "2024-01-10"),
    ])


@query
def filter_ci_equals(spark, folder):
    return _counts(holed_customers(spark, folder), [
        ("same", "c_mktsegment", "==", "building"), ("different", "c_mktsegment", "!=", "Building"),
        ("emptied", "c_mktsegment", "==", "MACHINERY"), ("number", "c_acctbal", ">=", "5000"),
        ("number_not", "c_custkey", "!=", 7),
    ])


@query
def spec_single(spark, folder):
    line = table(spark, folder, "lineitem")
    parts = []
    for operation in spec.OPERATIONS:
        answer = spec.run_spec(line, {
            "operation": operation, "target_column": "l_extendedprice",
            "filters": [
                {"column": "l_returnflag", "operator": "==", "value": "a"},
                {"column": "l_quantity", "operator": ">", "value": 10},
                {"column": "l_shipdate", "operator": "<", "value": "1999-01-01"},
            ],
        })
        parts.append(answer.result.select(
            F.lit(operation).alias("operation"), F.round(F.col("value").cast("double"), 2).alias("value"),
            "matched_rows",
        ))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


@query
def spec_grouped(spark, folder):
    answer = spec.run_spec(holed_customers(spark, folder), {
        "operation": "average", "target_column": "c_acctbal", "group_by": "c_mktsegment",
        "filters": [{"column": "c_custkey", "operator": ">=", "value": 10}],
    })
    return answer.result.select(F.col("group").alias("segment"), F.round("value", 2).alias("value"), "n")


_LOOKUP = {
    "operation": "max", "target_column": "l_quantity", "return_columns": ["l_orderkey", "l_linenumber", "l_partkey"],
    "filters": [{"column": "l_returnflag", "operator": "!=", "value": "N"}],
}


@query
def spec_lookup(spark, folder):
    return spec.run_spec(table(spark, folder, "lineitem"), _LOOKUP).result


@query
def spec_lookup_counts(spark, folder):
    return spec.run_spec(table(spark, folder, "lineitem"), _LOOKUP).counts


@query
def spec_text_table(spark, folder):
    """A question about a table of texts: amounts and days are what the profile found them to be."""
    answer = spec.run_spec(profile(messy_orders(spark, folder)), {
        "operation": "sum", "target_column": "total_price", "group_by": "priority",
        "filters": [
            {"column": "ordered", "operator": ">=", "value": "1996-02-01"},
            {"column": "total_price", "operator": ">", "value": 1000},
            {"column": "filled", "operator": "==", "value": "true"},
        ],
    })
    return answer.result.select("group", F.round("value", 2).alias("value"), "n")


@query
def cross_filter_text_dates(spark, folder):
    df = records.inferred_types(profile(messy_orders(spark, folder)))
    found = filters.cross_filter(df, "ordered", "1995-01-01", "1996-12-31", "filled", "Yes")
    return found.agg(F.count("*").alias("n"), F.round(F.sum("total_price"), 2).alias("total"), F.min("ordered").cast("string").alias("first_day"))


@query
def spec_lookup_date(spark, folder):
    """The last orders of a table of texts."""
    answer = spec.run_spec(profile(messy_orders(spark, folder)), {
        "operation": "max", "target_column": "ordered", "return_columns": ["order_id"],
        "filters": [{"column": "total_price", "operator": "<", "value": 100000.5}],
    })
    return answer.result.select(F.col("ordered").cast("string").alias("ordered"), "order_id")


# --- dashboard ------------------------------------------------------------------------

@query
def dashboard_plan(spark, folder):
    prof = profile(table(spark, folder, "orders"))
    charts_found = dashboard.build_charts(prof, overrides.labels_for(prof))
    return dashboard.charts_frame(spark, charts_found).select(
        "position", F.col("type").alias("chart_type"), "title", "category_column", "measure_column", "n_points"
    )


@query
def dashboard_statements(spark, folder):
    prof = profile(table(spark, folder, "part"))
    found = dashboard.insights(dashboard.build_charts(prof, overrides.labels_for(prof)))
    return spark.createDataFrame([(i["title"], i["text"]) for i in found], "title string, text string")


@query
def dashboard_warnings(spark, folder):
    result = dashboard.analyze(table(spark, folder, "documents").drop("doc_id"))
    return result.charts_df().select("position", F.col("type").alias("chart_type"), "title", "warning")


@query
def headline_measure(spark, folder):
    prof = profile(table(spark, folder, "orders"))
    card = dashboard.headline(dashboard.build_charts(prof, overrides.labels_for(prof)))
    return spark.createDataFrame([(card["title"], card["sum"])], "title string, total double")


@query
def table_overview(spark, folder):
    found = dashboard.overview_of(profile(table(spark, folder, "orders")))
    row = (found["n_numeric"], found["n_categorical"], found["n_date"], *found["date_range"].values())
    return spark.createDataFrame(
        [row], "n_numeric long, n_categorical long, n_date long, min_date string, max_date string"
    )


# --- role-based KPIs ------------------------------------------------------------------

def _sales(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("Order Date"),
        F.when(F.col("o_orderkey") % 20 == 0, F.lit("pending")).otherwise(money_text(F.col("o_totalprice"))).alias("Total"),
        F.col("o_orderpriority").alias("Category"),
        F.col("o_orderstatus").alias("Notes"),
        F.col("o_custkey").alias("Customer"),
    )


def _verified(df: DataFrame) -> list[dict]:
    matched, _ = roles.split_columns(df.columns)
    return roles.verify_roles(df, matched)


@query
def role_verify(spark, folder):
    df = _sales(spark, folder)
    return roles.roles_frame(df, _verified(df)).select(F.col("column").alias("column_name"), "role", "verified", "note")


@query
def kpi_total(spark, folder):
    df = _sales(spark, folder)
    return kpi.compute_kpis(df, _verified(df)).available["total_revenue"]


@query
def kpi_monthly(spark, folder):
    df = _sales(spark, folder)
    return kpi.compute_kpis(df, _verified(df)).available["revenue_over_time"]


@query
def kpi_top5(spark, folder):
    df = _sales(spark, folder)
    return kpi.compute_kpis(df, _verified(df)).available["top_categories"]


@query
def kpi_unavailable(spark, folder):
    df = _sales(spark, folder).drop("Total")
    reasons = kpi.compute_kpis(df, _verified(df)).unavailable
    return spark.createDataFrame(list(reasons.items()), "kpi string, reason string")


# --- sources, sinks, usage ------------------------------------------------------------

def _csv_folder(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@query
def csv_ingest(spark, folder):
    """Write messy text files, find the header and the nulls again, type and summarise."""
    df = delimited.read_table(spark, _csv_folder(messy_orders(spark, folder), "orders-csv"), format="csv")
    number = clean.number_of("total_price", df.schema["total_price"].dataType)
    day = F.to_date(dates.date_of("ordered", df.schema["ordered"].dataType)).cast("string")
    return df.groupBy("priority").agg(
        F.count("*").alias("n"), F.round(F.sum(number), 2).alias("total"), F.min(day).alias("first_day"),
        F.max(day).alias("last_day"), F.count("ordered").alias("n_dated"),
    )


@query
def csv_columns(spark, folder):
    """Columns left after ingest: the blank one is gone."""
    df = delimited.read_table(spark, _csv_folder(messy_orders(spark, folder), "orders-csv"), format="csv")
    return missing_names(df)


def missing_names(df: DataFrame) -> DataFrame:
    filled = df.agg(*[F.count(clean.quoted(c)).alias(c) for c in df.columns])
    return filled.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(clean.quoted(c)).alias("n")) for c in df.columns
    ])))


@query
def ragged_reject(spark, folder):
    """Records with more fields than the first line are refused; their number is in the text."""
    o = table(spark, folder, "orders")
    line = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 9 == 4, "extra"))
    path = scratch_path(spark, "ragged")
    spark.range(1).select(F.lit("key,status").alias("value")).write.text(path)
    o.select(line.alias("value")).write.mode("append").text(path)
    try:
        delimited.read_table(spark, path, format="csv")
        code, n = "accepted", 0
    except TableError as error:
        code, n = error.code, int(str(error).split()[0].replace(",", ""))
    return spark.createDataFrame([(code, n)], "code string, n long")


@query
def typed_records(spark, folder):
    prof = profile(table(spark, folder, "orders"))
    return records.typed_records(prof)


@query
def typed_records_sink(spark, folder):
    """Records written as JSON lines, nulls included, and read back."""
    prof = profile(holed_customers(spark, folder))
    path = scratch_path(spark, "records")
    records.write_records(records.typed_records(prof), path)
    return spark.read.json(path).select("c_acctbal", "c_custkey", "c_mktsegment", "c_name")


def _log(spark: SparkSession, folder: str) -> str:
    """The events table appended twice to a log, with epoch and ISO times and some without."""
    e, path = table(spark, folder, "events"), scratch_path(spark, "log")
    kind = F.when(F.col("event_type") == "click", "upload_succeeded").otherwise(F.col("event_type")).alias("event_type")
    ts = F.col("ts").cast("timestamp")
    rows = e.select(F.col("event_id").cast("string").alias("id"), ts.alias("t"), kind, "event_id")
    even = rows.where(F.col("event_id") % 2 == 0)
    odd = rows.where(F.col("event_id") % 2 == 1)
    eventlog.append_events(even.select("id", F.unix_micros("t").alias("u"), "event_type", "event_id").select(
        "id", (F.col("u") / 1e6).alias("ts"), "event_type"), path)
    eventlog.append_events(odd.select(
        "id", F.when(F.col("event_id") % 10 != 1, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")).alias("ts"), "event_type"
    ), path)
    return path


@query
def eventlog_daily(spark, folder):
    events = eventlog.read_events(spark, _log(spark, folder))
    return usage.daily_activity(events, eventlog.moment_of(F.col("ts"))).select(F.col("day").cast("string").alias("day"), "n")


@query
def eventlog_totals(spark, folder):
    events = eventlog.read_events(spark, _log(spark, folder))
    return usage.usage_totals(events, eventlog.moment_of(F.col("ts")))


@query
def usage_daily(spark, folder):
    e = table(spark, folder, "events")
    return usage.daily_activity(e, F.col("ts"), ["event_type"]).select(
        F.col("day").cast("string").alias("day"), "event_type", "n"
    )


@query
def usage_daily_stream(spark, folder):
    """Events arrive in two deliveries; the second reaches back to days already counted and is read after a restart."""
    e = table(spark, folder, "events")
    arrived, counts, checkpoint = (scratch_path(spark, f"activity-{p}") for p in ("source", "counts", "checkpoint"))
    for delivery in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        e.where(delivery).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 8).parquet(arrived)
        usage.start_daily_activity(
            usage.daily_activity_stream(stream, F.col("ts"), ["event_type"]), counts, checkpoint
        ).awaitTermination()
    found = usage.read_daily_activity(spark, counts, ["event_type"])
    return found.select(F.col("day").cast("string").alias("day"), "event_type", "n")
