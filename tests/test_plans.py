from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import fixtures
from gridscope.errors import TableError
from gridscope.operators import roles
from gridscope.operators.profile import profile
from gridscope.plans import cube, dashboard, kpi, spec
from gridscope.sources import eventlog, records
from gridscope.sources.delimited import read_table
from gridscope.streaming import usage


@pytest.fixture
def table(spark, text_file):
    return lambda lines: read_table(spark, text_file("t.csv", lines))


def kinds(charts):
    out = {}
    for c in charts:
        out[c["type"]] = out.get(c["type"], 0) + 1
    return out


def test_harbour_dashboard(table):
    a, visits = dashboard.analyze(table(fixtures.HARBOUR)), fixtures.VISITS
    assert kinds(a.charts) == {"summary_card": 3, "line": 2, "bar": 6, "histogram": 3, "pie": 2}
    line = next(c for c in a.charts if c["type"] == "line")
    weeks = {}
    for v in visits:
        monday = v["arrival"] - timedelta(days=v["arrival"].weekday())
        weeks[monday] = weeks.get(monday, 0) + v["crates"]
    values, days = [weeks[w] for w in sorted(weeks)], sorted(weeks)
    assert line["measure_column"] == "crates" and [p["value"] for p in line["points"]] == values
    change = round((values[-1] / values[0] - 1) * 100)
    shown = [f"{d}/{d + timedelta(days=6)}" for d in (days[0], days[-1])]
    assert line["stat_summary"].startswith(f"{shown[0]} - {shown[1]}: {change:+} percent; high point ")
    assert a.quality["duplicate_entities"] == {}
    assert dashboard.headline(a.charts)["title"] == "Dues Total"
    assert dashboard.trend_of(a.charts, "crates") is line and dashboard.trend_of(a.charts, "dues total") is None
    assert a.overview["date_range"] == {"min": str(visits[0]["arrival"]), "max": str(visits[-1]["arrival"])}
    assert len(dashboard.insights(a.charts)) == 13
    row, towed = a.records.where(F.col("remark") == "tow needed").first(), visits[4]
    assert (row["arrival"], row["crates"], row["draught"]) == (str(towed["arrival"]), towed["crates"], towed["draught"])
    assert a.charts_df().count() == 16


def test_small_groups_have_no_charts(table):
    a = dashboard.analyze(table(fixtures.SPARSE))
    assert kinds(a.charts) == {"summary_card": 1, "histogram": 1, "pie": 2}
    assert dashboard.headline(a.charts)["title"] == "Speed Rating"


def test_constant_table(table):
    a = dashboard.analyze(table(fixtures.FLAT))
    assert kinds(a.charts) == {"summary_card": 1, "histogram": 1}
    assert a.quality["duplicate_rows"] == 21
    assert next(c for c in a.charts if c["type"] == "histogram")["bins"] == [{"bin": "4", "count": 22}]


def test_categories_without_measures_are_counted(table):
    a = dashboard.analyze(table(fixtures.KINDS))
    bars = [c for c in a.charts if c["type"] == "bar"]
    assert [b["title"] for b in bars] == ["Count by Deck", "Count by Hatch"]
    assert bars[0]["bars"] == [{"category": f"d{k}", "value": 8.0} for k in range(5)]


def test_many_measures_are_capped(table):
    few = [",".join(line.split(",")[:30]) for line in fixtures.WIDE]
    assert kinds(dashboard.analyze(table(few)).charts) == {"summary_card": 6, "histogram": 3}


def test_review_overrides_and_about(table):
    df = table(fixtures.HARBOUR)
    a = dashboard.analyze(
        df, overrides={"crates": {"type": "numeric_measure", "agg_kind": "sum"}},
        reviewed={"crates": {"agg_kind": "average", "label": "Boxes"}, "draught": {"agg_kind": "average"}},
        about="Visits to a harbour.",
    )
    assert (a.profile.columns["crates"]["agg_kind"], a.profile.columns["draught"]["agg_kind"]) == ("sum", "average")
    assert a.labels["crates"] == "Boxes" and a.corrected == ["crates"] and a.about == "18 rows. Visits to a harbour."
    assert dashboard.guard_row_count("All 1,500 rows", 1500) == "All 1,500 rows"
    titles = [c["title"] for c in a.charts if c["type"] == "bar"]
    assert "Boxes by Berth" in titles and "Average Draught by Berth" in titles


def test_warnings(spark):
    rows = [(f"e{i}", float(i % 10), f"g{i % 3}") for i in range(60)] + [("e1", 5000.0, "g1"), ("e2", 3.5, "g2")]
    df = spark.createDataFrame(rows, "name string, score double, grp string").withColumn("total", F.col("score") + 1)
    a = dashboard.analyze(df)
    by_title = {c["title"]: c for c in a.charts}
    assert "1 extreme value is left out" in by_title["Score"]["warning"]
    assert "outer bin" in by_title["Distribution of Score"]["warning"]
    assert "4 rows repeat a value of 'Name'" in by_title["Total"]["warning"]
    assert "4 rows" in by_title["Total by Grp"]["warning"] and "rows repeat" not in by_title["Score"]["warning"]


def test_pies_prefer_unused_columns(spark):
    df = spark.range(200).select(*[(F.col("id") % (3 + i)).cast("string").alias(f"x{i}") for i in range(6)], F.rand(1).alias("v"))
    df = df.select(*[F.concat(F.lit("v"), c).alias(c) for c in df.columns if c != "v"], "v")
    charts = dashboard.build_charts(p := profile(df), {c: c for c in p.columns})
    assert [c["category_column"] for c in charts if c["type"] == "pie"] == ["x4", "x5"]
    assert sum(c["type"] == "bar" for c in charts) == 4


def test_headline_rules():
    def card(m, kind, total=1.0):
        return {"type": "summary_card", "title": m, "measure_column": m, "agg_kind": kind, "sum": total}
    line, bar = {"type": "line", "measure_column": "b"}, {"type": "bar", "measure_column": "a"}
    assert dashboard.headline([]) is None
    assert dashboard.headline([card("a", "sum", 5), card("b", "sum", 9), card("Revenue", "average")])["title"] == "Revenue"
    assert dashboard.headline([card("a", "sum", 5), card("b", "sum", 9)])["title"] == "b"
    assert dashboard.headline([card("a", "average"), card("b", "average"), line, bar, bar])["title"] == "b"
    assert dashboard.headline([card("c", "average"), card("a", "average"), bar])["title"] == "a"
    assert dashboard.headline([card("c", "average"), card("d", "average")])["title"] == "c"


def test_specs(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "2024-01-01", "x"), ("a", None, "2024-01-02", "y"), (None, 5.0, None, "z"), ("b", 5.0, "2024-01-03", "w")],
        "g string, v double, d string, who string",
    )
    single = lambda op, **kw: spec.run_spec(df, {"operation": op, "target_column": "v", **kw}).result.first()
    assert [single(op).value for op in ("sum", "average", "count", "min", "max")] == [11.0, 11 / 3, 4, 1.0, 5.0]
    assert single("sum", filters=[{"column": "g", "operator": "==", "value": "nobody"}])[:] == (None, 0)
    assert single("sum", target_column="d").value is None
    typed = df.withColumn("d", F.col("d").cast("date"))
    assert spec.run_spec(typed, {"operation": "max", "target_column": "d"}).result.first().value == "2024-01-03"
    grouped = spec.run_spec(df, {"operation": "sum", "target_column": "v", "group_by": "g"}).result
    assert sorted(tuple(r) for r in grouped.collect()) == [("a", 1.0, 2), ("b", 5.0, 1)]
    count = spec.run_spec(df, {"operation": "count", "group_by": "g"}).result
    assert sorted(tuple(r) for r in count.collect()) == [("a", 2, 2), ("b", 1, 1)]
    found = spec.run_spec(df, {"operation": "max", "target_column": "v", "return_columns": ["who"]})
    assert [tuple(r) for r in found.result.collect()] == [(5.0, "w"), (5.0, "z")]
    assert found.counts.first()[:] == (4, 2, False)
    assert spec.run_spec(df, {"operation": "max", "return_columns": ["who"]}).result.count() == 0
    many = spark.range(100).select(F.lit(1).alias("v"), "id")
    found = spec.run_spec(many, {"operation": "min", "target_column": "v", "return_columns": ["id"]})
    assert found.result.count() == 5 and found.counts.first()[:] == (100, 100, True)
    nothing = spec.run_spec(many.where("v > 3"), {"operation": "min", "target_column": "v", "return_columns": ["id"]})
    assert nothing.result.count() == 0 and nothing.counts.first()[:] == (0, 0, False)


@pytest.mark.parametrize("bad,code", [
    ({"operation": "sum", "target_column": "nope"}, "UNKNOWN_COLUMN"),
    ({"operation": "sum", "target_column": "v", "group_by": "nope"}, "UNKNOWN_COLUMN"),
    ({"operation": "count", "filters": [{"column": "nope", "operator": "==", "value": 1}]}, "UNKNOWN_COLUMN"),
    ({"operation": "max", "target_column": "v", "return_columns": ["nope"]}, "UNKNOWN_COLUMN"),
    ({"operation": "median", "target_column": "v"}, "UNKNOWN_OPERATION"),
    ({"operation": "count", "filters": [{"column": "v", "operator": "~", "value": 1}]}, "UNKNOWN_OPERATOR"),
])
def test_bad_specs_are_refused(spark, bad, code):
    with pytest.raises(TableError) as error:
        spec.run_spec(spark.createDataFrame([(1.0,)], "v double"), bad)
    assert error.value.code == code


def test_exposed_columns(table):
    assert spec.exposed_columns(profile(table(fixtures.FLAT))) == ["depth"]


def test_records_drop_long_text_and_keep_nulls(spark, tmp_path):
    df = spark.range(50).select(
        F.col("id").alias("row_id"), F.concat(F.lit("name"), "id").alias("short"), F.repeat(F.concat(F.lit("long text "), "id"), 9).alias("long"),
        F.when(F.col("id") > 5, F.col("id") * 1.5).alias("v"), F.lit("same").alias("fixed"),
    )
    prof = profile(df)
    assert records.lookup_columns(prof) == ["row_id", "short", "v"]
    path = str(tmp_path / "out")
    records.write_records(records.typed_records(prof), path)
    assert sum('"v":null' in r[0] for r in spark.read.text(path).collect()) == 6
    assert records.typed_records(prof, sample=10).count() == 10


def test_roles_and_kpis(spark):
    assert [roles.role_of(c) for c in ("Unit Price", "Order Date", "Sub Total", "SKU", "Client", "Memo", "dt", "Segment", "Operating Cost")] == [
        "unit_price", "date", "sales_amount", "product_name", "customer_name", None, "date", "category", "expense_amount",
    ]
    df = spark.createDataFrame(
        [("2024-01-05", "10", "A", 1), ("2024-01-09", "20.5", "B", 2), ("2024-02-01", "5", "A", -3), ("2024-02-02", "6", "C", 4), ("2024-03-02", "7", "A", 5)],
        "Date string, Amount string, Item string, Qty int",
    )
    matched, rest = roles.split_columns([*df.columns, "Memo"])
    assert rest == ["Memo"]
    verified = roles.verify_roles(df, matched)
    assert [r["verified"] for r in verified] == [True, True, True, True]
    assert verified[3]["note"] == "numbers: 5 of 5; not below zero: 4"
    found = kpi.compute_kpis(df, verified)
    assert found.available["total_revenue"].first()[0] == 48.5
    assert [tuple(r) for r in found.available["revenue_over_time"].collect()] == [("2024-01", 30.5), ("2024-02", 11.0), ("2024-03", 7.0)]
    assert [tuple(r) for r in found.available["top_categories"].collect()] == [("A", 22.0), ("B", 20.5), ("C", 6.0)]
    dirty = df.withColumn("Amount", F.concat(F.lit("$"), "Amount"))
    assert not kpi.compute_kpis(dirty, roles.verify_roles(dirty, matched)).available


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    now = spark.createDataFrame([("upload_succeeded", 1704067200.5), ("upload_succeeded", 1704153600.0), ("other", 1704153600.0)], "event_type string, ts double")
    eventlog.append_events(now, path)
    iso = spark.createDataFrame([("upload_succeeded", "2024-01-02T23:00:00")], "event_type string, ts string")
    eventlog.append_events(iso, path)
    before = datetime.now().timestamp()
    eventlog.append_events(spark.createDataFrame([("stamped",)], "event_type string"), path)
    stamped = eventlog.read_events(spark, path, "stamped").first()
    assert before - 60 < float(stamped["ts"]) < before + 600 and len(stamped["id"]) == 36
    # a record that says it has no time keeps none; one without the field is stamped
    eventlog.append_events(iso.withColumn("ts", F.lit(None).cast("string")), path)
    (tmp_path / "log" / "broken.json").write_text("{not json\n")
    events = eventlog.read_events(spark, path)
    moment = eventlog.moment_of(F.col("ts"))
    assert [(str(r.day), r.n) for r in usage.daily_activity(events, moment).collect()] == [("2024-01-01", 1), ("2024-01-02", 2)]
    assert usage.usage_totals(events, moment).first()[:] == (4, 2)


def test_activity_stream_continues_where_it_stopped(spark, tmp_path):
    source, table, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    def add(day, n):
        spark.range(n).select(F.lit(f"{day} 10:00:00").cast("timestamp").alias("ts")).write.mode("append").parquet(source)
    def run():
        stream = spark.readStream.schema("ts timestamp").parquet(source)
        usage.start_daily_activity(usage.daily_activity_stream(stream, F.col("ts")), table, check).awaitTermination()
        return sorted((str(r.day), r.n) for r in usage.read_daily_activity(spark, table).collect())
    add("2024-01-01", 5)
    assert run() == [("2024-01-01", 5)]
    add("2024-01-01", 2)
    add("2024-01-02", 3)
    assert run() == [("2024-01-01", 7), ("2024-01-02", 3)]
    add("2023-11-30", 4)
    assert run()[0] == ("2023-11-30", 4)


def test_closed_days_ignore_late_events_after_a_restart(spark, tmp_path):
    source, table, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    def deliver(*days):
        frame = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_timestamp("d").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(source)
    def run():
        stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        counts = usage.daily_activity_stream(stream, F.col("ts"), lateness="1 day")
        usage.start_daily_activity(counts, table, check).awaitTermination()
        return sorted((str(r.day), r.n) for r in usage.read_daily_activity(spark, table).collect())
    deliver("2024-03-01 08:00:00", "2024-03-01 09:00:00")
    deliver("2024-03-05 10:00:00")
    assert run() == [("2024-03-01", 2), ("2024-03-05", 1)]
    deliver("2024-03-01 10:00:00", "2024-03-04 12:00:00", "2024-03-05 11:00:00")
    assert run() == [("2024-03-01", 2), ("2024-03-04", 1), ("2024-03-05", 2)]


def test_staged_table_is_the_same(spark, table):
    df = table(fixtures.HOLES)
    copy = records.staged(df)
    assert copy.columns == df.columns and copy.exceptAll(df).count() == 0 and copy.count() == 96


def test_filters_answered_from_cells(table):
    """Without a filter the cells give the whole charts; under one, those of the rows that pass."""
    whole = dashboard.analyze(table(fixtures.HARBOUR), overrides={"draught": {"type": "numeric_measure", "agg_kind": "average"}})
    made = cube.filter_cube(whole)
    found = {(r["type"], r["measure"], r["category_column"], r["label"]): r["value"] for r in cube.filtered_charts(made).collect()}
    for c in whole.charts:
        if c["type"] == "bar":
            assert [(b["category"], b["value"]) for b in c["bars"]] == sorted(
                ((k[3], v) for k, v in found.items() if k[:3] == ("bar", c["measure_column"], c["category_column"])), key=lambda x: (-x[1], x[0])
            )
        if c["type"] == "histogram":
            assert {b["bin"]: b["count"] for b in c["bins"]} == {k[3]: v for k, v in found.items() if k[:2] == ("histogram", c["measure_column"])}
    assert made.cells.where("measure = ''").agg(F.sum("m")).first()[0] == 18
    visits = [v for v in fixtures.VISITS if v["pilot"] == "p1" and "2024-02-08" <= str(v["arrival"]) <= "2024-03-10"]
    some = cube.filtered_charts(made, "2024-02-08", "2024-03-10", "pilot", "p1").collect()
    card = {r["label"]: r["value"] for r in some if (r["type"], r["measure"]) == ("summary_card", "dues total")}
    dues = [v["dues total"] for v in visits]
    assert card == {"sum": round(sum(dues), 2), "mean": round(sum(dues) / len(dues), 2), "min": min(dues), "max": max(dues)}
    weeks = {}
    for v in visits:
        sunday = v["arrival"] - timedelta(days=(v["arrival"].weekday() + 1) % 7)
        weeks[str(sunday)] = weeks.get(str(sunday), 0) + v["crates"]
    assert {r["label"]: r["value"] for r in some if (r["type"], r["measure"]) == ("line", "crates")} == weeks
    assert not [r for r in some if r["type"] == "bar" and r["measure"] == "draught"]  # too few values for an average
    assert cube.filtered_charts(made, "2030-01-01").where("type <> 'histogram'").count() == 0
    for wrong in ({"category_column": "keel", "category": "x"}, {"category_column": "remark", "category": "x"}):
        with pytest.raises(TableError):
            cube.filtered_charts(made, **wrong)
