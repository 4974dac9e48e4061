import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

import fixtures
from gridscope.functions import clean, dates, names
from gridscope.operators import overrides
from gridscope.operators.profile import column_samples, confidence_tier, least_confident_first, profile
from gridscope.sources.delimited import read_table


@pytest.fixture
def prof(spark, text_file):
    return lambda lines, **kw: profile(read_table(spark, text_file("t.csv", lines)), **kw)


def types(p):
    return {c: i["type"] for c, i in p.columns.items()}


def test_shares_at_the_gate(prof):
    p = prof(fixtures.SHARES)
    assert types(p) == {"enough": "numeric_measure", "short": "free_text", "dated": "date", "undated": "free_text"}
    assert p.columns["enough"]["type_confidence"] == p.columns["dated"]["type_confidence"] == 0.5
    assert p.columns["enough"]["sum"] == sum(k + 1.5 for k in range(80))
    assert (p.columns["dated"]["min_date"], p.columns["dated"]["max_date"]) == ("2022-01-01", "2022-03-21")


def test_ratio_of_a_category(prof):
    p = prof(fixtures.RATIOS)
    assert types(p) == {"half": "categorical", "over": "free_text", "drift rate": "numeric_measure"}
    assert p.columns["half"]["type_confidence"] == 0.5 and p.columns["over"]["type_confidence"] == round(0.5 + abs(8 / 14 - 0.5), 3)
    assert p.columns["drift rate"]["agg_kind"] == "average" and p.columns["drift rate"]["mean"] == sum(3 * k + 1 for k in range(14)) / 14


def test_size_of_a_category(prof):
    p = prof(fixtures.FEW)
    assert types(p) == {"fifty": "categorical", "more": "free_text"}
    assert len(p.columns["fifty"]["top_values"]) == 10 and p.columns["fifty"]["top_values"][0] == {"value": "f0", "count": 5}


def test_missing_values(prof):
    p = prof(fixtures.HOLES)
    assert types(p) == {"level": "numeric_measure", "mark": "categorical", "spot": "categorical"}
    assert [p.columns[c]["null_fraction"] for c in p.columns] == [0.5, 0.333, 0.25]
    odd = [k for k in range(96) if k % 2]
    assert (p.columns["level"]["sum"], p.columns["level"]["mean"]) == (sum(odd), sum(odd) / len(odd))


def test_repeated_rows(prof):
    weight, values = prof(fixtures.COPIES).columns["weight"], [10 * k for k in range(1, 10) for _ in range(k)]
    q1, q3 = statistics.quantiles(values, n=4, method="inclusive")[::2]
    assert (weight["sum"], weight["mean"]) == (sum(values), round(sum(values) / len(values), 2))
    assert (weight["spread"]["q1"], weight["spread"]["q3"]) == (q1, q3)


def test_one_value(prof):
    p = prof(fixtures.FLAT)
    assert types(p) == {"depth": "numeric_measure", "zone": "constant"}  # the column without values is not read
    assert p.columns["zone"]["value"] == "inner" and p.columns["depth"]["zero_anchor"] and p.columns["depth"]["mean"] == 4.0


def test_forms_of_dates(prof):
    p = prof(fixtures.FORMED)
    info = p.columns["written"]
    assert info["type"] == "date" and info["type_confidence"] == 1.0 and types(p)["moon"] == "constant"
    assert (info["min_date"], info["max_date"]) == (str(fixtures.DAYS[0]), str(fixtures.DAYS[-1]))


def test_names_beyond_ascii(prof):
    p = prof(fixtures.SIGNS)
    assert types(p) == {"Größe": "numeric_measure", "Straße": "categorical", "Übergabe": "date", "种类": "categorical"}
    assert p.columns["Größe"]["sum"] == 11 * sum(range(36)) and not p.columns["Größe"]["agg_kind_confident"]
    assert p.columns["Übergabe"]["max_date"] == "2020-04-02"


def test_harbour(prof):
    p, visits = prof(fixtures.HARBOUR), fixtures.VISITS
    assert list(types(p).values()) == ["date", "categorical", "categorical", "numeric_measure", "numeric_measure", "free_text", "numeric_measure"]
    for measure in ("crates", "dues total"):
        assert p.columns[measure]["sum"] == round(sum(v[measure] for v in visits), 2)
    assert p.columns["pilot"]["type_confidence"] == round(0.5 + abs(4 / 18 - 0.5), 3)


def test_many_columns(prof):
    p = prof(fixtures.WIDE)
    assert len(p.columns) == 130 and set(types(p).values()) == {"numeric_measure"}
    assert all(p.columns[f"gauge_{j}"]["sum"] == sum(range(2, 11)) * (j + 1) for j in range(130))


def test_single_row(prof):
    p = prof(fixtures.HARBOUR[:2])
    assert types(p) == {"arrival": "date", "berth": "constant", "pilot": "constant", "crates": "numeric_measure", "draught": "numeric_measure", "dues total": "numeric_measure"}


def test_physical_types(spark):
    df = spark.sql("""select cast(id as decimal(10,2)) amount, id % 2 = 0 even, cast(null as int) nothing,
        array(id) things, if(id % 2 = 0, 'Y', 'n') yn, cast('nan' as double) bad, date'2024-01-01' + cast(id as int) d
        from range(20)""")
    assert types(profile(df)) == {
        "amount": "numeric_measure", "even": "boolean", "nothing": "empty", "things": "unsupported", "yn": "boolean",
        "bad": "empty", "d": "date",
    }


def test_nulls_of_unsupported_columns_are_counted(spark):
    p = profile(spark.sql("select id, if(id < 3, null, array(id)) things from range(10)"))
    assert p.columns["things"]["type"] == "unsupported" and p.counts["things"] == 7


def test_estimates_agree_on_types(prof):
    for lines in (fixtures.HOLES, fixtures.SHARES, fixtures.HARBOUR):
        assert types(prof(lines)) == types(prof(lines, distinct="estimate"))


def test_tiers_and_samples(spark, prof):
    assert [confidence_tier(c) for c in (0.9, 0.899, 0.7, 0.69)] == ["high", "medium", "medium", "low"]
    p = prof(fixtures.RATIOS)
    assert [r["column"] for r in least_confident_first(p).collect()] == ["half", "over", "drift rate"]
    samples = {r["column"]: r["samples"] for r in column_samples(p.df).collect()}
    assert samples["drift rate"] == [str(3 * k + 1) for k in range(5)]


def test_samples_of_many_columns_take_one_job(spark):
    wide = spark.range(400, numPartitions=4).select(
        "id", *[(F.col("id") + i).alias(f"c{i}") for i in range(40)],
        F.when(F.col("id") > 350, F.col("id")).alias("late"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") == 3, F.array("id")).alias("list"),
    )
    spark.sparkContext.setJobGroup("samples of values", "")
    got = {r["column"]: r["samples"] for r in column_samples(wide.drop("late", "none", "list")).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("samples of values")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got["c7"] == [str(k + 7) for k in range(5)] and len(got) == 41
    assert len(jobs) <= 2  # one for the samples, one that collects the answer
    got = {r["column"]: r["samples"] for r in column_samples(wide).collect()}
    assert got["late"] == [str(k) for k in range(351, 356)] and got["none"] == [] and got["list"] == ['{"list":[3]}']


def test_name_words():
    assert names.names_identifier("stop_id") and names.names_identifier("Retailer ID") and not names.names_identifier("width")
    assert names.agg_kind_of("Operating Profit")[0] == "sum" and names.agg_kind_of("Corporate units")[0] == "sum"
    assert names.agg_kind_of("avg price") == ("average", True, 0.9) and names.agg_kind_of("x") == ("sum", False, 0.5)
    assert names.names_size("Disk-Size") and not names.names_size("resize")
    assert names.default_label("o_order-date") == "O Order Date"


def test_cleaning(spark):
    cells = ["3m", "€ 5", "£17,040.25", "6.5K", "940 CHF", "none yet", "-", "31%", "88", "1e3", "1d", ".5", "2.5 B", "-4k", "Infinity", " 7 "]
    want = [3e6, 5, 17040.25, 6500, None, None, None, 31, 88, 1000, None, 0.5, 2.5e9, -4000, None, 7]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, amount string")
    got = df.orderBy("i").select(clean.number_of("amount", df.schema["amount"].dataType).alias("x")).collect()
    assert [r.x for r in got] == pytest.approx(want)
    sized = df.withColumnRenamed("amount", "App Size")
    plain = sized.orderBy("i").select(clean.number_of("App Size", df.schema["amount"].dataType).alias("x")).collect()
    assert plain[0].x is None and plain[3].x is None and plain[7].x == 31


def test_dates_and_periods(spark):
    cases = {
        "13/01/2024": "2024-01-13", "05/28/97": "1997-05-28", "1/2/68": "2068-01-02", "1/2/69": "1969-01-02",
        "1200": None, "6.5": None, "May": None, "10:30": None, "31/02/2024": None, "2024-13-01": None,
        "20240101": "2024-01-01", "2025-04-06T23:31:35-04:00": "2025-04-07", "3 March 2024": "2024-03-03",
        "1/3/2024 10:30 PM": "2024-01-03", "12 monkeys 99": None, "": None, "2024/2/3": "2024-02-03",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    wrong = df.where(~F.to_date(dates.date_from_text(F.col("t"))).cast("string").eqNullSafe(F.col("want")))
    assert wrong.collect() == []
    day = F.lit("2024-01-07").cast("date")
    label = lambda g, w="monday": dates.period_label(dates.period_start(day, g, w), g, w)
    row = spark.range(1).select(label("D"), label("W"), label("W", "sunday"), label("M")).first()
    assert tuple(row) == ("2024-01-07", "2024-01-01/2024-01-07", "2024-01-07", "2024-01")


def test_overrides(spark, prof):
    p = prof(fixtures.HARBOUR)
    wanted = overrides.merge_overrides(
        {"crates": {"type": "identifier"}, "pilot": {"type": "numeric_measure"}},
        {"crates": {"type": "numeric_measure", "agg_kind": "average"}, "draught": {"type": "categorical"},
         "remark": {"type": "date"}, "dues total": {"type": "nonsense"}, "keel": {"type": "date"},
         "arrival": {"type": "free_text"}},
    )
    final = overrides.apply_overrides(p, wanted)
    assert final.columns["crates"]["agg_kind"] == "average" and final.columns["crates"]["agg_kind_confidence"] == 1.0
    assert final.columns["pilot"]["type"] == "categorical" and "pilot" in final.columns["pilot"]["correction_note"]
    assert final.columns["remark"]["type"] == "categorical" and final.columns["remark"]["correction_note"]
    counts = Counter(str(v["draught"]) for v in fixtures.VISITS)
    assert final.columns["draught"]["top_values"] == [{"value": v, "count": n} for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    assert final.columns["dues total"] == p.columns["dues total"] and final.columns["arrival"]["type"] == "free_text"
    assert "keel" not in final.columns
    reviewed = overrides.apply_review(p, {"crates": {"agg_kind": "average"}, "draught": {"agg_kind": "median"}})
    assert (reviewed.columns["crates"]["agg_kind"], reviewed.columns["draught"]["agg_kind"]) == ("average", "sum")


def test_dates_padded_and_long(spark):
    """Padding and repeated separators never hide a date; long texts that hold one are none."""
    cells = ["2024-01-05" + " " * 54, " " * 60 + "Jan 5, 2024", "September" + " " * 20 + "5," + " " * 20 + "2024   10:05:33 PM", "2024-01-05 " * 9, "1200" + " " * 60]
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    got = [r[0] for r in df.select(F.to_date(dates.date_from_text(F.col("cell"))).cast("string")).collect()]
    assert got == ["2024-01-05", "2024-01-05", "2024-09-05", None, None]
    padded = spark.createDataFrame([(f"2024-01-{k % 28 + 1:02d}".ljust(64), k) for k in range(60)], "day string, n long")
    assert types(profile(padded))["day"] == "date"
