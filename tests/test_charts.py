import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridscope.operators import charts, explore, quality, statements
from gridscope.operators.profile import profile


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({
        "cat": np.where(rng.random(n) < 0.4, "hot", [f"c{int(i)}" for i in rng.integers(0, 12, n)]),
        "v": np.round(np.where(rng.random(n) < 0.02, 5000, 1) * rng.gamma(2, 10, n), 2),
        "d": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 100, n), "D"),
    })
    pdf.loc[::17, "cat"] = None
    pdf.loc[::23, "v"] = None
    rows = [(r.cat, None if pd.isna(r.v) else r.v, r.d.to_pydatetime()) for r in pdf.itertuples()]
    return pdf, spark.createDataFrame(rows, "cat string, v double, d timestamp").cache()


def trimmed(v):
    q1, q3 = v.quantile([0.25, 0.75])
    return v[(v >= q1 - 3 * (q3 - q1)) & (v <= q3 + 3 * (q3 - q1))].mean() if q3 != q1 else v.mean()


def test_breakdown_against_brute_force(frame):
    pdf, df = frame
    full = pdf.dropna(subset=["cat", "v"])
    sums = full.groupby("cat").v.sum().sort_values(ascending=False).head(8)
    got = charts.breakdown(df, "cat", "v").collect()
    assert [r.category for r in got] == list(sums.index) and [r.value for r in got] == pytest.approx(sums.round(2).tolist())
    means = full.groupby("cat").v.apply(trimmed).sort_values(ascending=False).head(8)
    for limit in (None, 50):
        got = charts.breakdown(df, "cat", "v", "average").collect()
        assert [r.category for r in got] == list(means.index)
        assert [r.value for r in got] == pytest.approx(means.tolist(), abs=0.006)
    counts = charts.breakdown(df, "cat").collect()
    assert counts[0].value == pdf.cat.value_counts().iloc[0]


def test_small_groups_have_no_average(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 2.0)] * 5, "c string, v double")
    assert [r.category for r in charts.breakdown(df, "c", "v", "average").collect()] == ["b"]
    assert charts.breakdown(df, "c", "v", "sum").count() == 2


def test_fused_breakdowns_equal_single_ones(frame):
    _, df = frame
    df = df.withColumn("other", F.substring("cat", 1, 1))
    fused = charts.breakdowns(df, [("cat", "v", "sum"), ("other", "v", "average")])
    single = {("cat", "v"): charts.breakdown(df, "cat", "v"), ("other", "v"): charts.breakdown(df, "other", "v", "average")}
    for (c, m), one in single.items():
        part = fused.where((F.col("category_column") == c) & (F.col("measure") == m)).orderBy("rank")
        assert [(r.category, r.value) for r in part.collect()] == [tuple(r) for r in one.collect()]


def test_trends(frame):
    pdf, df = frame
    full = pdf.dropna(subset=["v"])
    weeks = full.groupby(full.d.dt.to_period("W").astype(str)).v.sum()
    got = charts.trend(df, "d", "v", "sum", "W").collect()
    assert [r.period for r in got] == list(weeks.index) and [r.value for r in got] == pytest.approx(weeks.round(2).tolist())
    sunday = charts.trend(df, "d", "v", "sum", "W", week_start="sunday").first().period
    assert sunday == "2023-12-31"
    assert charts.distinct_days(df, "d", 7) == 7 and charts.distinct_days(df.limit(1), "d", 7) == 1


def test_histograms(spark, frame):
    pdf, df = frame
    v = pdf.v.dropna()
    q1, q3 = v.quantile([0.25, 0.75])
    lo, hi = max(v.min(), q1 - 3 * (q3 - q1)), min(v.max(), q3 + 3 * (q3 - q1))
    want = np.bincount(np.clip(((v - lo) / ((hi - lo) / 10)).astype(int), 0, 9), minlength=10)
    got = charts.histograms(df, ["v"]).orderBy("bin").collect()
    assert [r["count"] for r in got] == want.tolist() and sum(want) == got[0].total and got[0].trimmed
    flat = spark.createDataFrame([(1500.0, 1.0), (1500.0, 3.0)], "x double, y double")
    one = charts.histograms(flat, ["x", "y"]).orderBy("measure", "bin").collect()
    assert (one[0].label, one[0]["count"]) == ("1,500", 2) and len(one) == 11
    assert [r["count"] for r in one[1:]] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert [r.label for r in one[1:3]] == ["1-1.20", "1.20-1.40"]
    axis = charts.histograms(flat, ["y"], bins=12, style="axis").orderBy("bin").collect()
    assert len(axis) == 12 and axis[0].label == "1-1.17" and axis[-1].label == "2.83-3"
    fixed = charts.histograms(flat, ["y"], style="fixed").orderBy("bin").first()
    assert fixed.label == "1.0-1.2"


def test_proportions(spark, frame):
    pdf, df = frame
    counts = pdf.cat.value_counts()
    six, seven = charts.proportions(df, "cat").collect(), charts.explore_proportions(df, "cat").collect()
    assert len(six) == 7 and len(seven) == 8 and six[-1].category == seven[-1].category == "Other"
    assert sum(r.value for r in six) == sum(r.value for r in seven) == counts.sum() == six[0].total
    few = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert [tuple(r) for r in charts.proportions(few, "c").collect()] == [(1, "a", 2, 3), (2, "b", 1, 3)]


def test_statements(spark):
    points = spark.createDataFrame([("2024-01", 10.0), ("2024-02", 12.0), ("2024-03", 12.0), ("2024-04", 5.0)], "period string, value double")
    s = statements.trend_statement(points).first()
    assert (s.direction, s.peak_period, s.change_pct) == ("down", "2024-02", -50.0)
    assert s.stat_summary == "2024-01 - 2024-04: -50 percent; high point 2024-02 with 12."
    assert statements.trend_statement(points.limit(1)).count() == 0
    zero = spark.createDataFrame([("a", 0.0), ("b", 1234.5)], "period string, value double")
    z = statements.trend_statement(zero).first()
    assert z.change_pct is None and z.direction == "flat" and z.stat_summary == "high point b with 1,234."
    bars = spark.createDataFrame([("x", 5.0), ("y", 2.5), ("z", 2.5)], "category string, value double")
    assert statements.bar_statement(bars).first().stat_summary == "From z with 2.50 up to x with 5."
    assert statements.bar_statement(bars.limit(0)).count() == 0


def test_correlation(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1, 4.0) for i in range(50)] + [(None, 5.0, 4.0)], "x double, y double, k double")
    r = explore.correlation_fit(df, "x", "y").first()
    assert (r.n, round(r.r, 9), round(r.slope, 9), round(r.intercept, 9)) == (50, 1.0, 3.0, 1.0)
    assert (r.trend_at_min, round(r.trend_at_max, 6)) == (1.0, 148.0)
    assert r.statement == "x and y: a close link, rising together (correlation 1.00)."
    flat = explore.correlation_fit(df, "x", "k").first()
    assert flat.r is None and flat.slope == 0 and flat.statement is None
    assert explore.correlation_fit(df.where("x = 1"), "x", "y").first().slope is None


def test_scatter_is_every_kth_pair(spark):
    df = spark.range(0, 5500).select("id", F.col("id").cast("double").alias("x"), F.when(F.col("id") % 11 != 0, F.col("id") * 2.0).alias("y"))
    pairs = [i for i in range(5500) if i % 11]
    got = explore.scatter_points(df.repartition(7), "x", "y", ["id"]).orderBy("row").collect()
    assert [int(r.x) for r in got] == pairs[::5] and len(got) <= 1000
    assert explore.scatter_points(df.limit(10), "x", "y", ["id"]).count() == 9


def test_sample_is_repeatable(spark):
    df = spark.range(0, 40_000).select("id", (F.col("id") * 3).alias("v"))
    one = {r.id for r in explore.hash_sample(df, 1500, key=["id"]).collect()}
    two = {r.id for r in explore.hash_sample(df.repartition(3), 1500, key=["id"]).collect()}
    other = {r.id for r in explore.hash_sample(df, 1500, seed=1, key=["id"]).collect()}
    assert len(one) == 1500 and one == two and one != other
    assert abs(np.mean(list(one)) - 20_000) < 1500
    assert explore.hash_sample(df, 50_000).count() == 40_000


def test_quality(spark):
    rows = [("u1", 1.0, None), ("u1", 2.0, None), ("u2", 1.0, "x"), ("u2", 1.0, "x"), ("u3", 1.0, None), ("u3", 1.0, None)]
    rows += [(f"s{i}", float(i), "x") for i in range(40)] + [("far", 9999.0, "x"), (None, 1.0, None), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "name string, v double, note string")
    prof = profile(df)
    assert quality.entity_column(prof) == "name"
    report = quality.quality_report(df, prof)
    assert report["duplicate_rows"] == 2
    assert report["duplicate_entities"]["name"] == {
        "n_repeated_values": 1, "n_affected_rows": 2, "examples": [{"value": "u1", "count": 2}],
    }
    assert report["missing_values"]["name"] == {"count": 2, "pct": 4.1}
    assert report["outliers"]["v"]["examples"] == [9999.0] and not quality.is_clean(report)
    tidy = spark.range(30).select((F.col("id") % 5).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    assert quality.is_clean(quality.quality_report(tidy, profile(tidy)))
    assert {r["column"]: r["n_missing"] for r in quality.missing_values(df).collect()} == {"name": 2, "note": 6}


def test_hot_entity_is_counted_whole(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), "id")).alias("name"), (F.col("id") % 100).alias("v")
    )
    assert quality.entity_summary(rows, "name").first()[:] == (1, 6667)


def test_outliers_need_five_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (999.0,)], "v double")
    assert quality.outlier_report(df, ["v"]).count() == 0
