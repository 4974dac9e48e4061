import pytest
from pyspark.sql import functions as F

from gridscope.errors import TableError
from gridscope.operators.filters import cross_filter, matches, where_all

CASES = [
    ("No", "==", True, False), ("Yes", "==", True, True), ("Yes", "==", "yes", True), ("YES", "==", True, True),
    ("1", "==", "true", True), ("0", "==", False, True), ("Y", "==", "N", False), ("No", "!=", True, True),
    ("2024-06-15", ">", "2024-01-01", True), ("2024-01-01", ">", "2024-06-15", False),
    ("2024-06-15", "<", "2025-01-01", True), ("2024-06-15", ">=", "2024-06-15", True),
    ("2023-12-31", ">", "2024-01-01", False),
    (5, "==", 5, True), (1, "==", 2, False), (10, ">", 5, True), (3, ">", 5, False), (5, "<=", 5, True),
    ("East", "==", "east", True), ("East", "==", "West", False), ("East", "!=", "West", True),
    (None, "==", "East", False),
]
MORE = [
    (None, "!=", "East", False), (None, ">", 1, False), ("maybe", "!=", True, True), ("maybe", "==", True, False),
    (1.0, "==", "yes", True), (0.0, "==", "yes", False), (7.0, "!=", "yes", True), (5.0, "==", "5", True),
    ("5.0", "==", 5, True), ("abc", "==", 5, False), ("abc", "!=", 5, True), ("10", ">", "9", True),
    ("b", ">", "a", True), (" yes ", "==", "true", True), ("10", ">", 9, True), (2.0, "==", True, False),
]


@pytest.mark.parametrize("cell,operator,value,expected", CASES + MORE)
def test_filter_cases(spark, cell, operator, value, expected):
    kind = "string" if cell is None or isinstance(cell, str) else "double"
    df = spark.createDataFrame([(cell if kind == "string" else float(cell),)], f"x {kind}")
    assert where_all(df, [{"column": "x", "operator": operator, "value": value}]).count() == int(expected)


def test_unknown_column_and_operator_are_refused(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(TableError) as error:
        matches(df, "region", "==", "East")
    assert error.value.code == "UNKNOWN_COLUMN"
    with pytest.raises(TableError) as error:
        matches(df, "x", "~", "East")
    assert error.value.code == "UNKNOWN_OPERATOR"


def test_typed_date_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    days = spark.range(40).select(F.expr("timestamp'2024-01-01 13:00:00' + make_interval(0,0,0,id)").alias("ts"), "id")
    days.write.parquet(path)
    df = spark.read.parquet(path)
    kept = cross_filter(df, "ts", "2024-01-05", "2024-01-10")
    assert sorted(r.id for r in kept.collect()) == list(range(4, 10))
    few = where_all(df, [{"column": "id", "operator": ">=", "value": "37"}])
    assert few.count() == 3 and "GreaterThanOrEqual(id,37)" in few._jdf.queryExecution().executedPlan().toString()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    on = where_all(df, [{"column": "ts", "operator": "==", "value": "2024-01-10"}])
    assert [r.id for r in on.collect()] == [9]
    after = where_all(df, [{"column": "ts", "operator": ">", "value": "2024-01-10"}])
    assert min(r.id for r in after.collect()) == 10


def test_cross_filter_drops_null_dates_and_is_case_sensitive(spark):
    df = spark.createDataFrame([("2024-01-01", "A"), (None, "A"), ("2024-02-01", "a")], "d string, c string")
    assert cross_filter(df, "d", start="2024-01-01").count() == 2
    assert cross_filter(df, "d", end="2024-01-31").count() == 1
    assert cross_filter(df, category_column="c", category="A").count() == 2
    assert cross_filter(df, "d").count() == 3
