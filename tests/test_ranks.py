"""Rows at wanted ranks against a sort on the driver."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridscope.errors import TableError
from gridscope.operators import ranks

NAN, INF = float("nan"), float("inf")
VALUES = {
    "double": [None, -INF, -1e308, -2.5, -2.0, -1.9999999999999998, -5e-324, 0.0, 5e-324, 2.2e-308, 0.1, 1.0, 1.0000000000000002, 7.999999999999999, 8.0, 1e22, 1.7976931348623157e308, INF, NAN],
    "bigint": [None, -(2**63), -17, -1, 0, 1, 255, 256, 2**63 - 1],
    "decimal(20,4)": [None, Decimal("-100.5"), Decimal("-100.4999"), Decimal("-0.0001"), Decimal("0"), Decimal("3.2"), Decimal("31")],
    "string": [None, "", " ", "A", "Aa", "Aa ", "B", "a", "é", "語"],
    "boolean": [None, False, True],
    "date": [None, dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2024, 2, 29)],
    "timestamp": [None, dt.datetime(1950, 1, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 1)],
    "timestamp_ntz": [None, dt.datetime(1950, 1, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 1)],
}


@pytest.mark.parametrize("dtype", VALUES)
def test_sort_text_ascends_like_the_column(spark, dtype):
    values = list(enumerate(VALUES[dtype]))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame(values, f"place int, v {dtype}")
    got = ranks.with_sort_text(df, ["v"]).collect()
    assert [r.place for r in sorted(got, key=lambda r: r._key)] == list(range(len(values)))
    assert len({r._key for r in got}) == len(values)


def _places(spark, monkeypatch, df, order_by, points, **limits):
    for name, value in limits.items():
        monkeypatch.setattr(ranks, name, value)
    rows = [tuple(r) for r in df.collect()]
    others = [c for c in df.columns if c not in order_by]
    ordered = sorted(rows, key=lambda r: [(r[df.columns.index(c)] is not None, r[df.columns.index(c)] or 0 if not isinstance(r[df.columns.index(c)], str) else r[df.columns.index(c)].encode()) for c in [*order_by, *others]])
    step = max(1, math.ceil(len(rows) / points))
    want = [(k, *ordered[k]) for k in range(0, len(rows), step)]
    for parts in (1, 7):
        got = sorted(tuple(r) for r in ranks.every_kth(df.repartition(parts), order_by, points).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert got == want


@pytest.mark.parametrize("ranges", [300, 65_536])
def test_every_kth_in_narrow_ranges(spark, monkeypatch, ranges):
    df = spark.range(1500).select((F.col("id") * 37 % 1501 - 900).alias("k"), (F.col("id") % 13 / 4).alias("x"))
    _places(spark, monkeypatch, df, ["k"], 40, RANKED=5, RANGES=ranges)


def test_hot_keys_and_shared_beginnings(spark, monkeypatch):
    """A third of the rows are one row, another third one key, the rest share a long beginning."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "same").when(n % 3 == 1, "held").otherwise(F.concat(F.lit("same beginning of every text " * 30), (n * 7 % 1000).cast("string")))
    df = spark.range(1800).select(key.alias("k"), F.when(n % 3 == 0, 1.5).otherwise(n / 8).alias("x"))
    _places(spark, monkeypatch, df, ["k"], 50, RANKED=40, RANGES=5000)


def test_every_kth_of_little(spark):
    df = spark.range(9).select("id", F.lit(None).cast("double").alias("x"))
    assert sorted(r.row for r in ranks.every_kth(df, ["id"], 4).collect()) == [0, 3, 6]
    assert ranks.every_kth(df.where("id < 0"), ["id"], 4).count() == 0
    same = spark.range(50).select(F.lit(1).alias("id"))
    assert sorted(r.row for r in ranks.every_kth(same, ["id"], 10).collect()) == list(range(0, 50, 5))
    with pytest.raises(TableError):
        ranks.every_kth(df.select(F.array("id").alias("id")), ["id"], 4)
