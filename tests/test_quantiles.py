import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridscope.functions import clean
from gridscope.operators import keys, quantiles, robust
from gridscope.operators.quantiles import exact_quantiles

PROBS = [0.25, 0.5, 0.75]


def skewed(n=6000, seed=7):
    rng = np.random.default_rng(seed)
    values = np.concatenate([
        np.full(n // 3, 42.0), rng.lognormal(3, 2, n // 3), rng.normal(-5, 1e-6, n - 2 * (n // 3) - 2), [1e300, -1e300],
    ])
    groups = np.where(rng.random(len(values)) < 0.8, "hot", rng.choice(list("abc"), len(values)))
    return pd.DataFrame({"g": groups, "value": values})


def test_quantiles_are_interpolated(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf).repartition(5)
    found = exact_quantiles(df, ["g"], PROBS)
    rows = {r["g"]: r for r in found.frame.collect()}
    assert found.groups == len(rows) == 4
    for g, part in pdf.groupby("g"):
        assert rows[g]["n"] == len(part)
        assert (rows[g]["v_min"], rows[g]["v_max"]) == (part.value.min(), part.value.max())
        assert rows[g]["q"] == pytest.approx(part.value.quantile(PROBS).tolist(), rel=1e-9)


def test_trimmed_mean_matches_brute_force(spark):
    pdf = skewed()
    pdf = pdf[pdf.value.abs() < 1e200]
    df = spark.createDataFrame(pdf)
    for r in robust.trimmed_stats(df, ["g"]).collect():
        v = pdf[pdf.g == r["g"]].value
        q1, q3 = v.quantile([0.25, 0.75])
        lo, hi = q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)
        inner = v[(v >= lo) & (v <= hi)] if q3 != q1 else v
        assert r["trimmed_mean"] == pytest.approx(inner.mean())
        assert r["n_extreme"] == (0 if q3 == q1 else int(((v < lo) | (v > hi)).sum()))
        assert v.min() <= r["trimmed_mean"] <= v.max()


def test_infinite_values_are_no_measures(spark):
    df = spark.createDataFrame([(float(k % 10),) for k in range(200)] + [(float("inf"),), (float("-inf"),), (float("nan"),)], "v double")
    rows = keys.measures_long(df, {"v": clean.number_of("v", df.schema["v"].dataType)})
    row = robust.spread(rows, ["measure"]).frame.first()
    assert (row.n, row.v_min, row.v_max, row.q2) == (200, 0.0, 9.0, 4.5)


def test_partitioning_does_not_matter(spark):
    pdf = skewed()
    pdf = pdf[pdf.value.abs() < 1e200]
    one = spark.createDataFrame(pdf).coalesce(1)
    for part_a, part_b in zip(*[
        robust.spread(df, ["g"]).frame.orderBy("g").collect() for df in (one, one.repartition(8))
    ]):
        assert part_a == part_b


def test_trimmed_range_degenerates_to_the_full_range(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [5] * 10 + [100]], "g string, value double")
    low, high = robust.trimmed_range()
    row = robust.spread(df, ["g"]).frame.select(low.alias("lo"), high.alias("hi"), robust.zero_anchor().alias("z")).first()
    assert (row.lo, row.hi, row.z) == (5.0, 100.0, True)
    years = spark.createDataFrame([("a", float(v)) for v in range(1925, 2025)], "g string, value double")
    assert not robust.spread(years, ["g"]).frame.select(robust.zero_anchor().alias("z")).first().z


def test_row_key_tells_rows_apart(spark):
    df = spark.createDataFrame(
        [("a", None), ("a", ""), (None, "a"), ("a:1", "b"), ("a", ":1b"), ("a", None), ("~", None)], "x string, y string"
    )
    assert df.select(keys.row_key(df).alias("k")).distinct().count() == 6
    numbers = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    assert numbers.select(keys.row_key(numbers).alias("k")).distinct().count() == 2


def test_long_texts_are_compared_by_digest(spark):
    df = spark.createDataFrame([("x" * 100,), ("x" * 100,), ("x" * 101,), ("short",)], "t string")
    keyed = df.select(keys.narrow_text(F.col("t")).alias("k"))
    assert keyed.distinct().count() == 3
    assert keyed.agg(F.max(F.length("k"))).first()[0] == 65


def test_long_and_short_tables_agree(spark, monkeypatch):
    """A counted table over the bound is dealt out in ranges; statistics are the same."""
    df = spark.range(3000).selectExpr("concat('g', id % 7) g", "cast((id * 37) % 811 as double) value").where("value % 5 <> 0 or g <> 'g3'")
    short = robust.trimmed_stats(df, ["g"]).orderBy("g").collect()
    monkeypatch.setattr(quantiles, "SHORT", 10)
    assert robust.trimmed_stats(df, ["g"]).orderBy("g").collect() == short


def test_facts_meet_rows_by_long_keys(spark, monkeypatch):
    """Keys longer than a digest, one of them on most rows, with and without broadcast."""
    long = F.when(F.col("id") % 3 > 0, F.repeat(F.lit("hot "), 400)).otherwise(F.concat(F.repeat(F.lit("key "), 400), F.col("id") % 50))
    df = spark.range(2000).select(long.alias("g"), F.col("id").cast("double").alias("value"))
    few = robust.trimmed_stats(df, ["g"]).orderBy("g").collect()
    assert len(few) == 51 and few[0]["g"].startswith("hot hot")
    monkeypatch.setattr(keys, "BROADCAST_ROWS", 5)
    assert robust.trimmed_stats(df, ["g"]).orderBy("g").collect() == few
