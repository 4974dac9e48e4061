"""Ad-hoc exploration of two measures: correlation, fitted line, scatter points; samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gridscope.functions.clean import number_of, quoted
from gridscope.operators.ranks import every_kth
from gridscope.operators.statements import correlation_statement

SCATTER_POINTS = 1000
SEED = 42


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(
        number_of(x, df.schema[x].dataType).alias("x"), number_of(y, df.schema[y].dataType).alias("y")
    ).dropna()


def correlation_fit(df: DataFrame, x: str, y: str, x_label: str | None = None, y_label: str | None = None) -> DataFrame:
    """Pearson r, least-squares line, its two end points, and a statement. One aggregate.

    Taken over all complete pairs. Fewer than two pairs or no variance give NULLs.
    """
    stats = _pairs(df, x, y).agg(
        F.count("*").alias("n"),
        # corr itself divides by zero when a side does not vary
        F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"),
    )
    enough = (F.col("n") >= 2) & (F.col("x_min") < F.col("x_max"))
    both = enough & (F.col("y_min") < F.col("y_max"))
    fit = stats.select(
        "n",
        F.when(both, F.col("r")).alias("r"),
        F.when(enough, F.col("slope")).alias("slope"),
        F.when(enough, F.col("intercept")).alias("intercept"),
        "x_min", "x_max",
    )
    return fit.select(
        "*",
        (F.col("slope") * F.col("x_min") + F.col("intercept")).alias("trend_at_min"),
        (F.col("slope") * F.col("x_max") + F.col("intercept")).alias("trend_at_max"),
        correlation_statement(F.col("r"), x_label or x, y_label or y).alias("statement"),
    )


def scatter_points(
    df: DataFrame, x: str, y: str, order_by: list[str], points: int = SCATTER_POINTS
) -> DataFrame:
    """``row, x, y``: every ``ceil(n / points)``-th complete pair in the given order, ties by ``x`` and ``y``."""
    keys = [F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(order_by)]
    pairs = df.select(
        *keys, number_of(x, df.schema[x].dataType).alias("x"), number_of(y, df.schema[y].dataType).alias("y")
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return every_kth(pairs, [f"_k{i}" for i in range(len(order_by))], points).select("row", "x", "y")


def hash_sample(df: DataFrame, n: int, seed: int = SEED, key: list[str] | None = None) -> DataFrame:
    """``n`` rows chosen by a seeded hash of ``key`` (all columns by default).

    The same rows come back whatever the partitioning: those whose MD5 of seed and key
    (texts, parted by ``|``) starts lowest, ties by the whole row. Rows well below the wanted
    share are in, those well above are out, and only the narrow band between is ranked.
    Tables of at most ``n`` rows come back whole.
    """
    total = df.count()
    if total <= n:
        return df
    columns = [F.col(quoted(c)) for c in (key or df.columns)]
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary")), 1, 13)
    draw = (F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))).alias("_u")
    drawn = df.select("*", draw)
    share = n / total
    margin = 6 * math.sqrt(share / total)
    low, high = max(0.0, share - margin), share + margin
    while True:
        seen = drawn.agg(F.count_if(F.col("_u") < low).alias("sure"), F.count_if(F.col("_u") < high).alias("near")).first()
        if seen.sure > n:
            low /= 2
        elif seen.near < n:
            high *= 2
        else:
            break
    sure = drawn.where(F.col("_u") < low)
    band = drawn.where((F.col("_u") >= low) & (F.col("_u") < high))
    edge = band.orderBy("_u", *[quoted(c) for c in [*(key or []), *df.columns]]).limit(n - seen.sure)
    return sure.unionByName(edge).drop("_u")
