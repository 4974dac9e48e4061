"""Exact duplicates by deterministic block naming.

A text without white space is cut into blocks of fixed size. Equal blocks get equal integer
names by sorting; then pairs of neighbouring names get names the same way, again and again,
until every document has a single name. Two documents have the same name exactly if their
texts are equal: names come from comparing blocks and pairs, never from a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridscope.llm.common import SPACE_CLASS, rows_with, staged, text_or_empty

#: A name is a rank inside one of 2**20 buckets; the bucket is part of the name.
BUCKET_BITS, RANK_BITS = 20, 40


def normalised(text: Column) -> Column:
    """A text without its white space."""
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def _hot(rows: DataFrame, hot_share: int, *more: Column) -> tuple[list[int], list]:
    """Keys that hold at least one in ``hot_share`` rows, by a bounded sketch, and further aggregates.

    Fewer than ``hot_share`` keys can be hot. A key missed or named too much costs time, not
    correctness.
    """
    found = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"approx_top_k(__key, {hot_share}, {20 * hot_share})").alias("top"), *more,
    ).first()
    least = max(1000, found["n"] // hot_share)
    return [t["item"] for t in found["top"] or [] if t["count"] >= least and t["item"] is not None], list(found)[2:]


def _named(rows: DataFrame, things: list[str], hot: list[int], salts: int, carry: list[str], label: str) -> DataFrame:
    """``rows`` (with ``__key``, a hash of ``things``) with ``name``: equal exactly for equal things.

    Rows meet in buckets by ``__key``; in a bucket, the rank among its sorted things is the
    name. Rows of a hot key are spread over ``salts`` buckets, so that each thing has up to
    ``salts`` names at first, of which the least becomes everyone's. Those are at most
    ``len(hot) * salts`` names, which is the bound of the broadcast.
    """
    place, inside = F.struct("__salt", *things), Window.partitionBy("__bucket").orderBy("__salt", *things)
    is_hot = F.col("__key").isin(hot) if hot else F.lit(False)
    ranked = (
        rows.withColumn("__hot", is_hot)
        .withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64("row", "pos"), F.lit(salts)) + F.lit(1)).otherwise(F.lit(0)))
        .withColumn("__bucket", F.pmod(F.xxhash64("__key", "__salt"), F.lit(1 << BUCKET_BITS)))
        .withColumn("__raw", F.col("__bucket") * F.lit(1 << RANK_BITS) + F.dense_rank().over(inside))
        .withColumn("__begins", F.coalesce(F.lag(place).over(inside) != place, F.lit(True)))
    )
    if not hot:
        return staged(ranked.select(*carry, F.col("__raw").alias("name")), label)
    thing = F.when(F.col("__hot") & F.col("__begins"), F.struct(*things))
    written = staged(ranked.select(*carry, "__raw", thing.alias("__thing")), label)
    begun = written.where(F.col("__thing").isNotNull()).select("__thing", "__raw")
    least = begun.groupBy("__thing").agg(F.min("__raw").alias("__name"))
    common = begun.join(least, "__thing").select("__raw", "__name")
    return written.join(F.broadcast(common), "__raw", "left").select(*carry, F.coalesce("__name", "__raw").alias("name"))


def block_names(
    docs: DataFrame, text: str, extra: dict[str, Column], block_chars: int = 1024, hot_share: int = 1000, salts: int = 64,
) -> DataFrame:
    """``row``, the columns of ``extra``, and ``(level, name)``, the identity of the row's text without white space.

    Every level halves the names of the documents that still have several; documents with a
    single name leave. The number of levels is the logarithm of the longest text's blocks.
    """
    squeezed = docs.select(
        F.monotonically_increasing_id().alias("row"), normalised(text_or_empty(text)).alias("__text"),
        F.struct(*[c.alias(k) for k, c in extra.items()]).alias("__extra"),
    )
    cut = F.regexp_extract_all(F.col("__text"), F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    blocks = (
        squeezed.select("row", "__extra", F.when(F.col("__text") == "", F.array(F.lit(""))).otherwise(cut).alias("__blocks"))
        .select("row", "__extra", (F.size("__blocks") - 1).cast("long").alias("last"), F.posexplode_outer("__blocks").alias("pos", "block"))
        .select(
            "row", F.col("pos").cast("long").alias("pos"), "last", "block", F.xxhash64("block").alias("__key"),
            F.when(F.col("pos") == 0, F.col("__extra")).alias("__extra"),
        )
    )
    carry = ["row", "pos", "last", "__extra"]
    hot, (longest,) = _hot(blocks, hot_share, F.max("last"))
    current, level, done = _named(blocks, ["block"], hot, salts, carry, "names-0"), 0, []
    while True:
        done.append(current.where(F.col("last") == 0).select("row", "__extra", F.lit(level).alias("level"), "name"))
        if not longest:
            break
        odd = F.col("pos") % 2 == 1
        pairs = staged(
            current.where(F.col("last") > 0).groupBy("row", F.shiftright("pos", 1).alias("pos"), F.shiftright("last", 1).alias("last"))
            .agg(
                F.max(F.when(~odd, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(0)).alias("right"),
                F.any_value("__extra", True).alias("__extra"),
            ).withColumn("__key", F.xxhash64("left", "right")),
            f"pairs-{level + 1}",
        )
        level, longest = level + 1, longest // 2
        hot, _ = _hot(pairs, hot_share)
        current = _named(pairs, ["left", "right"], hot, salts, carry, f"names-{level}")
    everyone = done[0]
    for more in done[1:]:
        everyone = everyone.unionByName(more)
    return everyone.select("row", "__extra.*", "level", "name")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = 1024) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256, n_chars`` for every row of ``docs``.

    Texts are equal when they are after deleting all white space; a null text counts as
    empty, and empty texts are equal to each other. Of equal texts, the row with the most code
    points in the original text stays, then the least key (nulls last), then the first row of
    the scan, so that repeated rows leave exactly one. Other columns of ``docs`` are not read.
    An empty table gives no rows.
    """
    whole = text_or_empty(text)
    named = block_names(docs, text, {
        "key": F.col(key), "n_chars": F.length(whole).cast("long"), "text_sha256": F.sha2(normalised(whole), 256),
    }, block_chars)
    best = staged(
        named.groupBy("level", "name").agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct((-F.col("n_chars")).alias("long"), F.col("key").isNull().alias("void"), "key", "row")).alias("best"),
        ),
        "groups",
    )
    return named.join(best, ["level", "name"]).select(
        F.col("key").alias(key), F.col("best.key").alias("keep_id"), "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"), "text_sha256", "n_chars",
    )


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    told = exact_duplicates(docs, key, text).where("kept")
    whole = text_or_empty(text)
    on = {"key": F.col(key), "n_chars": F.length(whole).cast("long"), "text_sha256": F.sha2(normalised(whole), 256)}
    return rows_with(docs, told.withColumnRenamed(key, "key"), on, key)
