"""Join and grouping keys that stay narrow and spread hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridscope.functions.clean import kind_of, quoted, value_of

BROADCAST_ROWS = 50_000  # a side is broadcast only when counted and at most this long
SALTS = 32
WIDE_TEXT = 64  # texts longer than this travel through shuffles as a SHA-256 digest


def narrow_text(text: Column) -> Column:
    """A text short enough to shuffle: itself, or a marked SHA-256 digest when long."""
    return F.when(F.length(text) > WIDE_TEXT, F.concat(F.lit("\u0001"), F.sha2(text, 256))).otherwise(text)


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """One narrow column equal for two rows exactly when all ``columns`` are equal.

    Nulls equal nulls. Each cell is written with its length, so no two different rows
    share a text; the text is then replaced by its SHA-256 digest.
    """
    cells = []
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        value = value_of(field.name, field.dataType)
        if kind_of(field.dataType) == "other":
            value = F.to_json(F.struct(value.alias("v")))
        text = value.cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.unhex(F.sha2(F.concat(*cells), 256))


def attach(rows: DataFrame, facts: DataFrame, by: Sequence[str], n_facts: int) -> DataFrame:
    """Join per-group ``facts`` to ``rows`` on ``by``.

    ``n_facts`` is the counted number of fact rows. A short fact table is broadcast: its keys
    travel as digests where they are long, so that its size is bounded in bytes too. A long
    one is repeated over :data:`SALTS` salts while each row takes one salt from its place in
    its task, so the rows of one hot group meet their facts in many tasks, also if they are
    all alike.
    """
    texts = [k for k in by if facts.schema[k].dataType == T.StringType()]
    narrow = {k: f"_narrow_{i}" for i, k in enumerate(texts)}
    rows = rows.withColumns({short: narrow_text(F.col(quoted(k))) for k, short in narrow.items()}) if narrow else rows
    facts = facts.withColumns({short: narrow_text(F.col(quoted(k))) for k, short in narrow.items()}).drop(*narrow) if narrow else facts
    keys = [narrow.get(k, k) for k in by]
    if n_facts <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts), keys).drop(*narrow.values())
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        .join(salted, [*keys, "_salt"])
        .drop("_salt", *narrow.values())
    )


def measures_long(df: DataFrame, measures: dict[str, Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """``(keep..., measure, value)`` with one row per non-null measure value of a row."""
    keep = keep or {}
    flat = df.select(*[c.alias(k) for k, c in keep.items()], *[c.alias(f"m{i}") for i, c in enumerate(measures.values())])
    names = list(measures)
    pairs = F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(f"m{i}").alias("value")) for i, name in enumerate(names)
    ])
    long = flat.select(*keep, F.inline(pairs))
    return long.where(F.col("value").isNotNull())
