"""Helpers that several operators share: reading, staging and text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridscope.session import scratch_path

#: The white space that parts words, as bytes 0x20 and 0x09 to 0x0D.
SPACE_CLASS = r"[ \t\n\x0B\f\r]"

#: What a worker keeps from one task to the next: one thing at most.
_kept: dict[tuple, Any] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    What follows starts from files that outlive any executor, and every branch sees the
    same rows.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_share(column: str, parts: int) -> Column:
    """Remainder of the CRC-32 of a column's text; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(parts)


def local_file(path: str) -> str:
    """A file that Spark has sent to every node (``sent:NAME``), or one that is installed there."""
    return SparkFiles.get(path[len("sent:"):]) if path.startswith("sent:") else path


def kept(make: Callable[..., Any], *of: Any) -> Any:
    """``make(*of)``, kept in this worker for later tasks, until another thing is kept or :func:`forget` is called."""
    if (make, of) not in _kept:
        forget()
        _kept[make, of] = make(*of)
    return _kept[make, of]


def forget() -> None:
    """Free what tasks of another kind have left in this worker, which Spark uses again for any task."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()


def column_of(batch: pa.RecordBatch | pa.Table, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for k, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(size)
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def rows_with(docs: DataFrame, marks: DataFrame, on: dict[str, Column], key: str) -> DataFrame:
    """The rows of ``docs`` whose values ``on`` occur in ``marks`` (columns of the same names), nulls included.

    Of rows with the same key, or none, that also agree in ``on``, one stays; only repeated
    keys are looked at for that.
    """
    marks = staged(marks.select(*[F.col(name).alias(f"__mark_{name}") for name in on]).distinct(), "marks")
    held = docs.withColumns({f"__on_{name}": value for name, value in on.items()})
    match = [F.col(f"__on_{name}").eqNullSafe(F.col(f"__mark_{name}")) for name in on]
    held = held.join(marks, match, "left_semi")
    repeated = staged(
        docs.groupBy(F.col(key).alias("__mark_key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"), "repeated",
    )
    same = [key, *[f"__on_{name}" for name in on]]
    parts = []
    if not repeated.where(F.col("__mark_key").isNull()).isEmpty():
        # Rows without a key are dealt by what else they agree in, never joined by their key.
        parts.append(held.where(F.col(key).isNull()).dropDuplicates(same))
        held = held.where(F.col(key).isNotNull())
    repeated = repeated.where(F.col("__mark_key").isNotNull())
    if not repeated.isEmpty():
        again = F.col(key) == F.col("__mark_key")
        parts.append(held.join(repeated, again, "left_semi").dropDuplicates(same))
        held = held.join(repeated, again, "left_anti")
    for part in parts:
        held = held.unionByName(part)
    return held.select(docs.columns)
