"""Daily activity, as one aggregate over the log or as a continuously updated table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridscope.session import scratch_path


def daily_activity(events: DataFrame, moment: Column, by: list[str] | None = None) -> DataFrame:
    """``day, by..., n``; records without a time are left out."""
    by = by or []
    days = events.select(F.to_date(moment).alias("day"), *by).where(F.col("day").isNotNull())
    return days.groupBy("day", *by).agg(F.count("*").alias("n")).orderBy("day", *by)


def usage_totals(events: DataFrame, moment: Column) -> DataFrame:
    """``total, days_active``; records without a time count in the total only."""
    return events.select(F.to_date(moment).alias("day")).groupBy("day").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("day").alias("days_active")
    )


def daily_activity_stream(
    events: DataFrame, moment: Column, by: list[str] | None = None, lateness: str | None = None
) -> DataFrame:
    """The same counts over a streaming ``events``, in one-day windows.

    The state is one counter per day and group, so by default it is kept and no event comes
    too late. With ``lateness`` a day is closed, and its state dropped, once events that much
    later were seen; still later events are then ignored.
    """
    by = by or []
    timed = events.select(moment.cast("timestamp").alias("_ts"), *by).where(F.col("_ts").isNotNull())
    if lateness:
        timed = timed.withWatermark("_ts", lateness)
    windows = timed.groupBy(F.window("_ts", "1 day"), *by)
    return windows.agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), *by, "n")


def start_daily_activity(counts: DataFrame, table: str, checkpoint: str, **trigger: str | bool) -> StreamingQuery:
    """Keep ``table`` (Parquet) at the newest count of every day seen in new files.

    ``trigger`` is Spark's, such as ``processingTime="1 minute"`` for a stream that keeps
    running; by default what is there now is read once.

    Each micro-batch writes the days it changed under its own number, so that a repeated
    batch after a failure replaces itself; :func:`read_daily_activity` merges them.
    """
    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return (
        counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()
    )


def read_daily_activity(spark: SparkSession, table: str, by: list[str] | None = None) -> DataFrame:
    """Latest count per day: the one of the highest batch."""
    by = by or []
    return spark.read.parquet(table).groupBy("day", *by).agg(F.max_by("n", "batch").alias("n"))


def run_daily_activity(events: DataFrame, moment: Column, by: list[str] | None = None) -> DataFrame:
    """Stream everything available now through :func:`daily_activity_stream` and read the result."""
    spark = events.sparkSession
    table, checkpoint = scratch_path(spark, "activity"), scratch_path(spark, "activity-checkpoint")
    query = start_daily_activity(daily_activity_stream(events, moment, by), table, checkpoint)
    query.awaitTermination()
    return read_daily_activity(spark, table, by)
