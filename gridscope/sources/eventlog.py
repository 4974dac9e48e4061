"""An append-only usage log: one JSON or Parquet record per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The fields of a log record.
EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("ts", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("upload_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("n_rows", T.IntegerType()),
    T.StructField("n_cols", T.IntegerType()),
    T.StructField("n_sheets", T.IntegerType()),
    T.StructField("n_charts", T.IntegerType()),
    T.StructField("chart_types", T.ArrayType(T.StringType())),
    T.StructField("overridden_columns", T.ArrayType(T.StringType())),
    T.StructField("elapsed_ms", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("detail", T.StringType()),
])


def append_events(events: DataFrame, path: str, format: str = "json") -> None:
    """Add records to the log; earlier ones are never touched.

    Where ``events`` has no ``ts`` column, its records are stamped with the time of writing, in
    epoch seconds; a null ``ts`` stays null, for a record whose time is not known. Records
    without an ``id`` get one.
    """
    if "ts" not in events.columns:
        events = events.withColumn("ts", F.unix_micros(F.current_timestamp()) / F.lit(1e6))
    own = F.coalesce(F.col("id").cast("string"), F.uuid()) if "id" in events.columns else F.uuid()
    events = events.withColumn("id", own)
    events.write.mode("append").format(format).save(path)


def read_events(spark: SparkSession, path: str, event_type: str | None = "upload_succeeded") -> DataFrame:
    """Log records with ``ts`` as written (ISO text or epoch seconds); broken lines are skipped."""
    events = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return events if event_type is None else events.where(F.col("event_type") == event_type)


def moment_of(ts: Column) -> Column:
    """Timestamp of a log ``ts``: epoch seconds, or ISO text."""
    seconds = ts.try_cast("double")
    return F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)).otherwise(ts.try_cast("timestamp"))
