"""Typed records: a table with every column in its inferred type, ready to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridscope.functions.clean import kind_of, number_of, quoted, value_of
from gridscope.functions.dates import date_of
from gridscope.operators.explore import hash_sample
from gridscope.operators.profile import Profile
from gridscope.session import scratch_path

KEPT_TYPES = ("numeric_measure", "date", "categorical", "boolean", "identifier")
MAX_MEAN_LENGTH = 60


def lookup_columns(prof: Profile) -> list[str]:
    """Columns worth keeping in records: all typed ones and free text that is short on average."""
    df = prof.df
    texts = prof.of_type("free_text")
    short: set[str] = set()
    if texts:
        types = {f.name: f.dataType for f in df.schema.fields}
        lengths = df.agg(*[
            F.avg(F.length(value_of(c, types[c]).cast("string"))).alias(f"a{i}") for i, c in enumerate(texts)
        ]).first()
        short = {c for i, c in enumerate(texts) if lengths[i] is None or lengths[i] <= MAX_MEAN_LENGTH}
    return [c for c, info in prof.columns.items() if info["type"] in KEPT_TYPES or c in short]


def typed_records(prof: Profile, columns: list[str] | None = None, sample: int | None = None) -> DataFrame:
    """Dates as ISO day text, measures as doubles, everything else as text; nulls stay null."""
    df = prof.df
    chosen = lookup_columns(prof) if columns is None else columns
    types = {f.name: f.dataType for f in df.schema.fields}
    source = df if sample is None else hash_sample(df, sample)
    out = []
    for c in chosen:
        kind = prof.columns[c]["type"]
        if kind == "date":
            value = F.to_date(date_of(c, types[c])).cast("string")
        elif kind == "numeric_measure":
            value = number_of(c, types[c])
        else:
            value = value_of(c, types[c]).cast("string")
        out.append(value.alias(c))
    return source.select(*out)


def inferred_types(prof: Profile) -> DataFrame:
    """The profiled table with text columns read as what they were found to be: days and numbers.

    Columns that are typed already are left untouched, so filters on them still reach the scan.
    """
    out = []
    for field in prof.df.schema.fields:
        kind, cell = prof.columns.get(field.name, {}).get("type"), F.col(quoted(field.name))
        if kind_of(field.dataType) == "text" and kind == "date":
            cell = F.to_date(date_of(field.name, field.dataType))
        elif kind_of(field.dataType) == "text" and kind == "numeric_measure":
            cell = number_of(field.name, field.dataType)
        out.append(cell.alias(field.name))
    return prof.df.select(*out)


def write_records(records: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Write records as JSON lines (nulls included) or Parquet."""
    writer = records.write.mode(mode)
    if format == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(format).save(path)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Worth it for text sources before several operators read them: later scans then take only
    the columns they need.
    """
    path = scratch_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
