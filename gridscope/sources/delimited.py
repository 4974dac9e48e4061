"""Reading delimited text whose header row, nulls and shape are not known in advance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridscope.errors import TableError
from gridscope.functions.clean import NULL_TOKENS, null_tokens
from gridscope.operators.profile import batches

SCAN_ROWS = 15
DELIMITED = (".csv",)
WORKBOOKS = (".xls", ".xlsx")
_CORRUPT = "_corrupt"


def read_table(
    spark: SparkSession,
    path: str,
    format: str | None = None,
    max_columns: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read ``path`` as one table.

    ``.csv`` files (or a folder of them, with ``format="csv"``) are read cell by cell: the
    header is the fullest of the first rows, rows above it are dropped, null tokens become
    NULL, blank columns go. Workbook extensions are tried as text, a common mislabelling.
    ``.parquet`` and ``.json`` are already typed. In a folder every file may have titles and
    the header of the first file above its rows; a file without that header keeps all rows.

    ``multi_line`` allows line breaks inside quoted cells, at the price of one task per file.
    """
    lower = path.lower().rstrip("/")
    typed = None
    if format == "parquet" or lower.endswith(".parquet"):
        df = typed = spark.read.parquet(path)
    elif format == "json" or lower.endswith((".json", ".jsonl")):
        df = typed = spark.read.json(path)
    elif format == "csv" or lower.endswith(DELIMITED):
        df = _read_delimited(spark, path, multi_line)
    elif lower.endswith(WORKBOOKS):
        _refuse_binary(spark, path)
        try:
            df = _read_delimited(spark, path, multi_line)
        except TableError as error:
            if error.code == "PARSE_ERROR":
                raise TableError("This file is neither a workbook nor readable as text.", "CORRUPTED_FILE") from error
            raise
    else:
        raise TableError("Unsupported file type; use .csv, .parquet or .json.", "UNSUPPORTED_FILE_TYPE")
    # text columns are kept only when they hold something, so only typed tables can be empty here
    if not df.columns or (typed is not None and typed.isEmpty()):
        raise TableError("The table has no rows.", "EMPTY_DATASET")
    if max_columns is not None and len(df.columns) > max_columns:
        raise TableError(f"{len(df.columns):,} columns, more than the limit of {max_columns:,}.", "TOO_MANY_COLUMNS")
    return df


def _refuse_binary(spark: SparkSession, path: str) -> None:
    """Real workbooks (zip or compound files) have no Spark source."""
    start = spark.read.text(path).limit(1).collect()
    if start and (start[0][0].startswith("PK\x03\x04") or "\x00" in start[0][0] or "�" in start[0][0]):
        raise TableError("Export the sheet to CSV or Parquet first.", "CORRUPTED_FILE")


def _scan(spark: SparkSession, path: str, n_columns: int | None, multi_line: bool) -> DataFrame:
    reader = (
        spark.read.option("header", False).option("escape", '"').option("mode", "PERMISSIVE")
        .option("multiLine", multi_line).option("maxColumns", 200_000)
    )
    if n_columns is not None:
        fields = [T.StructField(f"c{i}", T.StringType()) for i in range(n_columns)]
        schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
        reader = reader.schema(schema).option("columnNameOfCorruptRecord", _CORRUPT)
    return reader.csv(path)


def detect_header_row(rows: list[tuple]) -> int:
    """Index of the row with most non-null cells, the earliest on ties."""
    filled = [sum(cell is not None for cell in row) for row in rows]
    return filled.index(max(filled))


def _read_delimited(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    first, n_files = _first_file(spark, path)
    width = len(_scan(spark, first, None, multi_line).columns)
    if width <= 1:
        raise TableError("No delimited columns were found.", "NO_TABULAR_DATA")

    cells = [f"c{i}" for i in range(width)]
    head = _scan(spark, first, width, multi_line).where(F.col("_metadata.file_block_start") == 0).select(*cells)
    top = [tuple(None if cell in NULL_TOKENS else cell for cell in row) for row in head.limit(SCAN_ROWS).collect()]
    if not top:
        raise TableError("The table has no rows.", "EMPTY_DATASET")
    header_row = detect_header_row(top)
    header = list(top[header_row])
    data = _below_headers(_scan(spark, path, width, multi_line), cells, header)

    counts = _shape_check(data, cells)
    kept = [i for i, c in enumerate(cells) if counts.get(c)]
    names = column_names([header[i] for i in kept])
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    # one SQL fragment per column keeps the plan of very wide tables quick to build
    values = [F.expr(f"CASE WHEN c{i} NOT IN ({tokens}) THEN c{i} END").alias(name) for i, name in zip(kept, names)]
    return data.select(*values)


def _below_headers(rows: DataFrame, cells: list[str], header: list[str | None]) -> DataFrame:
    """The rows of every file below its header line.

    A file's header is the first of its top rows that equals ``header``; it and what stands
    above it go, and nothing else does. A file without one keeps all its rows.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("top"))
    numbered = rows.select("*", place.alias("_at"), F.monotonically_increasing_id().alias("_row"))
    # compared as one array: a chain of 600 conditions is too deep for the planner
    void = "\u0001"
    is_header = F.array(*[F.coalesce(null_tokens(F.col(c)), F.lit(void)) for c in cells]) == F.array(*[F.lit(n or void) for n in header])
    # one row per file; rows of a file's first block are numbered without gaps
    files = (
        numbered.where("_at.top").groupBy(F.col("_at.file").alias("_file"))
        .agg(F.min("_row").alias("_start"), F.min(F.when(is_header, F.col("_row"))).alias("_header"))
        .where(F.col("_header") < F.col("_start") + SCAN_ROWS).drop("_start")
    )
    above = F.col("_at.top") & (F.col("_row") <= F.coalesce("_header", F.lit(-1)))
    return numbered.join(files, F.col("_at.file") == F.col("_file"), "left").where(~above).select(*cells, _CORRUPT)


def _first_file(spark: SparkSession, path: str) -> tuple[str, int]:
    """The first non-empty file below ``path`` in name order, and how many there are."""
    try:
        # only the file listing is read, no content
        files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
        found = files.agg(F.min("_metadata.file_path").alias("first"), F.count("*").alias("n")).first()
    except Exception as error:
        raise TableError(f"Could not read {path}: {error}", "PARSE_ERROR") from error
    if not found["n"]:
        raise TableError("The table has no rows.", "EMPTY_DATASET")
    return found["first"], found["n"]


def _shape_check(data: DataFrame, cells: list[str]) -> dict[str, int]:
    """Filled cells per column, and rejection of records with too many fields; one scan per batch of columns.

    Short records are padded with nulls. Both kinds are flagged by the reader, so the fields
    of flagged records are counted, quoted parts left out.
    """
    outside_quotes = F.regexp_replace(_CORRUPT, r'"([^"]|"")*"', "")
    n_fields = F.length(outside_quotes) - F.length(F.replace(outside_quotes, F.lit(","), F.lit(""))) + 1
    too_long = F.col(_CORRUPT).isNotNull() & (n_fields > len(cells))
    counts: dict[str, int] = {}
    for batch in batches(cells):
        filled = [F.count_if(~F.col(c).isin(NULL_TOKENS)).alias(c) for c in batch]
        counts.update(data.agg(*filled, F.count_if(too_long).alias("")).first().asDict())
    if counts.get(""):
        raise TableError(
            f"{counts['']:,} lines have more fields than the first line; this looks like a report, not a table.",
            "NO_TABULAR_DATA",
        )
    return counts


def column_names(header: list[str | None]) -> list[str]:
    """Blank names become ``Column {position}``; repeated names get a number."""
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(header):
        name = cell.lstrip("﻿") if cell and cell.strip() else f"Column {i + 1}"
        unique, k = name, 2
        while unique in taken:
            unique, k = f"{name} ({k})", k + 1
        names.append(unique)
        taken.add(unique)
    return names

