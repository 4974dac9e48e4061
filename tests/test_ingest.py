import pytest
from pyspark.sql import functions as F

import fixtures
from gridscope.errors import TableError
from gridscope.sources.delimited import column_names, detect_header_row, read_table


def refused(code, spark, path, **options):
    with pytest.raises(TableError) as error:
        read_table(spark, path, **options)
    assert error.value.code == code


def test_header_is_found_below_a_title(spark, text_file):
    lines = [",,,", "Sales report,,,", "", "Date,Item,,Qty", "2024-01-01,A,,1", "2024-01-02,N/A,,2", "2024-01-03,B,"]
    df = read_table(spark, text_file("title.csv", lines))
    assert df.columns == ["Date", "Item", "Qty"]
    assert [tuple(r) for r in df.orderBy("Date").collect()] == [
        ("2024-01-01", "A", "1"), ("2024-01-02", None, "2"), ("2024-01-03", "B", None),
    ]


def test_blank_and_repeated_names(spark, text_file):
    df = read_table(spark, text_file("names.csv", ["a,,a,empty", "1,2,3,", "4,5,6,"]))
    assert df.columns == ["a", "Column 2", "a (2)"]
    assert column_names([None, " ", "x"]) == ["Column 1", "Column 2", "x"]
    assert detect_header_row([("t", None), ("a", "b"), ("c", "d")]) == 1


def test_null_tokens_but_not_dashes(spark, text_file):
    df = read_table(spark, text_file("tokens.csv", fixtures.TOKENS))
    counts = df.agg(F.count("token"), F.count_if(F.col("token") == "-"), F.count_if(F.col("token") == "unknown")).first()
    assert tuple(counts) == (30, 10, 10)


def test_rejections(spark, text_file, tmp_path):
    refused("NO_TABULAR_DATA", spark, text_file("report.csv", fixtures.PROSE))
    refused("NO_TABULAR_DATA", spark, text_file("ragged.csv", ["a,b", "1,2", '"x,y",2,3', "3,4"]))
    refused("NO_TABULAR_DATA", spark, text_file("single.csv", ["Value", "1", "2"]))
    refused("EMPTY_DATASET", spark, text_file("header.csv", ["Name,Amount,Date"]))
    refused("EMPTY_DATASET", spark, text_file("empty.csv", []))
    refused("UNSUPPORTED_FILE_TYPE", spark, text_file("x.pdf", ["a,b"]))
    refused("PARSE_ERROR", spark, str(tmp_path / "absent.csv"))
    refused("EMPTY_DATASET", spark, text_file("corrupted.xlsx", ["This is not a workbook, just text." * 4]))
    wide = [",".join(f"c{i}" for i in range(600)), *[",".join(["1"] * 600)] * 5]
    refused("TOO_MANY_COLUMNS", spark, text_file("wide.csv", wide), max_columns=500)
    book = tmp_path / "real.xlsx"
    book.write_bytes(b"PK\x03\x04\x00\x00binary")
    refused("CORRUPTED_FILE", spark, str(book))


def test_quoted_commas_are_not_extra_fields(spark, text_file):
    df = read_table(spark, text_file("quoted.csv", ['a,b', '"1,000","x ""y"", z"', '2', '3,"p,q"']))
    assert sorted((tuple(r) for r in df.collect()), key=str) == [("1,000", 'x "y", z'), ("2", None), ("3", "p,q")]


def test_mislabelled_workbook_is_read_as_text(spark, text_file):
    df = read_table(spark, text_file("transit.xls", ["id,updated_at,occupancy", "1,2025-04-06T19:31:35-04:00,", "2,,"]))
    assert df.columns == ["id", "updated_at"] and df.count() == 2


def test_folder_with_repeated_headers(spark, tmp_path):
    path = str(tmp_path / "parts")
    source = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit(None).cast("string").alias("none"))
    source.repartition(6).write.option("header", True).csv(path)
    df = read_table(spark, path, format="csv")
    assert df.columns == ["id", "k"]
    assert df.agg(F.count("*"), F.sum(F.col("id").cast("long"))).first()[:] == (1000, 499500)


def test_folder_with_titles_and_files_without_header(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    for name, lines in {
        "a.csv": ["Report 1,", "id,word", "1,x", "id,word", "2,y"], "b.csv": ["Report 2,", "id,word", "3,z", "id,word"],
        "c.csv": ["4,plain", "5,"], "d.csv": ["id,word"],
    }.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    got = read_table(spark, str(folder), format="csv").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("1", "x"), ("id", "word"), ("2", "y"), ("3", "z"), ("id", "word"), ("4", "plain"), ("5", None)], key=str
    )


def test_typed_sources(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).select("id", F.lit("x").alias("x")).write.parquet(path)
    assert read_table(spark, path).count() == 100
    js = str(tmp_path / "t.json")
    spark.range(3).select("id", F.lit("x").alias("x")).write.json(js)
    assert read_table(spark, js).count() == 3


def test_line_breaks_in_quotes(spark, text_file):
    path = text_file("lines.csv", ["a,b", '"one', 'two",2', "x,3"])
    df = read_table(spark, path, multi_line=True)
    assert sorted(r[0] for r in df.collect()) == ["one\ntwo", "x"]
