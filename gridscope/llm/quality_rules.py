"""Quality rules that clean lines first and judge documents afterwards.

Every line is held against punctuation, navigation and boilerplate rules; lines that fail are
removed, and a document that loses too much of its text that way is rejected. All of it is
column expressions over one row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridscope.llm.common import SPACE_CLASS, text_or_empty

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

#: Fixed values of the line rules.
CLOSING = ".!?…:;,\"'”’»)]}。！？：；，、」』）"
#: Closing punctuation of any script beyond ASCII, but for dots and signs that part or mark items.
CLOSING_ANYWHERE = r"[\p{Po}\p{Pe}\p{Pf}“‘«‹&&[^\x00-\x7F·•‧∙§¶¡¿‰†‡※]]"
BLANKS = " \t\n\x0B\f\r"
SHORT_LINE = 60
#: Words of a line of running text; two letters of a script without spaces count as one.
RUNNING_WORDS = 4
WORD = (
    r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]{2}"
    r"|[^ \t\n\x0B\f\r\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]+"
)
SEPARATED = r" [|•›»·/>→-] "
SHOUT = r"[!?]{2,}"
BOILERPLATE = (
    r"(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|subscribe|newsletter|sign (in|up)\b|\blog ?in\b"
    r"|click here|read more|enable javascript|share this|follow us|back to top)"
)
BOILERPLATE_LINE = 200
#: A document must keep this percentage of its characters outside white space.
KEEP_PERCENT = 50


def count_of(value: Column, pattern: str) -> Column:
    """Characters of ``value`` in a character class."""
    return F.length(value) - F.length(F.regexp_replace(value, pattern + "+", ""))


def _closed(solid: Column) -> Column:
    last = F.substring(solid, -1, 1)
    return F.instr(F.lit(CLOSING), last).cast("boolean") | F.rlike(last, F.lit(CLOSING_ANYWHERE))


def reads_on(line: Column, after: Column) -> Column:
    """Whether a line without closing punctuation goes on in the next: in lower case, or both have the words of running text."""
    words, more = (F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))) for x in (line, after))
    lower = F.rlike(after, F.lit(r"^[ \t]*\p{Ll}")) & (words + more >= 2 * RUNNING_WORDS)
    return lower | (words >= RUNNING_WORDS) & (more >= RUNNING_WORDS)


def line_fails(line: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """Whether one of the line rules rejects a line. Lines of white space only never fail.

    * punctuation: symbols are a tenth or more of the line, or three or more pile-ups of
      exclamation or question marks, or a short line without closing punctuation that
      neither reads on in the line ``after`` it nor goes on from the one ``before``;
    * navigation: three or more separated items, of four words at most on average;
    * boilerplate: a short line with a phrase of web-page furniture.
    """
    solid, size = F.rtrim(line, F.lit(BLANKS)), F.length(line)
    alone = F.lit(True)
    if after is not None:
        alone &= ~reads_on(line, after)
    if before is not None:
        alone &= _closed(F.rtrim(before, F.lit(BLANKS))) | ~reads_on(before, line)
    separators = F.size(F.regexp_extract_all(line, F.lit(SEPARATED), F.lit(0)))
    spaces = count_of(line, " ")
    return (solid != "") & (
        ((size < SHORT_LINE) & ~_closed(solid) & alone)
        | (F.lit(10) * count_of(line, SYMBOLS) >= size)
        | (F.contains(line, F.lit("!!")) | F.contains(line, F.lit("??"))) & (F.size(F.regexp_extract_all(line, F.lit(SHOUT), F.lit(0))) >= 3)
        | (separators >= 3) & (F.lit(4) * separators >= spaces - separators)
        | (size < BOILERPLATE_LINE) & F.rlike(line, F.lit(BOILERPLATE))
    )


def _window_hashes(docs: DataFrame) -> DataFrame:
    """``__windows``: hashes of every 8-word window, from hashes of 1, 2 and 4 words."""
    docs = docs.withColumn("__h1", F.transform("__words", lambda w: F.xxhash64(w)))
    for width in (1, 2, 4):
        source, rest = F.col(f"__h{width}"), F.size(f"__h{width}") - width
        docs = docs.withColumn(f"__h{2 * width}", F.when(
            rest > 0, F.zip_with(F.slice(source, 1, rest), F.slice(source, width + 1, rest), lambda a, b: F.xxhash64(a, b))
        ).otherwise(F.array().cast("array<bigint>")))
    return docs.withColumnRenamed("__h8", "__windows")


def _repeat_words(docs: DataFrame) -> DataFrame:
    """``n_repeat_words``: words covered by windows that occur twice or more in the text."""
    docs = _window_hashes(docs)
    docs = docs.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    table = F.col("__sorted")
    docs = docs.withColumn("__starts", F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(table) - 1), lambda k: F.coalesce(F.get(table, k - 1)["h"] == F.get(table, k)["h"], F.lit(False))
                 | F.coalesce(F.get(table, k + 1)["h"] == F.get(table, k)["h"], F.lit(False))),
        lambda k: F.get(table, k)["i"],
    )))
    starts = F.col("__starts")
    gaps = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def _judged(docs: DataFrame, carry: Column, text: str) -> DataFrame:
    """``__row`` (``carry``), the counts and verdicts of every row, and ``__clean``, its text without the failed lines."""
    words = F.array_remove(F.split("__text", SPACE_CLASS + "+"), "")
    docs = docs.select(carry.alias("__row"), text_or_empty(text).alias("__text")).withColumn("__words", words)
    docs = docs.select(
        "__row", "__words", F.size("__words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__text", SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
        count_of(F.col("__text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.split("__text", "\n").alias("__lines"),
    )
    full = F.filter("__lines", lambda line: F.regexp_replace(line, SPACE_CLASS + "+", "") != "")
    docs = docs.withColumn("__full", full)
    docs = docs.withColumn("n_dup_lines", (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long"))
    near = lambda i: F.coalesce(F.get("__lines", i), F.lit(""))
    docs = docs.withColumn("__passed", F.filter("__lines", lambda line, i: ~line_fails(line, near(i - 1), near(i + 1)))).drop("__full")
    docs = docs.withColumn("__clean", F.array_join("__passed", "\n"))
    docs = docs.withColumn("__kept_chars", F.when(F.size("__passed") == F.size("__lines"), F.col("word_chars")).otherwise(
        F.length(F.regexp_replace("__clean", SPACE_CLASS + "+", ""))
    )).drop("__lines", "__passed")
    docs = _repeat_words(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))
    enough = F.lit(100) * F.col("__kept_chars") >= F.lit(KEEP_PERCENT) * F.col("word_chars")
    return docs.select(
        "__row", "__clean", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & enough).alias("kept"), (F.lit(100) * F.col("__kept_chars") / F.greatest("word_chars", F.lit(1))).alias("kept_percent"),
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, base counts, ``base_failed``, ``kept`` and ``kept_percent``.

    A null text counts as empty and fails. Repeated rows are judged each. Other columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    judged = _judged(docs, F.col(key), text).drop("__clean")
    return _settled(judged).select(F.col("__row").alias(key), *judged.columns[1:])


def _settled(judged: DataFrame) -> DataFrame:
    """The same rows behind a generator: a filter on a verdict would be pushed below its parts and repeat them."""
    whole = F.struct(*[F.col(c) for c in judged.columns])
    return judged.select(F.explode(F.array(whole)).alias("r")).select("r.*")


def clean(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and without the lines that fail.

    ``size``, where there is such a column, becomes the number of the cleaned text's characters.
    """
    judged = _judged(docs, F.struct(*[F.col(c) for c in docs.columns]), text)
    passed = judged.select(F.explode_outer(F.when(F.col("kept"), F.array(F.struct("__row", "__clean")))).alias("r")).where("r is not null")
    made = {text: F.col("r.__clean")} | ({size: F.length("r.__clean").cast("long")} if size in docs.columns else {})
    kinds = dict(docs.dtypes)
    return passed.select(*[(made[c].cast(kinds[c]) if c in made else F.col("r.__row")[c]).alias(c) for c in docs.columns])


def reference_sql() -> str:
    """The result of :func:`judge` on ``documents``, in DuckDB SQL."""
    closing, space = CLOSING.replace("'", "''"), r"[\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, [x FOR x IN regexp_split_to_array(t, '{space}') IF x <> ''] AS ws,
         length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols
  FROM d
),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS pos, ws FROM w WHERE len(ws) >= {WINDOW}),
told AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[pos:pos + {WINDOW - 1}], ' ')) AS n FROM windows),
repeated AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM told, range({WINDOW}) AS r(k) WHERE n > 1 GROUP BY doc_id
),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
facts AS (
  SELECT doc_id, l, length(regexp_replace(l, '{space}', '', 'g')) AS chars, rtrim(l, ' ') AS solid, length(l) AS size,
         length(l) - length(regexp_replace(l, '{SYMBOLS}', '', 'g')) AS symbols, length(l) - length(replace(l, ' ', '')) AS spaces,
         len(regexp_extract_all(l, '{SEPARATED}')) AS separators, len(regexp_extract_all(l, '{SHOUT}')) AS shouts
  FROM lines
),
judged AS (
  SELECT doc_id, l, chars, solid <> '' AND (
    (size < {SHORT_LINE} AND NOT contains('{closing}', right(solid, 1))) OR 10 * symbols >= size
    OR ((contains(l, '!!') OR contains(l, '??')) AND shouts >= 3)
    OR (separators >= 3 AND 4 * separators >= spaces - separators)
    OR (size < {BOILERPLATE_LINE} AND regexp_matches(l, '{BOILERPLATE}'))) AS failed
  FROM facts
),
kept AS (
  SELECT doc_id, coalesce(sum(chars) FILTER (WHERE NOT failed), 0) AS kept_chars,
         count(*) FILTER (WHERE chars > 0) - count(DISTINCT l) FILTER (WHERE chars > 0) AS n_dup_lines
  FROM judged GROUP BY doc_id
),
f AS (
  SELECT doc_id, len(ws) AS n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, kept_chars,
         len(ws) < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEAT_PERCENT} * len(ws) AS base_failed
  FROM w JOIN kept USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * kept_chars >= {KEEP_PERCENT} * word_chars AS kept,
       CAST(100 * kept_chars AS DOUBLE) / greatest(word_chars, 1) AS kept_percent
FROM f
"""
