"""Registered queries of the subpackage and their reference SQL.

Every query takes ``(spark, folder)``, applies its operator to the whole of its table and
returns the whole result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridscope.llm import bpe, html_extract, language_id, lexical_search, license_scan, merkle, ngram_lm, toxicity
from gridscope.llm.block_dedup import exact_duplicates
from gridscope.llm.common import crc_share, staged, table
from gridscope.llm.jaccard_join import near_duplicates
from gridscope.llm.packing import pack, pieces_of
from gridscope.llm.quality_rules import judge, reference_sql
from gridscope.llm.sharding import shard_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and the verdict of the line rules for every document."""
    return judge(table(spark, folder, "documents"))


@query
def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """A bigram model learned from four fifths of ``documents``, and the score of all of it."""
    docs, held_out = table(spark, folder, "documents"), crc_share("doc_id", 5) == 1
    model = ngram_lm.train(docs, ~held_out)
    return ngram_lm.score(docs, model).withColumns({"held_out": held_out, "train_tokens": F.lit(model.tokens).cast("long")})


@query
def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents with a Jaccard similarity of 0.9 or more on 3-word shingles."""
    return near_duplicates(table(spark, folder, "documents")).drop("row")


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Languages learned from two thirds of ``documents`` and told for all of it."""
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs, ~language_id.held_out())
    told = language_id.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packed_documents(table(spark, folder, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Documents cut and packed by the production parameters, with a digest of each piece's ids."""
    pieces = staged(pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False), "pieces")
    return pack(pieces).drop("row")


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices that documents hold to 80 percent or more."""
    return license_scan.scan(table(spark, folder, "documents"))


SQL["op6_license_scan"] = license_scan.reference_sql()


@query
def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, folder, "pages"))


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards by jump hash of ``doc_id``."""
    return shard_documents(table(spark, folder, "documents")).withColumn("law", F.lit("key"))


@query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents that are equal without white space, by block naming."""
    return exact_duplicates(table(spark, folder, "documents")).drop("n_chars")


@query
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded into ids by a rank file, and the ids decoded again."""
    return bpe.encode_digests(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence scores learned from three quarters of the labelled ``documents``, and the noisy-or of all."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~toxicity.held_out())
    told = toxicity.score(docs, model)
    return told.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("sentences").alias("n_sentences"))


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every item of ``benchmark``."""
    segments = lexical_search.index(table(spark, folder, "documents"))
    return lexical_search.search(segments, table(spark, folder, "benchmark"))


SQL["op12_lexical_search"] = lexical_search.SQL


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and verdict of every document; a third of them show a text in lower case."""
    docs = table(spark, folder, "documents")
    tamper = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.proofs(docs, tampered={"text": merkle.lower_ascii(F.col("text"))}, tamper=tamper)


SQL["op13_merkle_manifest"] = merkle.reference_sql()

SQL["op1_quality_rules"] = reference_sql()

SQL["op3_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)])
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS members
  FROM w
),
e AS (SELECT doc_id, len(members) AS n, unnest(members) AS m FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e AS a JOIN e AS b ON a.m = b.m AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, b.y FROM reach AS r JOIN both_ways AS b ON b.x = r.other
)
SELECT s.doc_id, len(s.members) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) AS c USING (doc_id)
"""

SQL["op9_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS s FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) = 1 AS kept,
       sha256(s) AS text_sha256
FROM d
"""
