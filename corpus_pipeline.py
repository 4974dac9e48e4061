"""From raw documents to packed training sequences, in five stages.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and
returns a DataFrame, which is written as Parquet and read again for the next one. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridscope.llm import block_dedup, jaccard_join, language_id, quality_rules
from gridscope.llm.common import staged, table
from gridscope.llm.queries import packed_documents


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those too far from every language learned from ``docs``."""
    model = language_id.fit(docs, ~language_id.held_out())
    return language_id.identify(docs, model).where("not lang_rejected").select(docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that fail a rule, and documents that fail or lose too much."""
    return quality_rules.clean(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, keep the longest, then the least ``doc_id``."""
    return block_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, keep the least ``doc_id``."""
    return jaccard_join.without_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left into sequences of 2048 ids."""
    return packed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Language identification and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
