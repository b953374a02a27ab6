"""From documents to packed training sequences, in stages that are each written and reread.

Language identification and the quality classifier drop what they reject, exact
deduplication keeps one row of equal texts, SimHash keeps one document of each
group of near-copies, and packing gives the pieces of the sequences. All stages
but the last return the columns of ``documents``, whatever further columns it has.

Texts are read whole, at any length. Rows with a null doc_id go through all stages
like others. An empty table stays empty, and gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushlake.llm import compression, exact, language, packing, simhash
from hushlake.llm.common import ready, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and those that no language explains with a score of 0.5.

    Repeated rows share their fate. Where no row has a language, nothing is learned and all rows go.
    """
    ready(spark)
    return language.keep_known(docs, language.fit(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose score for label 1 is under 0.5; without labels of both kinds every score is 0.5 and all rows stay.

    Null and empty texts have the curve's value at zero. Repeated rows share their fate.
    """
    ready(spark)
    return compression.keep_good(docs, compression.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest original, then the smallest doc_id, null last.

    Null, empty and blank texts are one group; of repeated rows one stays.
    """
    ready(spark)
    return exact.keep_one(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of near-copies.

    Rows that repeat that doc_id stay together; rows without one stay only if nothing in their component has one.
    Texts without words have fingerprint zero and are near-copies of each other.
    """
    ready(spark)
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, cut into sequences of 1024 tokens: their ids, and crc32 of these.

    A null or empty text is its end mark; repeated rows are packed as often as they occur.
    """
    ready(spark)
    return packing.pack(docs, both=True)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("packing", packing_stage),
]

#: Models, hash tables over all texts and a tokenizer: no SQL gives these rows; tests compare with brute force.
ORACLE_SQL = None


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder before the next reads them."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the rows of ``packed``, whose ids are in the written table, with the columns of op10_packing."""
    return packed(spark, sf_dir).drop("ids")
