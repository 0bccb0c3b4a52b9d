"""The corpus pipeline: stages from raw documents to token ids, each written before the next reads it.

Language ID, one of each group of near-duplicates, repeated passages cut, sources mixed, and byte-level BPE.
Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terraql.llm.byte_bpe import round_trip
from terraql.llm.language_id import identified
from terraql.llm.mixing import mixed_documents
from terraql.llm.shared import remove, shared_dir
from terraql.llm.simhash import keep_one
from terraql.llm.suffix_dedup import without_passages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of 0.5 or more. Null and empty texts and those without a letter go."""
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link, that of the smallest doc_id; of repeated rows one stays."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 or more words that another document has too; those that lose all their words go."""
    return without_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources as documents: some more than once, some in part, some not at all; those of no source are one source."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, the ids' number and digest, and the digest of the decoded bytes."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing to target weights", mixture), ("byte-level BPE", tokens)]

#: Logistic regression, connected components and byte pair merging are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again.

    A stage's folder goes when the next one is written; the last one stays for whoever reads the result. An empty table, and
    one whose documents all go, give no rows; extra columns of documents come through, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
