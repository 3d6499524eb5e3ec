"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Toxic texts go, one of each class of similar texts stays, contaminated texts go,
secrets are masked, and what is left is encoded.  All stages but the last keep
the columns of ``documents``, whatever others there are and however these are
named.  Every stage takes empty tables, null and empty texts, null ids and
repeated ids and rows; what becomes of them is told at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import digests
from quarry.llm.common import cut, documents, prepared, table
from quarry.llm.decontaminate import remove_contaminated
from quarry.llm.ngram_join import keep_one
from quarry.llm.secret_scan import redact_secrets
from quarry.llm.toxicity import remove_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; the classifier learns from the rows and labels of its folds.

    A null or empty text has the score of a text without features and equal rows have equal scores; rows
    without an id are in the fold of the empty text, labels without an id count for none.
    """
    return remove_toxic(docs, table(prepared(spark), sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of similar texts.

    Texts without a word are similar to nothing and all stay; equal texts are similar, rows equal in id and
    text become one; a row without an id stays only if no similar one has an id.
    """
    prepared(spark)
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    Texts without a word are never contaminated; equal rows stay or go together; items without an id count.
    """
    return remove_contaminated(docs, table(prepared(spark), sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The spans of a text that are secrets are masked, and n_chars counts the new text; identifiers and endpoints stay.

    A null text stays null; every row is masked by itself.
    """
    prepared(spark)
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, number of ids, digest of the ids and of the bytes that they decode to; a null text has no ids."""
    prepared(spark)
    return digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode_texts),
]

#: Classifier training and tokenization are not SQL; tests/llm/test_pipeline.py holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepared(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
