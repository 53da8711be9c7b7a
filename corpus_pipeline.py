"""From raw documents to packed sequences: language ID, toxicity, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and is written as Parquet before the next one
reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import langid, orderhash, packing, toxicity
from loomtext.llm.common import shared_dir, table
from loomtext.llm.queries import language_model, toxicity_model


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: null texts, texts without letters, texts unlike any language. Rows with a
    null id and repeated rows are judged by their text like all others; an empty table stays empty."""
    return langid.accepted(docs, language_model(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; null and empty texts stay, and so do repeated rows if one does."""
    return toxicity.accepted(docs, toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays, with all rows that have it. Null texts
    and null ids are in no group and stay."""
    return orderhash.first_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 ids; null and empty texts hold the end id alone, longer texts are
    cut, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL can express neither the models nor the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{where}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
