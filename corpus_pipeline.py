"""A training-data pipeline of five stages over documents; each writes Parquet that the next one reads.

Every stage takes nulls in any column, empty and very long texts (read whole), ties, repeated rows and ids, empty tables
(empty results) and columns of any other names, which all stages but the last hand on. What becomes of such rows is said
at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.common import scratch, shared_dir, table
from kinlink.llm.op01_quality import accepted
from kinlink.llm.op04_pieces import default_model, encode_documents
from kinlink.llm.op08_copies import one_of_each
from kinlink.llm.op09_mixture import mixed
from kinlink.llm.op10_private import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. A null text is judged as an empty one; rows that repeat are judged alike; without labels none goes."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id, once. Texts without words and rows with a null doc_id all stay."""
    return one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked in the text; n_chars stays as delivered, null texts stay null, and no row goes."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none included; texts without words have size 0 and are not taken. Null sources are one source."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and of the decoded text, a row for each row; a null text is encoded as an empty one."""
    return encode_documents(docs, default_model(), with_ids=True)


STAGES = [("quality", quality), ("near_copies", near_copies), ("private", private), ("mixture", mixture), ("pieces", pieces)]

#: The classifier and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
