"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of ``documents``, whatever other columns there are. In every stage a null
text passes as it is, a null doc_id is a value like any other unless the stage says otherwise, very
long texts are read whole, rows that repeat are kept or go alike, and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tetraspark.llm import bpe, decontaminate, simhash_dedup, suffix_dedup, toxicity
from tetraspark.llm.common import keep, read
from tetraspark.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts are not predicted toxic.

    Null and empty texts have no feature and get the classifier's bias, which is below 0.5; with no
    labelled toxic row nothing is learned and all stay.
    """
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Rows with a null text or a null doc_id stay as they are. Texts without words are copies of each
    other. Of rows that share the smallest id all stay.
    """
    return simhash_dedup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that occur elsewhere as well.

    Null texts stay null, texts that are cut whole become empty, n_chars is counted anew.
    """
    return suffix_dedup.remove_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows that share an id, null included, go together."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each row; null texts count as empty."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: No SQL expresses the classifier, the suffix array or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the cluster's shared folder and read again.

    The files go when the driver ends.
    """
    name = f"pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (stage, step) in enumerate(STAGES):
        docs = keep(step(spark, docs, sf_dir), f"{name}/{i}-{stage}")
    return docs
