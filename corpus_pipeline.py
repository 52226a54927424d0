"""A corpus pipeline of five stages over ``documents``; each reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from tidemill.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.

    Null and empty texts have the model's prior, which keeps them unless most labels are toxic; rows that repeat an id are
    judged one by one; texts are read whole. An empty table stays empty, and without labels all documents stay. All columns
    keep their own values, whatever their names.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays.

    A null text equals an empty one; a row without an id stays only if no equal text has one; of rows that repeat id and
    text one stays; texts are compared whole. An empty table stays empty. All columns keep their own values.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays.

    Null and blank texts have fingerprint zero and are one group; rows without an id and rows that repeat the id that
    stays are kept; texts are read whole. An empty table stays empty. All columns keep their own values.
    """
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a test item's shingles go.

    Null and empty texts hold nothing and stay; all rows of an id that matches go; texts are read whole. An empty table
    stays empty, and without items all documents stay. All columns keep their own values.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix reads, with size, source_size, target, taken (words, repeats counted) and slots (what the
    schedule reads when: slot, pass, first_word, words).

    Documents without words are not read; a null source is one of its own; rows that repeat an id are documents of their
    own; a text may fill many slots. An empty table stays empty. A column named like a figure gives way to it.
    """
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mix", mix_sources),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
