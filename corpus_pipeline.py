"""A corpus from raw documents to packed sequences, in five stages.

Each stage reads what the one before wrote, and its decisions take effect.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spoolmark.llm import exact_dedup, ngram_join, quality, queries, toxicity
from spoolmark.llm.tables import Workspace, read

#: Words of a shingle and least similarity, in per cent, of near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Rows that Spark and its Python workers exchange at once: whole texts are long.
BATCH_ROWS = 1000


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network does not reject."""
    sample = toxicity.labelled_sample(docs, read(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, toxicity.fitted(sample))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, taught by weak labels, does not reject."""
    model, _ = quality.learn(docs)
    return quality.good_documents(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets."""
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, SIMILARITY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences."""
    return queries.packed(docs)


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage in a session that exchanges ``BATCH_ROWS`` rows at once, which bounds its memory."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", in_small_batches(without_toxic)),
    ("quality", in_small_batches(good_quality)),
    ("exact dedup", in_small_batches(without_copies)),
    ("n-gram join", in_small_batches(without_near_copies)),
    ("packing", in_small_batches(packed)),
]

#: Trained models decide two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
