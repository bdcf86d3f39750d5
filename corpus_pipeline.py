"""Documents to packed training sequences, stage by stage.

Every stage takes the table its predecessor kept, written as Parquet and read again, and
returns the rows it keeps, with the columns of ``documents``; the last one returns the
pieces of the kept documents with their places in the sequences. As a stage's rows have been
written when the next stage is called, it removes the tables that the one before stored for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinseframe.llm import near, quality, queries, substrings
from rinseframe.llm.frames import Scratch, remembered
from rinseframe.plans.lineage import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: what the last stage called has stored for rows that are read once, to be written
LEFT: list[Scratch] = []


def before_the_next(stage: Stage) -> Stage:
    """The stage, remembered until the next one is called."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with remembered(LEFT):
            return stage(spark, docs, sf_dir)

    return call


def after_the_last(stage: Stage) -> Stage:
    """The stage, called when what the one before stored is gone."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while LEFT:
            LEFT.pop().release()
        return stage(spark, docs, sf_dir)

    return call


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the limits of their language and source; the others go."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group linked by 5-word shingles at 0.8 or more."""
    return near.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word passages that a document of smaller id has; n_chars follows the text."""
    found = substrings.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's token ids placed in sequences of at most 1024."""
    return queries.packed_pieces(docs, "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", before_the_next(quality_rules)),
    ("near dedup", after_the_last(before_the_next(near_dedup))),
    ("substring dedup", after_the_last(before_the_next(substring_dedup))),
    ("best-fit packing", after_the_last(packing)),
]

#: tokenization has no SQL; the tests hold run() against plain Python instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
