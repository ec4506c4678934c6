"""The corpus pipeline over ``documents``: quality, lines, near-duplicates, benchmark, mix.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet in the shared
folder and read again as the next stage's ``docs``.  All but the last return the columns of
``docs``.  Rows with null texts count as empty; they have too little evidence to be good and
usually go in the first stage.  Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger.llm.common import read, small_batches, written
from tickledger.llm.decontaminate import clean
from tickledger.llm.line_dedup import freed
from tickledger.llm.mixing import mix
from tickledger.llm.near_dup import keep_one
from tickledger.llm.quality_classifier import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (poor or toxic) go."""
    small_batches(spark)
    return keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from every document but the first that bears them; a document of nothing else goes.

    ``n_chars`` follows the text.
    """
    small_batches(spark)
    rows = freed(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more."""
    small_batches(spark)
    return keep_one(docs, 5, 80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go."""
    small_batches(spark)
    return clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes words of; those of which it takes none go.

    ``whole`` says how often a document is repeated whole, ``part_words`` how many of its first
    words follow; ``taken`` are both together.
    """
    return mix(docs).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
]

#: The classifier and the latent search cannot be written as SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
