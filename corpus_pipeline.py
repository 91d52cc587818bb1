"""From documents to token ids: toxicity, line dedup, near duplicates, mix, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs. All
but the last return the columns of ``docs``. The mix repeats a document that it takes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varnaflow.llm import boilerplate, mixing, ngram_join, pieces, toxicity
from varnaflow.llm.shared import stored


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.accepted(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source leave its documents; every document stays."""
    return boilerplate.cleaned_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return ngram_join.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text."""
    return pieces.encoded(docs, pieces.vocabulary_path())


STAGES = [("toxicity", toxicity_filter), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", sentencepiece)]

#: A trained classifier and Viterbi are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
