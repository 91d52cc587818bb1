"""Label batches: padding with a mask, begin-of-sequence stripping, and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.wer import round_even, with_word_edits

IGNORED = -100


def padded(rows: DataFrame, batch: str, labels: str, bos: int) -> DataFrame:
    """Labels of a batch to its longest, IGNORED behind; if every row of the batch begins with ``bos``, that column goes."""
    sizes = rows.groupBy(batch).agg(F.max(F.size(labels)).alias("_most"), F.bool_and(F.coalesce(F.get(labels, F.lit(0)) == bos, F.lit(False))).alias("_bos"))
    wide = rows.join(sizes, batch).withColumn(labels, F.concat(labels, F.array_repeat(F.lit(IGNORED), F.col("_most") - F.size(labels))))
    return wide.withColumn(labels, F.when(F.col("_bos"), F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))).otherwise(F.col(labels))).drop("_most", "_bos")


def unmasked(labels: Column, pad: int) -> Column:
    return F.transform(labels, lambda x: F.when(x == IGNORED, pad).otherwise(x))


def compute_metrics(rows: DataFrame, predictions: str, labels: str, decode: Callable[[Column], Column], pad: int) -> DataFrame:
    """One row (edits, ref_words, wer): both id columns decoded, masked labels as ``pad``, and the pooled rate in per cent. ``decode`` turns ids into text and drops special ids."""
    texts = rows.select(decode(F.col(predictions)).alias("p"), decode(unmasked(F.col(labels), pad)).alias("r")).select(words(F.col("p")).alias("p"), words(F.col("r")).alias("r"))
    edits = with_word_edits(texts, "r", "p").agg(F.sum("edits").alias("edits"), F.sum(F.size("r")).alias("ref_words"))
    return edits.withColumn("wer", F.when(F.col("ref_words") > 0, round_even(100 * F.col("edits") / F.col("ref_words"), 2)))
