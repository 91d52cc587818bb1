"""Corpus word error rates by model, and the comparison of two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.wer import round_even, with_word_edits


def corpus_rates(rows: DataFrame) -> DataFrame:
    """(model, reference, prediction) -> (model, wer, num_samples): edits of all rows over words of all references, in per cent."""
    pairs = rows.select("model", words(F.coalesce("reference", F.lit(""))).alias("r"), words(F.coalesce("prediction", F.lit(""))).alias("p"))
    sums = with_word_edits(pairs, "r", "p").groupBy("model").agg(F.sum("edits").alias("e"), F.sum(F.size("r")).alias("n"), F.count(F.lit(1)).alias("num_samples"))
    return sums.select("model", F.when(F.col("n") > 0, round_even(100 * F.col("e") / F.col("n"), 2)).alias("wer"), "num_samples")


def comparison(rates: DataFrame, base: str, tuned: str) -> DataFrame:
    """One row (base, tuned, delta, relative): the gain of rounded rates, and its per cent of the base if there is one."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("wer")))
    two = rates.agg(of(base).alias("base"), of(tuned).alias("tuned")).withColumn("delta", round_even(F.col("base") - F.col("tuned"), 2))
    return two.withColumn("relative", F.when(F.col("delta") > 0, round_even(F.col("delta") / F.col("base") * 100, 1)))
