"""The cleanup as a streaming transformation: narrow, without state, so a batch and a stream give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codemix import tag_english_words
from ..functions.numbers import normalize_numbers
from ..functions.text import once


def cleaned(rows: DataFrame, text: str = "text", grapheme: bool = False) -> DataFrame:
    """Adds after_numbers, final, number_changes and english_words; works on batches and streams."""
    source = F.col(text)
    unchanged = F.struct(source.alias("text"), F.array().cast("array<struct<original:string,converted:string,reason:string,skipped:boolean>>").alias("changes"))
    numbers = F.when(source.rlike(r"\p{InDevanagari}"), normalize_numbers(source, grapheme)).otherwise(unchanged)  # all number words are in that script
    rows = once(rows, "_n", numbers).withColumn("_t", tag_english_words(F.col("_n.text")))
    return rows.select(*[c for c in rows.columns if c not in ("_n", "_t")], F.col("_n.text").alias("after_numbers"), F.col("_t.tagged").alias("final"), F.col("_n.changes").alias("number_changes"), F.col("_t.english_words").alias("english_words"))


def example_notes(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds before, numbers (null where no number changed), after, and a note for each number and the English words found."""
    told = F.transform("number_changes", lambda c: F.when(c.skipped, F.concat(c.original, F.lit(": idiom, kept"))).otherwise(F.concat(c.original, F.lit(" → "), c.converted)))
    return rows.withColumns({
        "before": F.col(text), "numbers": F.when(F.col("after_numbers") != F.col(text), F.col("after_numbers")), "after": F.col("final"),
        "number_notes": told, "english_note": F.when(F.size("english_words") > 0, F.array_join("english_words", ", ")),
    })
