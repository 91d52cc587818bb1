"""Text columns with Unicode white space and word boundaries that don't depend on the regex engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of Unicode, spelled out: the engines' own classes differ.
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
#: Punctuation that becomes a blank (danda counts, the full stop does not).
PUNCTUATION = r"""[।!?,;:()\[\]"'-]"""


def boundary(chars: str = WORD_CHAR) -> str:
    return f"(?:(?<={chars})(?!{chars})|(?<!{chars})(?={chars}))"


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column by a generator of one row: later filters and expressions use its value, the optimizer can't put the expression into them."""
    return rows.withColumn(name, F.explode(F.array(value)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def normalize_text(text: Column) -> Column:
    """Punctuation to blanks, runs of white space to one blank, none at the ends; case is kept. One pass: a run of either becomes one blank."""
    return F.trim(F.regexp_replace(text, f"[{WS[1:-1]}{PUNCTUATION[1:-1]}]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def tokenize(text: Column) -> Column:
    return words(normalize_text(text))


def preview(text: Column, most: int = 60) -> Column:
    """The first characters of a text, for reports."""
    return F.substring(text, 1, most)


def interleaved(text: Column, pattern: str) -> tuple[Column, Column]:
    """What lies between the matches of a pattern, and the matches: one fewer."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
