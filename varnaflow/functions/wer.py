"""Word error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


#: Distinct words of a pair that fit in one UTF-16 unit each, from 257 to before the surrogates; and in all of Unicode.
FIRST = 256
NARROW_WORDS, WIDE_WORDS = 0xD800 - FIRST - 1, 0x110000 - 0x800 - FIRST - 1


def round_even(x: Column | str, digits: int) -> Column:
    """A double to so many decimals as SQL engines do it: times a power of ten, to the nearest whole number (halves to the even one), and back.

    ``bround`` goes by the shortest decimal form instead: 87 / 40 is stored just below 2.175 and becomes 2.18 there, 2.17 here.
    """
    scale = float(10**digits)
    return F.rint((F.col(x) if isinstance(x, str) else x) * scale) / scale


def with_word_edits(rows: DataFrame, reference: str, hypothesis: str, edits: str = "edits") -> DataFrame:
    """Adds the edit distance of two columns of word arrays. Each distinct word of the pair becomes a character, and the built-in distance does the rest.

    Pairs of more than NARROW_WORDS distinct words get characters of all of Unicode but the surrogates; one of more than WIDE_WORDS (1.1 million) is an error, never a wrong count.
    The distinct words come out of a generator of one row: the optimizer can't put their expression into the lambda, where each word would compute it again.
    """
    known = rows.withColumn("_known", F.explode(F.array(F.array_distinct(F.concat(reference, hypothesis)))))
    place = lambda w: F.lit(FIRST) + F.array_position("_known", w)
    skipped = lambda k: k + F.when(k >= 0xD800, F.lit(0x800)).otherwise(F.lit(0))
    narrow = lambda ws: F.decode(F.unhex(F.array_join(F.transform(ws, lambda w: F.lpad(F.hex(place(w)), 4, "0")), "")), "UTF-16BE")
    wide = lambda ws: F.decode(F.unhex(F.array_join(F.transform(ws, lambda w: F.lpad(F.hex(skipped(place(w))), 8, "0")), "")), "UTF-32")
    n = F.coalesce(F.size("_known"), F.lit(0))
    too_many = F.raise_error(F.lit("more distinct words in a pair than characters")).cast("int")
    distance = F.when(n <= NARROW_WORDS, F.levenshtein(narrow(reference), narrow(hypothesis))).when(n <= WIDE_WORDS, F.levenshtein(wide(reference), wide(hypothesis))).otherwise(too_many)
    return known.withColumn(edits, distance.cast("long")).drop("_known")


def standard_wer(edits: Column, reference: Column) -> Column:
    """Edits per reference word; an empty reference counts as one word."""
    return edits / F.greatest(F.size(reference), F.lit(1))


def scoring_words(text: Column) -> Column:
    """Lower case, punctuation removed, split on blanks."""
    return F.filter(F.split(strip(F.regexp_replace(F.lower(text), r"\p{P}", "")), " "), lambda w: w != "")


def utterance_wer(edits: Column, reference: Column) -> Column:
    """Edits per reference word; 1 for an empty reference."""
    return F.when(F.size(reference) == 0, F.lit(1.0)).otherwise(edits / F.size(reference))
