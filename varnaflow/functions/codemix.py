"""Latin-script words in Hindi text: [EN]word[/EN]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS

#: Romanised Hindi that is no English.
FALSE_POSITIVES = ("ji", "hai", "ho", "na", "nhi", "haan", "thik", "ok", "hmm", "ah")
#: Words that are English beyond doubt. They change no result, as everything Latin counts as English; ``surely_english`` shows them.
DEFINITE_ENGLISH = (
    "the", "is", "are", "was", "were", "i", "you", "he", "she", "we", "they", "this", "that", "it", "and", "or", "but", "not", "have", "has", "had",
    "will", "would", "can", "could", "should", "may", "might", "do", "does", "did", "a", "an", "in", "on", "at", "by", "for", "from", "to", "of", "with",
)
#: The edge characters of the classifier, of the tagger and of the list of found words.
CLASSIFIER_EDGE, TAGGER_EDGE, LISTED_EDGE = r"""[.,!?;:"'()\[\]{}]""", r"""[,।!?;:"'()\[\]]""", "[.,!?;:]"


_NO_SPACE = f"[^{WS[1:]}"
_BEGIN, _END = f"(?<![!-~])(?<!{_NO_SPACE})", f"(?![!-~])(?!{_NO_SPACE})"  # the short range first: it decides nearly all positions
_EDGE = TAGGER_EDGE.replace("।", "")  # an English token has ASCII only
#: A whole English token, in three groups: outer punctuation, the word, outer punctuation.
TOKEN = (
    f"{_BEGIN}(?={CLASSIFIER_EDGE}*+[A-Za-z][A-Za-z0-9'-]*+{CLASSIFIER_EDGE}*+{_END})(?!{CLASSIFIER_EDGE}*+(?i:{'|'.join(FALSE_POSITIVES)}){CLASSIFIER_EDGE}*+{_END})"
    f"({_EDGE}*+)([!-~]*(?!{_EDGE})[!-~])({_EDGE}*+)"
)


def _bare(token: Column, edge: str) -> Column:
    return F.regexp_replace(token, f"^{edge}+|{edge}+$", "")


def is_english_word(token: Column) -> Column:
    clean = _bare(token, CLASSIFIER_EDGE)
    return clean.rlike("^[A-Za-z][A-Za-z0-9'-]*$") & ~F.lower(clean).isin(*FALSE_POSITIVES)


def surely_english(token: Column) -> Column:
    return F.lower(_bare(token, CLASSIFIER_EDGE)).isin(*DEFINITE_ENGLISH)


def tag_english_words(text: Column) -> Column:
    """struct(tagged, english_words): white space and outer punctuation stay as they are. One scan of the text tags, one lists the words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: _bare(t, LISTED_EDGE))
    return F.struct(F.regexp_replace(text, TOKEN, "$1[EN]$2[/EN]$3").alias("tagged"), found.alias("english_words"))
