"""Inline rows to try the functions on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize

#: Sentences with numbers, idioms and English words.
SENTENCES = (
    "गाँव में दो सौ पचास घर हैं", "बस सात बजे आती है", "कुल चालीस लाख रुपये लगे", "दस-बीस लोग बाहर खड़े थे", "वह एक ही बात कहता है",
    "यह laptop मैंने office से लिया", "कल की meeting में बारह लोग थे", "नदी के पास पुराना पेड़ है",
)
#: What was said, and what four recognisers made of it.
SPOKEN = "बाजार में आज बहुत भीड़ थी"
HEARD = ("बाजार में आज बहुत भीड़ थी", "बाज़ार में आज बहुत भीड थी", "बाजार मे आज भीड़ थी", "बाज़ार में कल बहुत भीड़ थी")


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SENTENCES)), "place long, text string")


def lattice_segments(spark: SparkSession) -> DataFrame:
    """One segment in the shape of the lattice operators."""
    said = spark.createDataFrame([("demo", SPOKEN, [(f"model {chr(65 + k)}", x) for k, x in enumerate(HEARD)])], "segment string, text string, heard array<struct<model:string,text:string>>")
    models = F.transform("heard", lambda h: F.struct(h.model.alias("model"), tokenize(h.text).alias("words"), h.text.alias("text")))
    return said.select("segment", "text", tokenize(F.col("text")).alias("reference"), models.alias("models"))
