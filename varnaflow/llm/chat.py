"""Chat formatting with Spark expressions only.

Turns are put in order of (turn, role, text); adjacent turns of one role become one block: its texts are collected as structs,
sorted and joined by PART, so the original turns can be read back; the blocks of a conversation likewise:

    ### role: text<part>text</turn>\\n### role: text</turn>\\n

Texts and roles are escaped, so no control string can stand inside them: ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and
``#`` becomes ``\\h``; in roles also ``:`` becomes ``\\c``. ``loss_spans`` marks the assistant's texts as (start, length) in
code points of the formatted text, start from 1.

Where a text starts is a running sum of lengths over the conversation's turns, so work grows in proportion to turns and
characters. All steps share one shuffle, by conversation. A conversation is one string and so is made in one task; it is the
row limit of Spark (2 GB, and for ``under_loss`` 500 million code points) that bounds its length.

Defined cases: a null text or role is empty; null turns come first; a null conv_id is a conversation; repeated rows are
turns of their own; an empty table gives an empty result; further columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEAD, AFTER_ROLE, PART, END = "### ", ": ", "<part>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(x: Column, pairs=ESCAPES) -> Column:
    for plain, safe in pairs:
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return x


def unescaped(x: Column, pairs=ESCAPES) -> Column:
    for plain, safe in reversed(pairs):
        x = F.replace(x, F.lit(safe), F.lit(plain))
    return x


def formatted(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans), one row a conversation."""
    turns = rows.select(rows[conv].alias("conv_id"), rows[turn].alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.select("*", F.row_number().over(in_order).alias("at"), F.coalesce(F.lag("role").over(in_order) != F.col("role"), F.lit(True)).alias("opens"), F.coalesce(F.lead("role").over(in_order) != F.col("role"), F.lit(True)).alias("closes"))
    turns = turns.withColumn("safe", escaped(F.col("text"))).withColumn("head", F.concat(F.lit(HEAD), escaped(F.col("role"), ROLE_ESCAPES), F.lit(AFTER_ROLE)))
    before = F.when(F.col("opens"), F.length("head")).otherwise(len(PART))
    turns = turns.withColumn("n", F.length("safe")).withColumn("after", F.when(F.col("closes"), len(END)).otherwise(0)).withColumn("before", before)
    turns = turns.select("*", F.sum(F.col("before") + F.col("n") + F.col("after")).over(so_far).alias("end"), F.sum(F.col("opens").cast("int")).over(so_far).alias("block"))
    span = F.struct((F.col("end") - F.col("after") - F.col("n") + 1).cast("int").alias("start"), F.col("n").alias("length"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "safe"))), lambda t: t.safe)
    blocks = turns.groupBy("conv_id", "block").agg(F.first("head").alias("head"), texts.alias("texts"), F.collect_list(F.when(F.col("role") == trained, span)).alias("spans"))
    piece = F.concat("head", F.array_join("texts", PART), F.lit(END))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", piece.alias("piece")))), lambda b: b.piece)
    return blocks.groupBy("conv_id").agg(F.array_join(pieces, "").alias("formatted"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("loss_spans"))


def read_back(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    blocks = F.split(text, END, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        rest = F.substring(b, len(HEAD) + 1, F.length(b))
        role = F.substring_index(rest, AFTER_ROLE, 1)
        texts = F.split(F.substring(rest, F.length(role) + len(AFTER_ROLE) + 1, F.length(rest)), PART, -1)
        return F.transform(texts, lambda t: F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_loss(text: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order. Cut from four bytes a code point, so a cut costs its own length only."""
    cut = lambda b: lambda s: unescaped(F.decode(F.substring(b, (s.start - 1) * 4 + 1, s.length * 4), "UTF-32"))
    return F.get(F.transform(F.array(F.encode(text, "UTF-32")), lambda b: F.array_join(F.transform(spans, cut(b)), "")), F.lit(0))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = formatted(rows.unionByName(probe)).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", under_loss(F.col("formatted"), F.col("loss_spans")))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, lag(1) OVER w IS NULL AS opens, lead(1) OVER w IS NULL AS closes
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), p AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h'))
    + CASE WHEN opens OR before <> role THEN 6 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) ELSE 6 END
    + CASE WHEN closes OR after <> role THEN 8 ELSE 0 END AS chars FROM n
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
