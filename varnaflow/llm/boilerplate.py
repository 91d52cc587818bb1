"""Line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host. For each line: pages of the host that hold it, over all pages of the host. Lines above
``ratio`` that stand on ``least_held`` pages or more are boilerplate of that host and leave every page of it. Hosts with
fewer than ``min_pages`` pages keep all lines (by default no host does for its size alone).

A line travels as its 64-bit hash, so the texts are never shuffled: two different lines of one host take each other's
count with a probability of about 1 in 10^19 a pair. A host has at most (mean distinct lines of a page / ratio) lines of
boilerplate; the table of all of them is broadcast if it is small by count, else joined by shuffle, where adaptive
execution splits a hot host.

Defined cases: a null text stays null and is a page without lines; null hosts are one host; a line counts once a page;
blank lines are never boilerplate; a page may become empty but its row stays; rows repeat if they repeat; further columns
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

#: Share of a host's pages above which a line is boilerplate: in sf0.1 shares by host leave a gap from 0.048 to 0.086 between content and boilerplate.
RATIO = 0.05
#: Pages of a host that hold a line of boilerplate, at least, whatever the host's size.
LEAST_HELD = 3
BROADCAST_LINES = 200_000


def _lines(text):
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = 1, least_held: int = LEAST_HELD) -> DataFrame:
    """(host, line): the hash of each line of boilerplate."""
    pages = docs.select(docs[host_col].alias("host"), docs[text_col].alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    full = F.filter(_lines(F.col("text")), lambda x: F.length(F.trim(x)) > 0)
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(full, lambda x: F.xxhash64(x)))).alias("line"))
    held = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    above = held.alias("a").join(totals.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("n") > F.lit(ratio) * F.col("pages")) & (F.col("n") >= least_held) & (F.col("pages") >= min_pages))
    return above.select(F.col("a.host").alias("host"), "line")


def without_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = 1, least_held: int = LEAST_HELD) -> tuple[DataFrame, list[str]]:
    """Every row with its columns as c0, c1, ..., the new text, n_lines and n_dropped; the names of its columns."""
    found = stored(boilerplate(docs, host_col, text_col, ratio, min_pages, least_held), "boilerplate")
    by_host = found.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("_drop"))
    if found.count() <= BROADCAST_LINES:
        by_host = F.broadcast(by_host)
    names = docs.columns
    rows = docs.select(docs[host_col].alias("_key"), docs[text_col].alias("_text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    joined = rows.join(by_host, F.col("_key").eqNullSafe(F.col("_host")), "left")
    kept = F.filter(_lines(F.col("_text")), lambda x: (F.length(F.trim(x)) == 0) | ~F.array_contains(F.col("_drop"), F.xxhash64(x)))
    joined = joined.withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept))
    n = F.coalesce(F.size(_lines(F.col("_text"))), F.lit(0))
    n = F.when(F.col("_text").isNull(), 0).otherwise(n).cast("long")
    dropped = F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(n - F.size("_kept")).cast("long")
    text = F.when(F.col("_kept").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n"))
    return joined.select(*[f"c{i}" for i in range(len(names))], text.alias("text"), n.alias("n_lines"), dropped.alias("n_dropped")), names


def cleaned_rows(docs: DataFrame, host_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with boilerplate cut from the text."""
    rows, names = without_boilerplate(docs, host_col, text_col, **options)
    return rows.select(*[F.col("text" if c == text_col else f"c{i}").alias(c) for i, c in enumerate(names)])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows, _ = without_boilerplate(docs)
    return rows.select(F.col("c0").alias("doc_id"), F.col("c1").alias("source"), "text", "n_lines", "n_dropped")


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), p AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), h AS (
  SELECT source, line, count(DISTINCT (doc_id, text)) AS n FROM l WHERE length(trim(line)) > 0 GROUP BY source, line
), b AS (
  SELECT h.source, h.line FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source WHERE n > 0.05::DOUBLE * pages AND n >= 3
), k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (b.line IS NULL) AS text, count(*) AS n_lines, count(b.line) AS n_dropped
  FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY l.doc_id
)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN k USING (doc_id)
"""
