"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source is expected ``rate = target / source size`` times. The expected copies are summed along an
order of the source's documents, one offset per source is added, and a document is taken once for each whole number its
stretch of the sum crosses: ``floor(rate*(k+1) + u) - floor(rate*k + u)``. The order is by size class, then by md5 of the
id: so each class is sampled evenly and the words taken stay close to the target. Ranks come from a tree of counts
(``distributed_rank``), so a source that holds a third of all rows needs no task of its own.

Defined cases: a null or empty text has size 0; null sources are one source and come last in the order of weights; a
source without words has target 0; repeated rows are documents of their own (ties in the order: equal rows); an empty
table gives an empty result; further columns are carried along, whatever their names. Rows of one id and one size are ordered
by a hash of their text where ``docs`` has one, so reruns take the same texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD_PATTERN, distributed_rank, stored

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 20240917


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def size_class(size):
    """The length of the size in binary and its three bits after the first: eight classes for each doubling."""
    n = F.length(F.bin(size))
    return n * 8 + F.call_function("shiftright", size, F.greatest(n - 4, F.lit(0))).bitwiseAND(7)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) -> (source, source_size, target): one row a source.

    ``share`` times all words are dealt out by weight; a target stops at ``most`` times its source and the rest is dealt
    again among the others. In closed form: with sources by cap/weight ascending, the level at a source is what is left
    after all caps before it over the weight left, and the highest level that does not pass its own cap/weight holds.
    """
    by_source = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    t = by_source.withColumn("_i", F.row_number().over(in_order) - 1).withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    t = t.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(everything) - before) / left)
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(everything)
    return t.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_w") * level, F.col("_cap"))).alias("target"))


def offset(source, seed: int):
    """The random offset of a source, in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\u0000"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def planned(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size=None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> tuple[DataFrame, list[str]]:
    """Every row once, its columns as c0, c1, ..., with size, source_size, target, copies and taken; the names of its columns."""
    names = docs.columns
    size = word_count(docs["text"]) if size is None else size
    rows = docs.select(docs[source_col].cast("string").alias("source"), docs[id_col].cast("string").alias("_id"), size.alias("size"), (F.xxhash64(docs["text"]) if "text" in names else F.lit(0)).alias("_text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    rows = stored(rows.withColumn("_h", F.md5(F.coalesce("_id", F.lit("")).cast("binary"))).withColumn("_class", size_class(F.col("size"))), "sized")
    targets = source_targets(rows.select("source", "size"), weights, share, most)
    classes = stored(rows.groupBy("source", "_class").agg(F.count(F.lit(1)).alias("_n")), "classes")
    smaller = Window.partitionBy("source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_before", F.coalesce(F.sum("_n").over(smaller), F.lit(0))).drop("_n")
    small = classes.alias("k").join(targets.alias("t"), F.col("k.source").eqNullSafe(F.col("t.source"))).select(F.col("k.source").alias("_s"), F.col("k._class").alias("_k"), "_before", "source_size", "target")
    ranked = distributed_rank(rows, ["source", "_class"], "_h", ["_id", "size", "_text"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = ranked.join(small, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_k")))
    at = at.withColumn("_r", rate).withColumn("_u", offset(F.col("source"), seed)).withColumn("_pos", (F.col("_rank") + F.col("_before")).cast("double"))
    copies = F.floor(F.col("_r") * (F.col("_pos") + 1) + F.col("_u")) - F.floor(F.col("_r") * F.col("_pos") + F.col("_u"))
    at = at.withColumn("copies", F.least(copies, F.ceil("_r")).cast("long"))
    return at.select(*[f"c{i}" for i in range(len(names))], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")), names


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    plan, names = planned(docs, **options)
    taken = plan.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"))
    plan, _ = planned(slim, size=slim["size"])
    return plan.select(F.col("c0").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][1 + i % 3] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap FROM s
), f AS (
  SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap, w * max(level) FILTER (level <= cap / w) OVER ()) AS target FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r,
    ('0x' || substr(md5('20240917|' || coalesce(d.source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)) * 8 + ((d.size >> greatest(length(bin(d.size)) - 4, 0)) & 7), md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size) - 1 AS DOUBLE) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(least(floor(r * (k + 1) + u) - floor(r * k + u), ceil(r)) AS BIGINT) AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
