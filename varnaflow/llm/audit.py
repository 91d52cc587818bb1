"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

1. Each text gets a mask of the filters that it fails: A (bit 0) under MIN_WORDS words; B less than MIN_DISTINCT per cent
   distinct words; C more than MAX_CAPITALS per cent capitals A to Z; D holds one of SIGNS; E its text stands under a smaller
   id. Texts are compared by md5; the smallest id of a text is a minimum by hash, and a row is looked up by (hash, id), so a
   text of very many copies is no hot key.
2. Rows are counted by part and mask: of all documents, of those labelled good, and of those labelled toxic. That histogram
   has at most 32 rows a part.
3. The three counts of a part are the rows of a matrix. Multiplied by integer matrices of 32 masks by 600 (120 orders of 5
   steps; INCIDENCE), they give what is kept after a step, removed by it, redundant (failed, but removed before) and failed
   by its filter alone. A filter's Shapley total is the sum of what it removes over all orders.

Defined cases: a null text is the empty text; a null part is the empty one; a null id has no label, fails no E and makes no
other row fail it; rows of one id and one text don't make each other fail E; an id labelled several times is good (toxic) if
one of its labels says so; null labels say nothing; an empty table gives an empty result; further columns are not used.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def incidence() -> dict[str, np.ndarray]:
    """For each outcome a matrix of masks by (order, step), 1 where a document of that mask has that outcome at that step."""
    masks = np.arange(1 << len(FILTERS))[:, None]
    own = np.array([1 << FILTERS.index(f) for order in ORDERS for f in order])
    before = np.array([sum(1 << FILTERS.index(f) for f in order[:k]) for order in ORDERS for k in range(len(order))])
    fails, gone = masks & own > 0, masks & before > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == own}
    return {k: v.astype(np.int64) for k, v in found.items()}


def shapley_weights() -> np.ndarray:
    """Masks by filters: in how many orders a document of that mask is removed by that filter."""
    filters = np.array([[order[k] for k in range(len(order))] for order in ORDERS]).ravel()
    removed = incidence()["removed"]
    return np.stack([removed[:, filters == f].sum(axis=1) for f in FILTERS], axis=1)


def text_mask(text: Column, words: Column) -> Column:
    """The bits of filters A to D of a text and its words."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text), text.rlike(SIGNS))
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): documents by id, part and the filters that they fail."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = texts.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select("doc_id", "part", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"), text_mask(F.col("text"), F.col("words")).alias("mask"))
    cells = stored(rows.groupBy("doc_id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n")), "cells")
    least = cells.groupBy("h").agg(F.min("doc_id").alias("_least")).filter("_least IS NOT NULL").withColumnRenamed("h", "_h")
    found = cells.join(least, (cells["h"] == least["_h"]) & (cells["doc_id"] == least["_least"]), "left")
    again = F.col("doc_id").isNotNull() & F.col("_least").isNull()
    return found.select("doc_id", "part", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask"), "n")


def histogram(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of ``failures`` and (doc_id, quality, toxic) labels."""
    says = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    none = F.lit(None).cast("int")
    with_id = failed.filter("doc_id IS NOT NULL")
    rows = with_id.join(known, with_id["doc_id"] == known["_id"], "left").select("part", "mask", "n", "good", "toxic")
    rows = rows.unionByName(failed.filter("doc_id IS NULL").select("part", "mask", "n", none.alias("good"), none.alias("toxic")))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def _outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of a part from its histogram, which has a row for each mask at most."""
    counts = np.zeros((3, 1 << len(FILTERS)), np.int64)
    counts[:, pdf["mask"].to_numpy()] = pdf[["n", "good", "toxic"]].to_numpy().T
    found = {k: counts @ m for k, m in incidence().items()}
    own = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    out = pd.DataFrame({"part": pdf["part"].iloc[0], "filter_order": np.repeat(ORDERS, len(FILTERS)), "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))})
    values = (found["kept"][0], found["removed"][0], found["redundant"][0], found["unique_fails"][0], found["removed"][1], found["removed"][2], (counts[0] @ shapley_weights())[own])
    return out.assign(**dict(zip(COUNTS, values, strict=True)))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, counts): one row for each part, order and step."""
    counted = histogram(failures(docs, id_col, text_col, part_col), labels)
    return counted.groupBy("part").applyInPandas(_outcomes, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS m, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE l.toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), x AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(k, bit)
), o AS (
  SELECT p.k || q.k || r.k || s.k || t.k AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5
), s AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, generate_series(1, 5) g(step)
), c AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN m & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN m & own > 0 AND m & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN m & own > 0 AND m & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN m = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN m & own > 0 AND m & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN m & own > 0 AND m & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM h, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c
"""
