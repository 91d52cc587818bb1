"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Each text becomes its set of word shingles. Documents with equal sets are one class ("copies"); classes are compared.
2. Candidates: BANDS x ROWS MinHash values; classes that agree in a whole band meet in a bucket. A pair of similarity 0.8 is
   missed with a probability of (1 - 0.8^6)^40, about 5e-6; at 0.85 below 1e-8. Buckets of the same members are one.
3. In a bucket of up to BUCKET classes the pairs are compared on STEP MinHash values at a time, the same values that made the
   bands, by their last byte (by chance equal bytes keep a pair, they never drop one). With a uniform prior the posterior
   probability that a pair reaches the threshold is a sum of binomials; a pair below TOLERANCE is dropped. (A pair that met in a
   band agrees in some of these values for that reason; that raises its posterior, so it makes dropping rarer.) What is left
   ties classes together; a pair that is tied already needs no look, and a bucket gives less ties than it has classes. The
   classes of a larger bucket are tied to its first one, unseen; such ties are linear in the classes too.
4. The connected ties hold all pairs that were not dropped. Inside such a component pairs are compared again, on whole values,
   and those not dropped are verified exactly on the whole sets.
5. A component of more than BLOCK_ROWS classes or BLOCK_SHINGLES shingles is cut into blocks, and pairs of blocks are tasks
   of their own. Tasks return for each class the documents it links to and the first class it hangs together with: rows
   in proportion to classes and blocks, never to pairs.

Result: one row a document with ``class_id`` (the smallest doc_id it is connected with through links) and ``n_links`` (other
documents of similarity >= threshold, copies counted).

Defined cases: texts without words (null, empty, blanks) have equal, empty sets and are copies of each other; a text of
fewer than five words is one shingle; null doc_ids are rows like others and count only for class_id if a class has no other
id (then it is null); repeated rows are copies; an empty table gives an empty result; further columns are kept by
``deduplicated`` whatever their names, and not used by ``ngram_jaccard_join``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import mixed, shingles, stored

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 40, 6, 16, 1e-6
BLOCK_ROWS, BLOCK_SHINGLES, PACK_SHINGLES = 1000, 1_000_000, 250_000
#: Classes of a bucket whose pairs are looked at there, and memberships of small buckets that a task gets.
BUCKET, PACK_MEMBERS = 1024, 20_000

_SEEDS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _TIMES = _SEEDS[: BANDS * ROWS, None], _SEEDS[BANDS * ROWS :, None] | np.uint64(1)
_BAND_TIMES = _SEEDS[:ROWS] | np.uint64(1)


def minhashes(sets: np.ndarray) -> np.ndarray:
    """BANDS * ROWS values of 32 bits."""
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(sets), 512):
        x = sets[None, k : k + 512] ^ _XOR
        x *= _TIMES
        np.minimum(best, x.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key for each band, different from band to band."""
    v = values.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((mixed(v + np.uint64(1)) * _BAND_TIMES[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def least_matches(threshold: float, tolerance: float, most: int = BANDS * ROWS, step: int = STEP) -> list[int]:
    """For step, 2 step, ... compared values: the fewest equal ones at which P(similarity >= threshold) >= tolerance."""
    out = []
    for h in range(step, most + 1, step):
        total, m = 0.0, 0
        while (total := total + comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)) < tolerance:
            m += 1
        out.append(m)
    return out


def _summaries(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, keys, values = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), words)
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                v = minhashes(s) if len(s) else None
                keys.append(np.empty(0, np.int64) if v is None else band_keys(v))
                values.append(b"" if v is None else v.astype(np.uint8).tobytes())
            two = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(sizes, pa.int64()), lists, pa.array(values, pa.binary())], names=["doc_id", "th", "f1", "f2", "n", "keys", "low"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def tied(values: np.ndarray, fewest: list[int], step: int = STEP) -> tuple[list[tuple[int, int]], int]:
    """Ties (i, j) that connect all pairs of rows of ``values`` that pruning leaves, and how many pairs were looked at."""
    root, out, seen = np.arange(len(values)), [], 0
    for i in range(len(values) - 1):
        js = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        seen += len(js)
        if not len(js):
            continue
        hits = np.zeros(len(js), np.int64)
        for h, least in enumerate(fewest):
            part = slice(h * step, (h + 1) * step)
            hits += (values[js, part] == values[i, part]).sum(axis=1)
            alive = hits >= least
            js, hits = js[alive], hits[alive]
            if not len(js):
                break
        for j in js.tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out, seen


def _bucket_ties(threshold: float, tolerance: float):
    fewest = least_matches(threshold, tolerance)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in pdf.groupby("key", sort=False):
            rows = group["row"].to_numpy()
            values = np.frombuffer(b"".join(group["low"]), np.uint8).reshape(len(rows), -1)
            out += [(int(rows[i]), int(rows[j])) for i, j in tied(values, fewest)[0]]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def _ties(sets: DataFrame, own: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(u, v): ties whose components hold all pairs of classes that are not dropped."""
    keyed = own.select("row", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = stored(keyed.join(shared, "key").select("key", "row", "c"), "met")
    hot = met.filter(F.col("c") > BUCKET)
    large = hot.join(hot.groupBy("key").agg(F.min("row").alias("m")), "key").filter("row <> m").select(F.col("row").alias("u"), F.col("m").alias("v"))
    small = met.filter(F.col("c") <= BUCKET)
    mark = lambda salt: F.bit_xor(F.xxhash64("row", F.lit(salt)))
    marked = small.groupBy("key").agg(F.min("row").alias("m"), F.count(F.lit(1)).alias("c"), mark(1).alias("x"), mark(2).alias("y"))
    chosen = stored(marked.groupBy("m", "c", "x", "y").agg(F.min("key").alias("key")).select("key", "c"), "buckets")  # those of the same members once
    members = chosen.agg(F.sum("c")).first()[0] or 0
    dealt = small.select("key", "row").join(chosen.select("key"), "key").join(sets.select("row", "low"), "row")
    dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-members // PACK_MEMBERS)))))
    seen = dealt.groupBy("pack").applyInPandas(_bucket_ties(threshold, tolerance), "u long, v long")
    return seen.unionByName(large)


def linked_pairs(sets: list[np.ndarray], lefts: np.ndarray, rights: np.ndarray, threshold: Fraction, fewest: list[int], step: int = STEP) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): the members js of ``rights`` that reach the threshold with member i of ``lefts``; each pair once if the two are the same."""
    values = np.stack([minhashes(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    local = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(local.max()) + 1, bool)
    same = lefts is rights
    for k, i in enumerate(lefts):
        js = rights[k + 1 :] if same else rights
        hits = np.zeros(len(js), np.int64)
        for h, least in enumerate(fewest):
            part = slice(h * step, (h + 1) * step)
            hits += (values[js, part] == values[i, part]).sum(axis=1)
            alive = hits >= least
            js, hits = js[alive], hits[alive]
            if not len(js):
                break
        if not len(js):
            continue
        own = local[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        total = sizes[js]
        first = np.repeat(ends[js] - total - np.cumsum(total) + total, total)
        common = np.add.reduceat(mark[local[first + np.arange(len(first))]].astype(np.int64), np.cumsum(total) - total)
        mark[own] = False
        js = js[common * threshold.denominator >= threshold.numerator * (sizes[i] + total - common)]
        if len(js):
            yield int(i), js


def _verified(words: int, threshold: float, tolerance: float):
    share = Fraction(str(threshold))
    fewest = least_matches(threshold, tolerance)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("row").sort_values("row", ignore_index=True)
        out = []
        for _, group in pdf.groupby("comp", sort=False):
            rows, copies = group["row"].to_numpy(), group["copies"].to_numpy()
            if len(rows) < 2:
                continue
            block, low, high = group["block"].to_numpy(), group["low"].iloc[0], group["high"].iloc[0]
            lefts = np.flatnonzero(block == low)
            rights = lefts if low == high else np.flatnonzero(block == high)
            links, forest = np.zeros(len(rows), np.int64), _Forest(len(rows))
            for i, js in linked_pairs([shingles(t, words) for t in group["text"]], lefts, rights, share, fewest):
                links[i] += copies[js].sum()
                links[js] += copies[i]
                for j in js.tolist():
                    forest.join(i, j)
            out += [(int(rows[k]), int(links[k]), int(rows[forest.root(k)])) for k in np.flatnonzero(links)]
        return pd.DataFrame(out, columns=["row", "links", "root"]).astype("int64")

    return run


def _repeated(rows: DataFrame, key: str, th: str) -> DataFrame | None:
    """(key, th) of more than one row; None if there are none."""
    again = rows.groupBy(key, th).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col(key).alias("_again"), F.col(th).alias("_again_th"))
    again = stored(again, "repeated")
    return None if again.isEmpty() else again


def _single(rows: DataFrame, again: DataFrame | None, key: str, th: str) -> DataFrame:
    """One of the rows of each (key, th). Only rows that repeat are shuffled, and a key of very many rows is thinned out before."""
    if again is None:
        return rows
    same = rows[key].eqNullSafe(again["_again"]) & (rows[th] == again["_again_th"])
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([key, th]))


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame | None]:
    """(row, doc_id, th, class_id, lone, n_links): a row for each document; th is a hash of the text, lone names the group of the document. And the (doc_id, th) of several rows."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    sets = stored(texts.mapInArrow(_summaries(words), "doc_id long, th long, f1 long, f2 long, n long, keys array<long>, low binary").withColumn("row", F.monotonically_increasing_id()), "sets")
    classes = stored(sets.groupBy("f1", "f2").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    own = stored(sets.select("row", "doc_id", "th", "n", "keys").join(classes.select("row", "copies"), "row"), "own")  # keys are shuffled once
    near = components(_ties(sets, own, threshold, tolerance))
    members = stored(own.select("row", "doc_id", "th", "n", "copies").join(near.withColumnRenamed("node", "row").withColumnRenamed("root", "comp"), "row"), "members")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    sizes = stored(sizes.select("comp", F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("long").alias("blocks"), "s"), "sizes")
    small = sizes.filter("blocks = 1").agg(F.sum("s")).first()[0] or 0
    packs = max(1, -(-small // PACK_SHINGLES))
    dealt = members.join(sizes.select("comp", "blocks"), "comp").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("row", "doc_id", "th", "comp", "copies", "block", "blocks", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    wanted = dealt.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.xxhash64("comp", "low", "high").bitwiseOR(F.lit(-(1 << 62)))))
    again = _repeated(sets, "doc_id", "th")
    single = _single(texts, again, "doc_id", "th")
    with_text = single.join(wanted, single["doc_id"].eqNullSafe(wanted["doc_id"]) & (single["th"] == wanted["th"])).select("row", "comp", "copies", "block", "low", "high", "task", "blocks", "text")
    found = stored(with_text.groupBy("task", "blocks").applyInPandas(_verified(words, threshold, tolerance), "row long, links long, root long"), "links")
    by_row = found.groupBy("row").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    roots = components(found.select(F.col("row").alias("u"), F.col("root").alias("v")))
    linked = by_row.select("row", "links").join(roots.withColumnRenamed("node", "row"), "row", "left")
    whole = classes.join(linked, "row", "left").select("f1", "f2", "row", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "row").alias("root"))
    whole = stored(whole, "whole")
    ids = whole.groupBy("root").agg(F.min("least").alias("class_id"), F.min("row").alias("lone"))
    named = whole.join(ids, "root").select("f1", "f2", "class_id", "lone", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return sets.select("row", "doc_id", "th", "f1", "f2").join(named, ["f1", "f2"]).select("row", "doc_id", "th", "class_id", "lone", "n_links"), again


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links), one row a document."""
    return _joined(docs, id_col, text_col, words, threshold, tolerance)[0].select("doc_id", "class_id", "n_links")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row with the smallest id (null ids last; equal ids: one of the rows)."""
    joined, again = _joined(docs, id_col, text_col, words, threshold, tolerance)
    best = joined.groupBy("lone").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "th")).alias("b")).select(F.col("b.doc_id").alias("_id"), F.col("b.th").alias("_th"))
    names = docs.columns
    rows = docs.select(docs[id_col].cast("long").alias("_key"), F.xxhash64(docs[text_col]).alias("_hash"), *[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    one = _single(rows, again, "_key", "_hash")
    kept = one.join(best.distinct(), one["_key"].eqNullSafe(F.col("_id")) & (one["_hash"] == F.col("_th")))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k * 5 >= 4 * (x.n + y.n - k)
  UNION ALL SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON len(x.w) = 0 AND len(y.w) = 0 AND x.doc_id <> y.doc_id
), r AS (
  SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a
), m AS (
  SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT r.doc_id, min(other) AS class_id, any_value(coalesce(m.n_links, 0)) AS n_links FROM r LEFT JOIN m USING (doc_id) GROUP BY r.doc_id
"""
