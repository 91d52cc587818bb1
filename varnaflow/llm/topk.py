"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Components are integers. Each dimension of an index block has postings by quantised level (LEVELS of equal width). For a
query, a segment's impact is the most that one of its postings can add, counted from the least that its dimension can add;
segments of all dimensions are processed by descending impact into accumulators. A row's bound is its accumulator plus, for
each dimension not seen yet, the impact of the next segment there. After each round (ROUNDS) the best accumulators are scored
exactly; rows whose bound is below the k-th of these scores, or below the k-th score that the query has from another block,
cannot be members. Processing stops when that proof leaves few rows, or at the end, and all rows left are scored exactly.
Accumulators, bounds and k-th scores are 64-bit integers; where a sum could leave LIMIT, a query is scored on all rows in
Python's integers instead. So the result is exact whatever the data; on vectors without structure the proof comes late.

Queries and rows both grow with the data, so they meet in blocks. The index of a block of rows is built once and written to
the shared folder, and so is each chunk of queries. First every chunk meets one block, which gives each query a k-th score
to start from; then chunks stream past all other blocks, a pair of block and chunk at a time, dealt evenly over the tasks.
No task and no broadcast holds all of either; each pair gives at most k rows a query.

Defined cases: vectors null or with null or non-finite components, and rows with null ids, take no part; a shorter vector
ends in zeros; an empty vector scores 0; equal scores go to the smaller id; a query meets every row but its own, so also
rows that share its id; each query row is answered, so a repeated query id has several rows of each rank; scores beyond a
long are ranked as they are and shown as its limits; further columns are not used; empty tables give an empty result.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import open_uri, put_file, shared_folder, stored

LEVELS, BLOCK, CELLS, MOST_TASKS = 32, 16384, 1 << 22, 50_000
#: Sums of products stay below this in 64-bit integers; no k-th score is known (or one that a long can't hold).
LIMIT, NO_FLOOR = 1 << 60, -(1 << 63)
#: Shares of the postings after which a round looks for proof.
ROUNDS = (0.5, 0.7, 0.85, 1.0)


def integers(rows: np.ndarray) -> np.ndarray:
    """floor(1024 * x). Python integers where 64 bits would not do."""
    if not rows.size or np.abs(rows).max() < 1 << 16:
        return np.floor(rows * 1024).astype(np.int64)
    exact = [[math.floor(x * 1024) if abs(x) < 1e300 else int(x) * 1024 for x in row] for row in rows.tolist()]
    whole = np.array(exact, object).reshape(rows.shape)
    return whole if max(abs(x) for row in exact for x in row) >= 1 << 26 else whole.astype(np.int64)


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """The vectors as rows, zeros behind short ones."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class ImpactIndex:
    """Postings of a block of integer vectors by dimension and quantised level. rows tell rows of one id apart."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None, levels: int = LEVELS):
        self.ids, self.vectors, self.rows = ids, vectors, ids if rows is None else rows
        dims = vectors.shape[1]
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        step = (high - low) // levels + 1
        level = ((vectors - low) // step).astype(np.int64)
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        self.at = np.stack([np.searchsorted(level[self.order[d], d], np.arange(levels + 1)) for d in range(dims)]) if dims else np.zeros((0, levels + 1), np.int64)
        self.codes = (level + np.arange(dims) * levels).astype(np.intp)  # the segment of each row in each dimension
        floor = low[:, None] + step[:, None] * np.arange(levels)[None, :]
        self.least, self.most = floor, np.minimum(floor + step[:, None] - 1, high[:, None])
        self.stats = {"postings": 0, "rescored": 0}

    def to_bytes(self) -> bytes:
        """The index as a file's bytes, in the narrowest types; integers beyond 64 bits as text."""
        out, wide = io.BytesIO(), self.vectors.dtype == object
        narrow = lambda x: x.astype(np.result_type(*map(np.min_scalar_type, (x.min(), x.max())))) if x.size else x
        parts = {"order": narrow(self.order), "at": self.at, "codes": narrow(self.codes), "least": self.least, "most": self.most} if not wide else {}
        np.savez(out, ids=self.ids, rows=self.rows, vectors=self.vectors.astype(str) if wide else narrow(self.vectors), **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> ImpactIndex:
        """The index again, as it was built."""
        found, out = np.load(io.BytesIO(data)), cls.__new__(cls)
        for name in found.files:
            setattr(out, name, found[name].astype(np.int64) if found[name].dtype.kind in "iu" else found[name])
        if out.vectors.dtype.kind == "U":
            out.vectors = np.array([[int(x) for x in row] for row in out.vectors.tolist()], object).reshape(out.vectors.shape)
        out.stats = {"postings": 0, "rescored": 0}
        return out

    def fits(self, query: np.ndarray) -> bool:
        """Whether no sum over the dimensions can pass LIMIT."""
        if self.vectors.dtype == object or query.dtype == object:
            return False
        most = np.maximum(np.abs(self.least[:, 0]), np.abs(self.most[:, -1])).astype(np.float64)
        return float(np.abs(query).astype(np.float64) @ most) < LIMIT / 4

    def search(self, query: np.ndarray, k: int, own: int | None = None, floor: int = NO_FLOOR) -> list[tuple[int, int, int]]:
        """The k best as (score, id, row), by score descending, id and row ascending; those below ``floor`` may be missing. own: the row that is the query."""
        n, dims = self.vectors.shape
        query = np.concatenate([query, np.zeros(max(0, dims - len(query)), query.dtype)])[:dims]
        possible = np.flatnonzero(self.rows != own) if own is not None else np.arange(n)
        if not dims or not self.fits(query):
            query = query.astype(object)
        elif n > 4 * k:
            possible = self._proven(query, k, possible, floor)
        self.stats["rescored"] += len(possible)
        scores = (self.vectors[possible] * query).sum(axis=1) if dims else np.zeros(len(possible), np.int64)
        if scores.dtype != object and len(scores) > 4 * k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            possible, scores = possible[near], scores[near]
        best = sorted(zip((-scores).tolist(), self.ids[possible].tolist(), self.rows[possible].tolist(), strict=True))[:k]
        return [(-s, i, r) for s, i, r in best]

    def _proven(self, query: np.ndarray, k: int, possible: np.ndarray, floor: int) -> np.ndarray:
        """The rows that may be among the k best: what proof leaves after as few rounds as it takes."""
        n, dims = self.vectors.shape
        up = np.where(query[:, None] > 0, query[:, None] * self.most, query[:, None] * self.least)
        worst = np.where(query > 0, query * self.least[:, 0], query * self.most[:, -1])
        gain = up - worst[:, None]  # of each segment, from 0 on
        count = np.diff(self.at, axis=1)
        impacts = np.where(count > 0, gain, 0)
        ranked = np.argsort(-impacts, axis=None)
        done = np.cumsum(count.ravel()[ranked])
        acc = np.full(n, -LIMIT)
        acc[possible] = int(worst.sum())
        inside = np.zeros(n, bool)
        inside[possible] = True
        cut, left = int(impacts.max()) + 1, possible
        for share in ROUNDS:  # a round: the segments of the next impacts; in a dimension they lie side by side
            last, was = int(impacts.ravel()[ranked[np.searchsorted(done, share * done[-1])]]) if share < 1 else 0, cut
            cut = min(cut, last)
            new = (impacts >= cut) & (impacts < was) & (impacts > 0)
            for d in np.flatnonzero(new.any(axis=1)):
                some = np.flatnonzero(new[d])
                rows = self.order[d, self.at[d, some[0]] : self.at[d, some[-1] + 1]]
                acc[rows] += np.repeat(gain[d, some[0] : some[-1] + 1], count[d, some[0] : some[-1] + 1])
                self.stats["postings"] += len(rows)
            waiting = np.where(impacts < cut, impacts, 0)
            ahead = waiting.max(axis=1)
            some = np.argpartition(-acc, 2 * k)[: 2 * k]
            scores = np.sort((self.vectors[some[inside[some]]] * query).sum(axis=1))
            least = max(int(scores[-k]) if len(scores) >= k else NO_FLOOR, floor)
            left = np.flatnonzero(inside & (acc + ahead.sum() >= least))
            if ahead.any() and len(left) <= n // 4:  # few enough to look which of their segments are still waiting
                left = left[acc[left] + np.where(waiting > 0, ahead[:, None], 0).ravel()[self.codes[left]].sum(axis=1) >= least]
            if len(left) <= max(8 * k, n // 64):
                break
        return left


def _builder(folder: str):
    """Writes the index of each block."""

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = list(pdf["v"])
        index = ImpactIndex(pdf["id"].to_numpy(), integers(matrix(vectors, max(map(len, vectors)))), pdf["row"].to_numpy())
        put_file(f"{folder}/index-{pdf['b'].iloc[0]}", index.to_bytes())
        return pd.DataFrame({"n": [len(pdf)]})

    return built


def _chunker(folder: str):
    """Writes each chunk of queries."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        out, vectors = io.BytesIO(), list(pdf["v"])
        np.savez(out, ids=pdf["id"].to_numpy(), rows=pdf["row"].to_numpy(), vectors=matrix(vectors, max(map(len, vectors))))
        put_file(f"{folder}/queries-{pdf['c'].iloc[0]}", out.getvalue())
        return pd.DataFrame({"n": [len(pdf)]})

    return cut


def _got(uri: str) -> bytes | None:
    """A file's bytes; None if no row fell to it."""
    fs, path = open_uri(uri)
    if not fs.get_file_info(path).is_file:
        return None
    with fs.open_input_file(path) as f:
        return f.read()


FOUND = "query_row long, query_id long, row long, vec_id long, score long, beyond binary"


def _beyond(score: int) -> bytes | None:
    """For scores at a long's limits or past them: bytes in the scores' order."""
    if NO_FLOOR < score < (1 << 63) - 1:
        return None
    size = abs(score).to_bytes(-(-abs(score).bit_length() // 8), "big")
    key = len(size).to_bytes(4, "big") + size
    return b"\1" + key if score > 0 else b"\0" + bytes(255 - x for x in key)


def _searcher(folder: str, k: int, blocks: int, chunks: int, first: bool):
    """Pairs of block and chunk, by number: in the first pass a chunk's home block, and its queries' k-th scores are written; then the others."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, index = -1, None
        for number in (int(x) for pdf in batches for x in pdf["id"]):
            c = number if first else number % chunks
            b = c % blocks if first else (c + 1 + number // chunks) % blocks
            if b != at:
                data = _got(f"{folder}/index-{b}")
                at, index = b, data and ImpactIndex.from_bytes(data)
            asked = _got(f"{folder}/queries-{c}")
            if index is None or asked is None:
                continue
            asked, out = np.load(io.BytesIO(asked)), []
            floors = None if first else _got(f"{folder}/floors-{c}")
            floors = [NO_FLOOR] * len(asked["ids"]) if floors is None else np.load(io.BytesIO(floors)).tolist()
            kth = []
            for i, row, query, floor in zip(asked["ids"].tolist(), asked["rows"].tolist(), integers(asked["vectors"]), floors, strict=True):
                best = index.search(query, k, row, floor)
                kth.append(max(NO_FLOOR, min((1 << 63) - 1, best[-1][0])) if len(best) == k else NO_FLOOR)
                out += [(row, i, r, j, max(-(1 << 63), min((1 << 63) - 1, s)), _beyond(s)) for s, j, r in best if s >= floor or floor == NO_FLOOR]
            if first:
                held = io.BytesIO()
                np.save(held, np.array(kth, np.int64))
                put_file(f"{folder}/floors-{c}", held.getvalue())
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])

    return searched


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, chunk: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables of (row, id, v array<double>), as ``usable`` makes them; a query's own row has its row number. chunk: queries a file, by default so many that there are about 1000 files."""
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    q = queries.count()
    block = max(1, min(block, CELLS // max(1, width or 0)))
    chunk = chunk or max(128, min(4096, -(-q // 1000)))
    blocks, chunks, folder = max(1, -(-n // block)), max(1, -(-q // chunk)), shared_folder(spark)
    numbered = lambda df, name, count: df.select("row", "id", "v", F.pmod(F.xxhash64("row"), F.lit(count)).alias(name)).groupBy(name)
    for made in (numbered(vectors, "b", blocks).applyInPandas(_builder(folder), "n long"), numbered(queries, "c", chunks).applyInPandas(_chunker(folder), "n long")):
        made.agg(F.sum("n")).first()
    pairs = lambda count, first: spark.range(0, count, 1, max(1, min(count, MOST_TASKS))).mapInPandas(_searcher(folder, k, blocks, chunks, first), FOUND)
    found = stored(pairs(chunks, True), "first")
    if blocks > 1:
        found = found.unionByName(stored(pairs(chunks * (blocks - 1), False), "others"))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v array<double>) of the rows that take part. Store it before queries are chosen from it: row is a number of the run."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = table.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vectors")
    return top_k(vectors, vectors.filter(F.col("id") % 100 == 0), 10)


OP4_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
