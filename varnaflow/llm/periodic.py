"""Periodic runs of words by partition refinement (Crochemore).

Positions are classed by the factor of m words that starts there. Class members whose neighbour in the class lies exactly m
further are the starts of squares of period m, with a root that is no power; squares of one period at consecutive places make
a run. Classes of length m + 1 come from those of length m by splitting them along the classes of the place behind: of each
class that was split, all parts but the largest split others in turn ("smaller half"), so a place moves log n times at most.
Places alone in their class start no square any more and leave.

While most classes still fall apart, a length is refined for all places at once with sorted arrays (in prose that is three or
four lengths, and nothing is left after them); what then remains, copies and periodic stretches inside a text, is refined by
the smaller halves, class by class. A text is one row, and the work on it is in proportion to n log n at most.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, 2 q) words that no neighbour extends.
``collapsed`` drops the words that a run holds after its first q words.

Defined cases: a null or empty text has no words and no runs, and a null text stays null in ``collapsed``; a null id counts as
empty text in the rule that makes words periodic (``planted``); repeated rows are rows like others; an empty table gives an
empty result; further columns are kept by ``collapsed`` whatever their names, and not used by ``periodic_runs``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 12
#: All places are refined at once as long as a length drops at least this share of them.
DROPPED = 0.2

Run = tuple[int, int, int]


def _blocks(starts: np.ndarray, m: int) -> Iterator[Run]:
    """(start, length, period) of the runs whose squares of period m start at these places, in order."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    for first, last in zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist(), strict=True):
        yield first, last - first + 2 * m, m


def runs_of(ids: np.ndarray, least: int = LEAST, dropped: float = DROPPED) -> list[Run]:
    """(start, length, period) of all runs, by start, then period. ids: a number from 0 to the number of words for each word, equal for equal words."""
    n, found, m, was = len(ids), [], 1, None
    if n < max(2, least):
        return []
    cls, at = ids.astype(np.int64), np.flatnonzero(np.bincount(ids)[ids] > 1)
    while len(at):
        order = at[np.argsort(cls[at], kind="stable")]  # by class, then place
        near = (cls[order[1:]] == cls[order[:-1]]) & (order[1:] - order[:-1] == m)
        if near.any():
            found += _blocks(np.sort(order[:-1][near]), m)
        if 2 * (m + 1) > n:
            break
        if was is not None and len(at) > (1 - dropped) * was:
            found += _refined(order, cls, n, m)
            break
        was = len(at)
        at = at[at + m < n]  # the last place's factor reaches beyond the end now
        _, part, size = np.unique(cls[at] * (2 * n + 1) + cls[at + 1], return_inverse=True, return_counts=True)
        alive = size[part] > 1
        cls = np.arange(n, 2 * n)  # a place that left is unlike all others
        at, m = at[alive], m + 1
        cls[at] = part[alive]
    return sorted((r for r in found if r[1] >= least), key=lambda r: (r[0], r[2]))


def _refined(order: np.ndarray, cls: np.ndarray, n: int, m: int) -> Iterator[Run]:
    """The runs of periods above m. order: the places in classes of length m of two or more places, by class, then place."""
    places, classes = order.tolist(), cls[order].tolist()
    owner = dict(zip(places, classes, strict=True))
    members: dict[int, list[int]] = {}
    for i, c in owner.items():
        members.setdefault(c, []).append(i)
    size = {c: len(x) for c, x in members.items()}
    after: dict[int, int] = {}  # the next place of the class, and the one before
    before: dict[int, int] = {}
    gaps: dict[int, set[int]] = {}  # places by the distance to the next of their class, from m on

    def link(a: int, b: int) -> None:
        after[a], before[b] = b, a
        if b - a >= m:
            gaps.setdefault(b - a, set()).add(a)

    def take(i: int) -> None:
        """Out of its class's list."""
        a, b = before.pop(i, None), after.pop(i, None)
        if a is not None:
            if i - a in gaps:
                gaps[i - a].discard(a)
            if b is None:
                del after[a]
        if b is not None:
            if b - i in gaps:
                gaps[b - i].discard(i)
            if a is None:
                del before[b]
            else:
                link(a, b)

    def whole(i: int) -> Iterator[int]:
        """All places of the class of a place, in order."""
        while i in before:
            i = before[i]
        yield i
        while i in after:
            i = after[i]
            yield i

    for x in members.values():
        for a, b in zip(x, x[1:], strict=False):
            link(a, b)
    splitting = [*members.values(), *([i + 1] for i in places if i + 1 not in owner)]
    fresh = 2 * n
    while owner and 2 * (m + 1) <= n:
        falls = n - m  # its factor reaches beyond the end now; the place before it follows with the next length
        m += 1
        if falls in owner:
            c = owner.pop(falls)
            size[c] -= 1
            rest = before.get(falls)
            take(falls)
            if size[c] == 1:
                del owner[rest]
        parts: dict[int, list[list[int]]] = {}  # of each class the places that a part splits off
        for split in splitting:
            reached: dict[int, list[int]] = {}
            for j in split:
                c = owner.get(j - 1)
                if c is not None:
                    reached.setdefault(c, []).append(j - 1)
            for c, x in reached.items():
                parts.setdefault(c, []).append(x)
        splitting = []
        for c, own in parts.items():
            left = size[c] - sum(map(len, own))  # places that no part has reached stay together
            if left and (left <= 1 or left < max(map(len, own))):
                known = {i for x in own for i in x}
                own.append([i for i in whole(own[0][0]) if i not in known])
                left = 0
            if not left:
                own.sort(key=len)
                stays = own.pop()
                if len(stays) == 1:
                    del owner[stays[0]]
            for x in own:
                for i in x:
                    take(i)
                size[c] -= len(x)
                if len(x) == 1:
                    del owner[x[0]]
                else:
                    x.sort()
                    size[fresh] = len(x)
                    owner.update(dict.fromkeys(x, fresh))
                    for a, b in zip(x, x[1:], strict=False):
                        link(a, b)
                    fresh += 1
                splitting.append(x)
        if starts := gaps.pop(m, None):
            yield from _blocks(np.sort(np.fromiter(starts, np.int64, len(starts))), m)


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, in order of first sight."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """True for each word that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than blanks and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, for one id in ten with a period from some word on."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _described(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                words = words_of(text.as_py())
                words = planted(words, doc_id) if plant else words
                runs = runs_of(numbered(words))
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                exponent = 1000 * length // period if runs else None
                listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
                kept = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()] if runs else words
                rows.append((doc_id, len(runs), start, length, period, exponent, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def periodic_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """For each document the number of its runs, its longest run, and digests of its runs and of its collapsed words. plant: words are made periodic first, as ``planted`` says."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_described(plant), SCHEMA)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        out = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs_of(numbered(words_of(t.as_py())))] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "runs"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>) of every row."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_listed, "doc_id long, runs array<struct<start:long,length:long,period:long>>")


def collapsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with texts whose runs keep their first period only; their words are joined by one blank. Texts without runs stay as they are."""
    def shortened(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = words_of(text)
            runs = runs_of(numbered(words))
            out.append(b" ".join(words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()).decode("utf-8", "surrogatepass") if runs else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, F.pandas_udf(shortened, "string")(docs[text_col]))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
