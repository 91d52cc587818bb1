"""What the corpus operators share: tables in the shared folder, distributed ranks and word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: White space between words: blank and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows that one window may hold.
HOT_ROWS = 1 << 16

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="varnaflow-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/varnaflow-{uuid.uuid4().hex}"


def open_uri(uri: str):
    """The file system and the path there of a file in the shared folder, for Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def put_file(uri: str, data: bytes) -> None:
    """Writes a file under a name of the attempt and renames it, so a task run again replaces its file by an equal one."""
    from pyspark import TaskContext

    fs, path = open_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{TaskContext.get().taskAttemptId()}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_id_hash(df: DataFrame, id_col: str, name: str = "_h") -> DataFrame:
    """Adds the md5 of the id as text (null: empty text): an order that every engine shares. Rows of one id share it."""
    return df.withColumn(name, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))


def distributed_rank(df: DataFrame, groups: list[str], hash_col: str, ties: list[str | Column], rank: str = "_rank", leaf_rows: int = 1024) -> DataFrame:
    """Adds the 0-based rank within ``groups`` by (hash_col, ties), without sorting a group in one task.

    The hash is hexadecimal text. Counts by ever longer prefixes of it form a tree with 256 children to a node; an
    offset is the parent's offset plus the counts of the smaller siblings, so each window sees at most 256 rows, and the
    last window a leaf of about ``leaf_rows`` rows. Null groups count as one group.

    A leaf of more than HOT_ROWS rows holds rows of one hash (an id that repeats, or null). Its rows are counted by (hash,
    ties), and rows that tie in all of these are dealt to salts of about HOT_ROWS rows, so no window sees more than the
    different ties of a hash, the salts of a tie or the rows of a salt. Which of tying rows comes first is up to the run.
    """
    n = df.count()
    depth = 1
    while n / 256**depth > leaf_rows and depth < 16:
        depth += 1
    g = [f"_g{i}" for i in range(len(groups))]
    keyed = df.select("*", *[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(k) for c, k in zip(groups, g, strict=True)], F.substring(hash_col, 1, 2 * depth).alias("_p"))
    leaf_counts = keyed.groupBy(*g, "_p").agg(F.count(F.lit(1)).alias("_n"))
    counts = stored(leaf_counts, "rank_counts")
    offsets = None
    for level in range(1, depth + 1):
        here = counts.groupBy(*g, F.substring("_p", 1, 2 * level).alias("_q")).agg(F.sum("_n").alias("_n")).withColumn("_up", F.substring("_q", 1, 2 * level - 2))
        siblings = Window.partitionBy(*g, "_up").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
        here = here.withColumn("_o", F.coalesce(F.sum("_n").over(siblings), F.lit(0)))
        if offsets is not None:
            above = offsets.select(*g, F.col("_q").alias("_up"), F.col("_o").alias("_above"))
            here = here.join(above, [*g, "_up"]).withColumn("_o", F.col("_o") + F.col("_above"))
        offsets = here.select(*g, "_q", "_o")
    leaf = Window.partitionBy(*g, "_p").orderBy(hash_col, *ties)
    in_leaf = lambda rows: rows.withColumn("_in_leaf", (F.row_number().over(leaf) - 1).cast("long"))
    hot = counts.filter(F.col("_n") > HOT_ROWS)
    if many := hot.count():
        hot = F.broadcast(hot) if many <= HOT_ROWS else hot
        ranked = in_leaf(keyed.join(hot, [*g, "_p"], "left_anti")).unionByName(_in_hot_leaf(keyed.join(hot, [*g, "_p"]), [*g, "_p"], hash_col, ties))
    else:
        ranked = in_leaf(keyed)
    joined = ranked.join(offsets.withColumnRenamed("_q", "_p"), [*g, "_p"])
    return joined.select(*[df[c] for c in df.columns], (F.col("_o") + F.col("_in_leaf")).alias(rank))


def _in_hot_leaf(rows: DataFrame, leaf: list[str], hash_col: str, ties: list[str | Column]) -> DataFrame:
    """Rows of leaves of more than HOT_ROWS rows (with their count ``_n``), with their place in the leaf."""
    names = [c for c in rows.columns if c != "_n"]
    same = F.struct(F.col(hash_col).alias("h"), *[F.struct(c.isNull().alias("n"), c.alias("v")).alias(f"t{i}") for i, c in enumerate(F.col(t) if isinstance(t, str) else t for t in ties)])
    rows = stored(rows.withColumn("_same", same).withColumn("_row", F.monotonically_increasing_id()).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.ceil(F.col("_n") / HOT_ROWS))), "hot")
    cells = stored(rows.groupBy(*leaf, "_same", "_salt").agg(F.count(F.lit(1)).alias("_c")), "cells")
    before = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    salts = cells.withColumn("_by_salt", before(Window.partitionBy(*leaf, "_same").orderBy("_salt")))
    sames = cells.groupBy(*leaf, "_same").agg(F.sum("_c").alias("_c")).withColumn("_by_same", before(Window.partitionBy(*leaf).orderBy("_same"))).drop("_c")
    at = rows.join(salts.drop("_c"), [*leaf, "_same", "_salt"]).join(sames, [*leaf, "_same"])
    inside = F.row_number().over(Window.partitionBy(*leaf, "_same", "_salt").orderBy("_row")) - 1
    return at.withColumn("_in_leaf", F.col("_by_same") + F.col("_by_salt") + inside).select(*names, "_in_leaf")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, p in enumerate((_P, _P_INVERSE)):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each white-space separated word, in order. Work and memory follow the length of the text."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    gap = SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``words`` words; a shorter text that has words is one shingle."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(w))):
        h = h * np.uint64(0x2545F4914F6CDD1D) + w[k : k + n]
    return np.unique(mixed(h))


def schema_of(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)
