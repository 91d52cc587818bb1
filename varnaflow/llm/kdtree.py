"""Sharding by a k-d tree over document metadata (DataFrame functions only).

A node that holds more than one shard is cut at the weighted median (by bytes) along its widest metadata dimension, until
each leaf has the bytes of one shard. Dimensions, all functions of the text alone: its bytes, its bytes a character, its
lines. Behind the dimension a key carries 42 bits of the text's hash, so equal texts share every key and lie on one side of
a cut, and texts that tie in the dimension can still be parted. A group of equal texts that holds the median goes whole to
the side that it brings nearer to its share, as long as the mean shard of both sides stays within ``tolerance`` of all bytes
over all shards. Only where that fails is the group cut inside, along the md5 of the ids (and a hash of the row, for ids that
repeat): with the law ``bytes`` a very large group must be spread.

Medians are distributed. One pass of a level sums every node's bytes by coarse bins of all dimensions, which gives the widest
dimension and the bin of the median; further passes look inside that bin, by 4096 bins each, until it weighs next to nothing
or is a single key. The cuts of a level are a table of one row a node, made and kept in Spark: rows meet it in a broadcast
join up to BROADCAST_NODES nodes; beyond, a node holds so few of the rows that the join is shuffled without skew. The driver
sees only whether a cut is open. Slots come from a tree of counts. Only ids, sizes and keys are read again, never the texts.

Defined cases: a null text has no bytes and size 1; null ids count as the empty text in the order of slots; repeated rows
are rows of their own (equal rows tie); an empty table gives an empty result; further columns are not used; a text heavier
than a shard makes its shard as heavy, and shards may stay empty when rows are too few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import distributed_rank, stored, with_id_hash

BINS, FINE, TOLERANCE = 4096, 0.0005, 0.05
BROADCAST_NODES = 100_000  # of some 80 bytes
HASH_BITS, COARSE_BITS, ROW_BITS, KEYS = 42, 50, 22, 3


def _scaled(x: Column) -> Column:
    """0 to 2^20 - 1, monotone: 2^14 steps for each doubling."""
    return F.least(F.floor(F.log2(F.greatest(x, F.lit(1.0))) * 16384), F.lit((1 << 20) - 1)).cast("long")


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, the keys k0, k1, k2, the hash of the id as text (_h), and (_n) 40 bits of it before 22 of a hash of the row, and the node (_first). Store it: the row is a number of the run."""
    text = F.coalesce(docs[text_col], F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(docs[id_col].alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).bitwiseAND((1 << HASH_BITS) - 1).alias("_t"), F.length(text).alias("_chars"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("_lines"))
    dims = (F.col("size").cast("double"), F.lit(64.0) * F.col("size") / (F.col("_chars") + 1), F.col("_lines").cast("double"))
    rows = rows.select("id", "size", "text_crc32", *[(F.shiftleft(_scaled(x), HASH_BITS) + F.col("_t")).alias(f"k{i}") for i, x in enumerate(dims)])
    rows = with_id_hash(rows, "id")
    row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << ROW_BITS) - 1)
    return rows.withColumn("_n", F.shiftleft(F.conv(F.substring("_h", 1, 10), 16, 10).cast("long"), ROW_BITS) + row).withColumn("_first", F.lit(0).cast("long"))


def _met(rows: DataFrame, cuts: DataFrame, nodes: int) -> DataFrame:
    """Rows beside their node's cut; ``_first``, a node's first shard, is its name."""
    return rows.join(F.broadcast(cuts) if nodes <= BROADCAST_NODES else cuts, "_first")


def _key(dim: Column) -> Column:
    return F.coalesce(*[F.when(dim == i, F.col(f"k{i}")) for i in range(KEYS)])


def _open(cuts: DataFrame) -> Column:
    return (F.col("lo") < F.col("hi")) & (F.col("inside") > FINE * F.col("weight"))


def _holding(hist: DataFrame) -> DataFrame:
    """Of (_first, ..., want, below, bin, w): the bin of each node in which the weight before reaches ``want``, with its own below and inside."""
    reached = F.col("below") + F.sum("w").over(Window.partitionBy("_first").orderBy("bin"))
    hist = hist.withColumn("_to", reached).filter((F.col("_to") >= F.col("want")) & (F.col("_to") - F.col("w") < F.col("want")))
    return hist.withColumn("below", F.col("_to") - F.col("w")).withColumn("inside", F.col("w")).drop("_to", "w", "bin")


CUT = ("_first", "_leaves", "dim", "weight", "want", "lo", "hi", "below", "inside")


def _coarse(rows: DataFrame, nodes: DataFrame, spread: list[int]) -> DataFrame:
    """The cut of each node (_first, _leaves) as far as coarse bins tell: one pass for all nodes and dimensions."""
    each = rows.select("_first", "size", F.posexplode(F.array(*[F.col(f"k{i}") for i in range(KEYS)])).alias("dim", "key"))
    hist = each.groupBy("_first", "dim", F.shiftright("key", COARSE_BITS).alias("bin")).agg(F.sum("size").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    node_dim, node = Window.partitionBy("_first", "dim"), Window.partitionBy("_first")
    width = (F.shiftright(F.max("hi").over(node_dim), HASH_BITS) - F.shiftright(F.min("lo").over(node_dim), HASH_BITS)) / F.element_at(F.array(*[F.lit(float(x)) for x in spread]), F.col("dim") + 1)
    hist = hist.withColumn("weight", F.sum("w").over(node_dim)).withColumn("_width", width)
    hist = hist.withColumn("_best", F.min(F.struct(-F.col("_width"), F.col("dim"))).over(node).getField("dim")).filter("dim = _best")
    hist = hist.join(nodes.filter("_leaves > 1"), "_first").withColumn("want", F.col("weight") * F.floor(F.col("_leaves") / 2) / F.col("_leaves")).withColumn("below", F.lit(0).cast("long"))
    return _holding(hist).select(*CUT)


def _finer(rows: DataFrame, cuts: DataFrame, nodes: int, name: str, key=lambda dim: _key(dim)) -> DataFrame:
    """Cuts whose bin is a single key or weighs next to nothing: passes inside the bins of those that are still open."""
    while open_ := cuts.filter(_open(cuts)).count():
        asked = cuts.filter(_open(cuts)).withColumn("step", F.floor((F.col("hi") - F.col("lo")) / BINS) + 1)
        inside = _met(rows, asked.select("_first", "dim", "lo", "hi", "step"), min(nodes, open_)).withColumn("_k", key(F.col("dim"))).filter("_k >= lo AND _k <= hi")
        hist = inside.groupBy("_first", F.floor((F.col("_k") - F.col("lo")) / F.col("step")).alias("bin")).agg(F.sum("size").alias("w"), F.min("_k").alias("lo"), F.max("_k").alias("hi"))
        found = _holding(hist.join(asked.drop("lo", "hi", "inside", "step"), "_first")).select(*CUT)
        cuts = stored(cuts.filter(~_open(cuts)).select(*CUT).unionByName(found), name)
    return cuts


def with_shards(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``shard`` to rows made by ``with_keys`` (a stored table: it is read several times)."""
    ends = rows.agg(F.sum("size"), *[f(F.shiftright(f"k{i}", HASH_BITS)) for i in range(KEYS) for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return rows.withColumn("shard", F.lit(0))
    spread, mean = [max(1, ends[2 + 2 * i] - ends[1 + 2 * i]) for i in range(KEYS)], ends[0] / shards
    nodes = rows.sparkSession.range(1).select(F.col("id").alias("_first"), F.lit(shards).cast("long").alias("_leaves"))
    half, level = F.floor(F.col("_leaves") / 2).cast("long"), 0
    while 1 << level < shards:
        many = 1 << level
        cuts = _finer(rows, stored(_coarse(rows, nodes, spread), "cuts"), many, "cuts")
        # the bin goes to the side that it brings nearer to its share: whole, if it is no single key or if the sides bear it
        cuts = cuts.withColumn("_left", F.col("want") - F.col("below") >= F.col("inside") / 2)
        on_left = F.col("below") + F.when(F.col("_left"), F.col("inside")).otherwise(0)
        off = F.greatest(F.abs(on_left / half / mean - 1), F.abs((F.col("weight") - on_left) / (F.col("_leaves") - half) / mean - 1))
        cuts = stored(cuts.withColumn("_part", (F.col("lo") == F.col("hi")) & (F.col("inside") > FINE * F.col("weight")) & (off > tolerance)), "sides")
        cuts = cuts.withColumn("_from", F.when(F.col("_left") & ~F.col("_part"), F.col("hi") + 1).otherwise(F.col("lo")))
        parted = cuts.filter("_part")
        if parts := parted.count():
            groups = _met(rows, parted.select("_first", "dim", F.col("lo").alias("_group")), parts).filter(_key(F.col("dim")) == F.col("_group")).drop("dim", "_group")
            inner = parted.select("_first", "_leaves", "dim", F.col("inside").alias("weight"), (F.col("want") - F.col("below")).alias("want"), F.lit(0).cast("long").alias("lo"), F.lit((1 << 62) - 1).alias("hi"), F.lit(0).cast("long").alias("below"), "inside")
            inner = _finer(groups, inner, parts, "parts", lambda _: F.col("_n"))
            cuts = cuts.join(inner.select("_first", F.when(F.col("want") - F.col("below") >= F.col("inside") / 2, F.col("hi") + 1).otherwise(F.col("lo")).alias("_from_n")), "_first", "left")
        else:
            cuts = cuts.withColumn("_from_n", F.lit(None).cast("long"))
        cuts = stored(cuts.select("_first", "_leaves", "dim", "_from", "_from_n"), "level")
        met = _met(rows, nodes.join(cuts.drop("_leaves"), "_first", "left"), many)
        left = (_key(F.col("dim")) < F.col("_from")) | ((_key(F.col("dim")) == F.col("_from")) & (F.col("_n") < F.coalesce("_from_n", F.lit(0))))
        moved = met.withColumn("_first", F.when((F.col("_leaves") > 1) & ~left, F.col("_first") + half).otherwise(F.col("_first")))
        rows = moved.select(*rows.columns)
        if level % 4 == 3:
            rows = stored(rows, "placed")
        both = nodes.filter("_leaves > 1")
        nodes = nodes.filter("_leaves = 1").unionByName(both.select("_first", half.alias("_leaves"))).unionByName(both.select((F.col("_first") + half).alias("_first"), (F.col("_leaves") - half).alias("_leaves")))
        nodes = stored(nodes, "nodes")
        level += 1
    return rows.withColumn("shard", F.col("_first").cast("int"))


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row; as many shards as ``shards`` or as ``target_bytes`` asks for."""
    rows = stored(with_keys(docs, id_col, text_col), "keys")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    placed = with_shards(rows, shards).select("id", "size", "text_crc32", "shard", F.md5(F.concat("_h", F.lit("|"), "size", F.lit("|"), "text_crc32").cast("binary")).alias("_h"))
    ranked = distributed_rank(placed, ["shard"], "_h", ["id", "size", "text_crc32"], "slot")
    return ranked.select("id", "size", "text_crc32", "shard", F.col("slot").cast("long"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
