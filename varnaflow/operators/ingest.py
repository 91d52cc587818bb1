"""Recordings with transcripts to a filtered, split table of utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_text, preview, strip, words
from ..sources.files import stored


def hindi_only(index: DataFrame) -> DataFrame:
    """Rows whose language says Hindi; a table without that column is left alone."""
    return index.filter(F.lower("language").isin("hi", "hindi")) if "language" in index.columns else index


def url_rewritten(url: Column, old: str, new: str) -> Column:
    return F.replace(url, F.lit(old), F.lit(new))


def utterances(recordings: DataFrame, segments: str = "segments") -> DataFrame:
    """One row a segment {start, end, text}; segments without words go."""
    s = recordings.withColumn("_s", F.explode(segments)).drop(segments)
    s = s.withColumns({"start": F.coalesce(F.col("_s.start"), F.lit(0.0)), "end": F.coalesce(F.col("_s.end"), F.lit(0.0)), "raw_text": strip(F.coalesce(F.col("_s.text"), F.lit("")))}).drop("_s")
    s = s.withColumns({"duration": F.col("end") - F.col("start"), "text": normalize_text(F.col("raw_text"))})
    return s.filter((F.col("raw_text") != "") & (F.col("text") != ""))


def filtered(rows: DataFrame, least: float = 1.0, most: float = 30.0, least_words: int = 1) -> DataFrame:
    return rows.filter(F.col("duration").between(least, most) & (F.size(words(F.col("text"))) >= least_words))


def capped(rows: DataFrame, recording: str, most: int | None) -> DataFrame:
    """Whole recordings, in order, until ``most`` rows are reached: the last one is kept whole. At most ``most`` recordings can be among them, so no more reach the window."""
    if not most:
        return rows
    counts = rows.groupBy(recording).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.orderBy(recording).limit(most)
    before = F.coalesce(F.sum("_n").over(Window.orderBy(recording).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = counts.withColumn("_before", before).filter(F.col("_before") < most).select(recording)
    return rows.join(kept, recording, "left_semi")


def _mixed(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def shuffled(rows: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """All rows in the order of md5(seed | key): a distributed sort."""
    return rows.orderBy(_mixed(key, seed), key)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Adds the place of each row, from 0, in the order in which ``rows`` are: sorted rows come in ranges, one a partition.

    The rows are written once with a number that tells partition and place in it; counts by partition, one row each, give the places before.
    """
    kept = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).alias("_part")
    counts = kept.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # a row a partition
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_before") + inside).alias(name))


def demo_utterances(segments: DataFrame, user_id: int = 0, recording_id: int = 0, least: float = 1.0, most: float = 30.0) -> DataFrame:
    """The utterances of one recording (start, end, text) under given ids, filtered; one that punctuation makes empty goes by the filter."""
    one = segments.select(F.lit(user_id).cast("long").alias("user_id"), F.lit(recording_id).cast("long").alias("recording_id"), F.lit("").alias("audio_url"), F.lit("hi").alias("language"), F.array(F.struct("start", "end", "text")).alias("segments"))
    return filtered(utterances(one), least, most)


def head(rows: DataFrame, order: str, most: int = 5) -> DataFrame:
    """The first rows with short raw and normalised texts."""
    return rows.orderBy(order).limit(most).withColumns({"raw_text": preview(F.col("raw_text")), "text": preview(F.col("text"))})


def split(rows: DataFrame, key: Column, share: float = 0.9, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first floor(share * n) rows in the order of md5(seed | key) train, the others validate."""
    order = _mixed(key, seed)
    hashed = rows.select(order.alias("h"), key.alias("k"))
    counts = sorted((r["p"], r["count"]) for r in hashed.groupBy(F.substring("h", 1, 3).alias("p")).count().collect())  # at most 4096 rows
    left = int(sum(n for _, n in counts) * share)
    for prefix, n in counts:
        if n > left:
            break
        left -= n
    else:
        return rows.withColumn("split", F.lit("train"))
    inside = hashed.filter(F.substring("h", 1, 3) == prefix).orderBy("h", "k").limit(left).agg(F.max(F.struct("h", "k")).alias("m")).first()["m"]
    train = F.substring(order, 1, 3) < prefix
    if inside is not None:
        train = train | (order < inside["h"]) | ((order == inside["h"]) & key.eqNullSafe(F.lit(inside["k"])))
    return rows.withColumn("split", F.when(train, "train").otherwise("validation"))
