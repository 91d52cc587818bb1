"""Transcripts at URLs: as a Python data source for a list of them, and for a table of them with a status for each."""

from __future__ import annotations

import json
import logging
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from http.client import HTTPException

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .files import SEGMENTS, stored

#: Tasks that fetch, and requests of a task that are under way.
MOST_TASKS, AT_ONCE = 200, 8
ARRAY = "array<struct<start:double,end:double,text:string>>"
TIMEOUT_SECONDS = 30


def _number(value: object) -> float:
    """A segment's time; what is no number counts as 0."""
    try:
        return float(value or 0.0)
    except (TypeError, ValueError):
        return 0.0


def answered(url: str | None, timeout: float = TIMEOUT_SECONDS) -> tuple[str, list[tuple[float, float, str]]]:
    """What became of a URL ("ok", or why not), and its segments (start, end, text): the objects of the JSON array there."""
    if not url or not urllib.parse.urlsplit(url).scheme:
        return "no url", []
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            found = json.load(answer)
    except urllib.error.HTTPError as e:
        return f"status {e.code}", []
    except (OSError, HTTPException) as e:
        return f"not reached: {type(e).__name__}", []
    except ValueError:
        return "no json", []
    if not isinstance(found, list):
        return "no array", []
    return "ok", [(_number(u.get("start")), _number(u.get("end")), u["text"] if isinstance(u.get("text"), str) else "") for u in found if isinstance(u, dict)]


def fetched(url: str | None, timeout: float = TIMEOUT_SECONDS) -> list[tuple[float, float, str]]:
    """The segments at a URL; any failure is a warning and none."""
    status, segments = answered(url, timeout)
    if status != "ok":
        logging.getLogger(__name__).warning("could not fetch %s: %s", url, status)
    return segments


def host(url: str) -> str:
    return urllib.parse.urlsplit(url).netloc


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(urls)


class _Reader(DataSourceReader):
    """URLs in at most MOST_TASKS partitions, those of a host side by side; a filter on url leaves out the others before anything is fetched."""

    def __init__(self, options: dict[str, str]):
        self.urls, self.timeout = json.loads(options.get("urls", "[]")), float(options.get("timeout", TIMEOUT_SECONDS))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("url",):
                self.urls = [u for u in self.urls if u == f.value]
            elif isinstance(f, In) and f.attribute == ("url",):
                self.urls = [u for u in self.urls if u in set(f.value)]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        urls = sorted(self.urls, key=lambda u: (host(u), u))
        size = max(1, -(-len(urls) // MOST_TASKS))
        return [_Urls(urls[k : k + size]) for k in range(0, len(urls), size)] or [_Urls([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for url in partition.value:
            for segment in fetched(url, self.timeout):
                yield *segment, url


class Transcripts(DataSource):
    """``spark.read.format("transcripts").option("urls", <JSON array>)``."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return f"{SEGMENTS}, url string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_transcripts(spark: SparkSession, urls: list[str], timeout: float = TIMEOUT_SECONDS) -> DataFrame:
    """(start, end, text, url) of the utterances at the URLs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Transcripts)
    if not urls:
        return spark.createDataFrame([], f"{SEGMENTS}, url string")
    return spark.read.format("transcripts").option("urls", json.dumps(urls)).option("timeout", str(timeout)).load()


def fetch_table(index: DataFrame, url: str, timeout: float = TIMEOUT_SECONDS, tasks: int = MOST_TASKS, at_once: int = AT_ONCE) -> DataFrame:
    """Rows of an index with ``status`` and ``segments`` of their URL, each URL fetched once.

    Different URLs are dealt over at most ``tasks`` tasks by host and a salt, so a host meets few tasks and a large host is no
    task of its own; a task has ``at_once`` requests under way. What came back is written before it is used, so no plan fetches again.
    """
    urls = index.select(F.col(url).alias("_url")).filter("_url IS NOT NULL").distinct()
    salt = F.pmod(F.xxhash64("_url"), F.lit(max(1, tasks // 8)))
    name = F.regexp_extract("_url", "^[^:]*://([^/]*)", 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                got = list(pool.map(lambda u: answered(u, timeout), pdf["_url"]))
                yield pd.DataFrame({"_url": pdf["_url"], "status": [s for s, _ in got], "segments": [[dict(zip(("start", "end", "text"), x, strict=True)) for x in found] for _, found in got]})

    dealt = urls.withColumn("_host", name).repartition(tasks, F.col("_host"), salt).select("_url")
    got = stored(dealt.mapInPandas(run, f"_url string, status string, segments {ARRAY}"), "fetched")
    out = index.join(got, index[url] == got["_url"], "left").drop("_url")
    return out.withColumns({"status": F.coalesce("status", F.lit("no url")), "segments": F.coalesce("segments", F.array().cast(ARRAY))})


def with_segments(index: DataFrame, url: str, name: str = "segments", timeout: float = TIMEOUT_SECONDS) -> DataFrame:
    """Rows of an index with the utterances at their URL (an array; empty if it can't be had)."""
    found = fetch_table(index, url, timeout)
    failed = found.filter("status <> 'ok'").select(url, "status").limit(20).collect()
    for r in failed:
        logging.getLogger(__name__).warning("could not fetch %s: %s", r[0], r[1])
    return found.drop("status").withColumnRenamed("segments", name)
