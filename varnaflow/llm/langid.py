"""Language identification: spans of mixed-language texts by Viterbi over per-word scores.

Words are runs of letters. A word's script (SCRIPTS, by its first letter) narrows the languages: only those that write at
least LEAST_SHARE of their letters in that script stay, all of them if there are none. Its score in each language is the mean
over ORDERS of the logarithms of its smoothed n-gram shares, boundaries included; n-grams are counted by hash over all
training rows, as sums over partitions, so the model has a fixed size for each language. Viterbi takes the sequence of
languages with the best sum of scores, less SWITCH for each change of language; the words of one language in a row are a span.

A text needs no Viterbi where one language is proven best: if no stretch gains SWITCH by any other languages (a maximum over
stretches of the best language's deficit at each word), every path with changes is worse. All other texts take the full way.

Learned from: rows with a language that are not held out (crc32 of the id as text, mod 3 = 1). Neither lang, source nor
doc_id enter a prediction. The language of a text is that with most letters in its spans; the score is its share of letters.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and no spans; a null id counts as empty text in
the held-out rule; null languages teach nothing, an empty one is a language; equal sums stay with the language before, then
go to the smaller name; without training rows all texts are ``und``; more than MOST_LANGUAGES languages are an error;
repeated rows are rows like others; an empty table gives an empty result; further columns are not used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, ORDERS, SMOOTHING, LEAST_SHARE, SWITCH, MOST_LANGUAGES = 1 << 16, (1, 2, 3, 4), 0.5, 0.01, 8.0, 256
#: Words whose scores a worker keeps, and the longest of them.
KEPT, KEPT_LETTERS = 200_000, 64
#: Below the least of a word's candidates by so much, languages that its script rules out can't win a word.
RULED_OUT = 1e6
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The ranges of scripts, by first and last code point; letters elsewhere are of script 0.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x58F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),), "gurmukhi": ((0xA00, 0xA7F),), "gujarati": ((0xA80, 0xAFF),), "tamil": ((0xB80, 0xBFF),), "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),), "malayalam": ((0xD00, 0xD7F),), "thai": ((0xE00, 0xE7F),), "georgian": ((0x10A0, 0x10FF),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)), "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
_STARTS = np.array(sorted(a for ranges in SCRIPTS.values() for a, _ in ranges))
_ENDS, _NUMBERS = np.array([[b, k] for _, b, k in sorted((a, b, k) for k, ranges in enumerate(SCRIPTS.values(), 1) for a, b in ranges)]).T


def script_of(letters: np.ndarray) -> np.ndarray:
    """The number of the script of each code point, 0 for others."""
    k = np.searchsorted(_STARTS, letters, side="right") - 1
    return np.where((k >= 0) & (letters <= _ENDS[k]), _NUMBERS[k], 0)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many words: each n-gram's bucket, the word it is from, and its order. A word is framed by one mark on either side."""
    points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = points == 0
    word = np.cumsum(edge) - 1
    h, inside = np.zeros(len(points), np.uint64), np.ones(len(points), bool)
    buckets, owners, orders = [], [], []
    for order in ORDERS:
        m = len(points) - order + 1
        if m <= 0:
            break
        if order > 2:  # no mark between the first and the last
            inside = inside[:m] & ~edge[order - 2 : order - 2 + m]
        h = (h[:m] * np.uint64(0x2545F4914F6CDD1D)) + points[order - 1 :] + np.uint64(1)
        use = np.flatnonzero((inside[:m] & ~edge) if order == 1 else inside[:m])
        mixed = h[use] * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
        owners.append(word[use])
        orders.append(np.full(len(use), order))
    return np.concatenate(buckets), np.concatenate(owners), np.concatenate(orders)


@dataclass
class Model:
    """languages by name; weights: logarithms of n-gram shares (bucket by language); written: scripts by language, whether it is written in it."""

    languages: list[str]
    weights: np.ndarray
    written: np.ndarray
    switch: float = SWITCH
    place: dict[str, int] = field(default_factory=dict, repr=False)
    used: int = field(default=0, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)
    sizes: np.ndarray | None = field(default=None, repr=False)

    def scores(self, words: list[str]) -> np.ndarray:
        """Words by languages."""
        lower = [w.lower() for w in words]
        buckets, owners, _ = grams_of(lower)
        out = np.stack([np.bincount(owners, self.weights[buckets, k], len(words)) for k in range(len(self.languages))], axis=1) / len(ORDERS)
        may = self.written[script_of(np.array([ord(w[0]) for w in words]))]
        may |= ~may.any(axis=1, keepdims=True)
        return np.where(may, out, np.where(may, out, np.inf).min(axis=1, keepdims=True) - RULED_OUT)

    def scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and letters of the words of a text; those of words met before are kept, at most KEPT of them when a text begins, none long."""
        if self.table is None or self.used > KEPT:
            self.place, self.used, self.table, self.sizes = {}, 0, np.empty((0, len(self.languages))), np.empty(0, np.int64)
        place, first = self.place, self.used
        new = [w for w in dict.fromkeys(words) if w not in place]
        if new:
            self.used += len(new)
            place.update(zip(new, range(first, self.used), strict=True))
            if self.used > len(self.table):  # room for twice as many
                room = 2 * self.used - len(self.table)
                self.table = np.concatenate([self.table, np.empty((room, len(self.languages)))])
                self.sizes = np.concatenate([self.sizes, np.empty(room, np.int64)])
            self.table[first : self.used], self.sizes[first : self.used] = self.scores(new), np.fromiter(map(len, new), np.int64, len(new))
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) > KEPT_LETTERS:
                del place[w]
        return self.table[at], self.sizes[at]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word, by number."""
        best = int(scores.sum(axis=0).argmax())
        others = np.delete(scores, best, axis=1)
        if not others.shape[1]:
            return np.full(len(scores), best)
        gain = np.cumsum(others.max(axis=1) - scores[:, best])
        if (gain - np.minimum.accumulate(np.r_[0.0, gain[:-1]])).max() < self.switch:  # the most that a stretch gains by other languages
            return np.full(len(scores), best)
        return viterbi(scores, self.switch)

    def labelled(self, text: str | None) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """Spans (language, start, end) in characters of the text, and the letters of each language."""
        letters = np.zeros(len(self.languages), np.int64)
        found = list(_WORD.finditer(text or "")) if self.languages else []
        if not found:
            return [], letters
        scores, sizes = self.scored([m.group() for m in found])
        path = self.path(scores)
        cut = np.r_[0, np.flatnonzero(np.diff(path)) + 1, len(path)].tolist()
        np.add.at(letters, path, sizes)
        return [(int(path[a]), found[a].start(), found[b - 1].end()) for a, b in zip(cut, cut[1:], strict=False)], letters

    def told(self, text: str | None) -> tuple[str, float, int]:
        """The language with most letters, its share of them, and the number of spans."""
        words = _WORD.findall(text or "") if self.languages else []
        if not words:
            return UNKNOWN, 0.0, 0
        scores, sizes = self.scored(words)
        path = self.path(scores)
        letters = np.bincount(path, sizes, len(self.languages))
        best = int(letters.argmax())
        return self.languages[best], float(letters[best] / letters.sum()), int(np.count_nonzero(np.diff(path))) + 1


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The sequence with the best sum of scores less ``switch`` for each change."""
    languages = range(scores.shape[1])
    rows, came = scores.tolist(), []
    best = rows[0]
    for row in rows[1:]:
        top = max(best)
        source, least = best.index(top), top - switch
        stays = [b >= least for b in best]
        came.append([k if stays[k] else source for k in languages])
        best = [(best[k] if stays[k] else least) + row[k] for k in languages]
    out = np.empty(len(rows), np.int64)
    out[-1] = now = best.index(max(best))
    for i in range(len(rows) - 2, -1, -1):
        out[i] = now = came[i][now]
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _counter(place: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a partition: letters by script (buckets -1 and below) and n-grams by bucket."""
        counts, scripts, seen = [np.zeros(BUCKETS) for _ in place], [np.zeros(len(SCRIPTS) + 1) for _ in place], [Counter() for _ in place]

        def summed(k: int) -> None:
            if seen[k]:
                words, times = list(seen[k]), np.fromiter(seen[k].values(), np.float64, len(seen[k]))
                buckets, owners, _ = grams_of([w.lower() for w in words])
                counts[k] += np.bincount(buckets, times[owners], BUCKETS)
                scripts[k] += np.bincount(script_of(np.array([ord(w[0]) for w in words])), times * [len(w) for w in words], len(SCRIPTS) + 1)
                seen[k].clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = place[lang]
                seen[k].update(_WORD.findall(text.as_py() or ""))
                if len(seen[k]) > KEPT // len(place):
                    summed(k)
        for k in range(len(place)):
            summed(k)
            some, used = np.flatnonzero(counts[k]), np.flatnonzero(scripts[k])
            values = [np.r_[some, -1 - used], np.full(len(some) + len(used), k), np.r_[counts[k][some], scripts[k][used]].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in values], names=["bucket", "k", "n"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", switch: float = SWITCH, smoothing: float = SMOOTHING) -> Model:
    """The model of all rows that have a language and are not held out. The driver gets BUCKETS sums a language at most."""
    rows = docs.filter(docs[lang_col].isNotNull() & ~held_out(docs[id_col])).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = {x: k for k, x in enumerate(languages)}
    counts, letters = np.zeros((BUCKETS, len(languages))), np.zeros((len(SCRIPTS) + 1, len(languages)))
    if languages:
        sums = rows.mapInArrow(_counter(place), "bucket long, k long, n long").groupBy("bucket", "k").agg(F.sum("n").alias("n")).toPandas()
        gram = sums["bucket"] >= 0
        counts[sums["bucket"][gram], sums["k"][gram]] = sums["n"][gram]
        letters[-1 - sums["bucket"][~gram], sums["k"][~gram]] = sums["n"][~gram]
    weights = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * BUCKETS)
    return Model(languages, weights, letters > 0 if not languages else letters >= np.maximum(LEAST_SHARE * letters.sum(axis=0), 1), switch)


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<lang, start, end>>): the spans of each text, from and to characters of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = [[{"lang": model.languages[k], "start": a, "end": b} for k, a, b in model.labelled(t.as_py())[0]] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, spans array<struct<lang:string,start:long,end:long>>")


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans) of every row."""

    def told(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.told(t) for t in texts], columns=["lang_pred", "score", "n_spans"])

    out = docs.select(docs[id_col].alias("doc_id"), F.pandas_udf(told, "lang_pred string, score double, n_spans long")(docs[text_col].cast("string")).alias("t"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "t.lang_pred", "t.score", "t.n_spans")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, train(docs))
