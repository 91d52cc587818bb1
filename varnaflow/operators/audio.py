"""Audio as arrays: resampling by a windowed sinc, log-mel features, overlapping windows and the texts they give.

Each row is one recording and is worked on in numpy over Arrow batches. Windows of a recording are rows of their own, so a
long recording is transcribed by many tasks; its texts are merged by the words that neighbours share. Features are made window
by window and handed on in small batches: bytes are decoded there, so a task holds one Arrow batch of them (64 MB by Spark's
default) and not their samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, SECONDS = 16_000, 30
WINDOW, HOP, MELS = 400, 160, 80
#: Zero crossings of the sinc on either side, the share of the band that passes, and the Kaiser window's shape.
CROSSINGS, PASSES, SHAPE = 32, 0.92, 10.0
OUTPUTS = 1 << 14
#: Bytes of features after which a task hands them on.
HELD_BYTES = 1 << 22


@lru_cache(maxsize=16)
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """Taps by phase (rows), each row of sum 1, and how many inputs before an output's place they begin."""
    wide = max(up, down)
    half = CROSSINGS * wide  # in steps of the rate that both divide
    reach = -(-half // up)  # inputs on either side
    at = (np.arange(up)[:, None] - up * np.arange(-reach, reach + 2)[None, :]).astype(np.float64)  # from each tap's input to the output
    taps = np.where(np.abs(at) <= half, np.sinc(at * PASSES / wide) * np.i0(SHAPE * np.sqrt(np.maximum(0.0, 1 - (at / half) ** 2))), 0.0)
    return taps / taps.sum(axis=1, keepdims=True), reach


class Resampler:
    """Resamples one channel chunk by chunk: the outputs of all chunks together are those of the whole. At either end the last sample is held."""

    def __init__(self, rate: int, to: int = RATE):
        common = gcd(rate, to)
        self.up, self.down = to // common, rate // common
        self.taps, self.reach = _phases(self.up, self.down)
        self.kept, self.first, self.seen, self.made = np.empty(0), 0, 0, 0  # the inputs still needed, the number of the first, of all, and of outputs

    def push(self, samples: np.ndarray) -> np.ndarray:
        x = np.asarray(samples, np.float64)
        if not len(x):
            return np.empty(0)
        if not self.seen:
            x = np.concatenate([np.full(self.reach, x[0]), x])
            self.first, self.seen = -self.reach, -self.reach
        self.kept, self.seen = np.concatenate([self.kept, x]), self.seen + len(x)
        return self._outputs(max(0, -(-(self.seen - self.reach - 1) * self.up // self.down)))

    def flush(self) -> np.ndarray:
        """The outputs that wait for inputs behind the end."""
        if self.seen <= 0:
            return np.empty(0)
        n, total = self.seen, int(round(self.seen * self.up / self.down))
        self.kept = np.concatenate([self.kept, np.full(self.reach + 2, self.kept[-1])])
        out = self._outputs(max(self.made, total))
        self.kept, self.first, self.seen, self.made = np.empty(0), 0, 0, 0
        return out if n else np.empty(0)

    def _outputs(self, until: int) -> np.ndarray:
        parts = []
        for begin in range(self.made, until, OUTPUTS):
            at = np.arange(begin, min(until, begin + OUTPUTS)) * self.down
            first = at // self.up - self.reach - self.first
            inputs = self.kept[first[:, None] + np.arange(self.taps.shape[1])]
            parts.append((inputs * self.taps[at % self.up]).sum(axis=1))
        self.made = max(self.made, until)
        drop = max(0, self.made * self.down // self.up - self.reach - self.first)
        self.kept, self.first = self.kept[drop:], self.first + drop
        return np.concatenate(parts) if parts else np.empty(0)


def resampled(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """One channel at another rate; the length is rounded. What lies above the new band is gone."""
    if rate == to or not len(samples):
        return np.asarray(samples, np.float32)
    r = Resampler(rate, to)
    return np.concatenate([r.push(samples), r.flush()]).astype(np.float32)


def _decoded(data: np.ndarray) -> np.ndarray:
    return (data.astype(np.float32) - 128) / 128


def pcm(data: Column) -> Column:
    """Bytes as samples of 8 bits, from -1 to 1."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else _decoded(np.frombuffer(v, np.uint8)) for v in values], dtype=object)

    return F.pandas_udf(run, "array<float>")(data)


def resampled_column(samples: Column, rate: int, to: int = RATE) -> Column:
    """An array of samples at another rate."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else resampled(v, rate, to) for v in values], dtype=object)

    return F.pandas_udf(run, "array<float>")(samples)


@lru_cache(maxsize=4)
def mel_filters(bands: int = MELS, rate: int = RATE, window: int = WINDOW) -> np.ndarray:
    """Triangles on a scale that is linear to 1 kHz and logarithmic above, each of area 1: (bands, window / 2 + 1)."""
    step, bend = 200 / 3, np.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, f / step, 15 + np.log(np.maximum(f, 1000) / 1000) / bend)
    to_hz = lambda m: np.where(m < 15, m * step, 1000 * np.exp((m - 15) * bend))
    edges = to_hz(np.linspace(0, float(to_mel(np.array(rate / 2))), bands + 2))
    f = np.arange(window // 2 + 1) * rate / window
    rise = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray, seconds: int = SECONDS, bands: int = MELS, padded: bool = True) -> np.ndarray:
    """(frames, bands) of the first ``seconds`` at RATE, as if silence followed up to there. padded: frames of that silence too.

    A frame is WINDOW samples around every HOP-th one (mirrored at the beginning), under a Hann window; the powers of its
    Fourier transform are summed by ``mel_filters``; of that the logarithm to base 10, not more than 8 below the largest, plus 4,
    by 4. Frames of silence are all alike, so they are not computed.
    """
    most, half = RATE * seconds, WINDOW // 2
    x = np.asarray(samples, np.float64)[:most]
    frames = min(most // HOP, -(-(len(x) + half) // HOP)) if len(x) else 0
    x = np.concatenate([x, np.zeros(max(half + 1, most + half - len(x) if len(x) > most - half else WINDOW + HOP))])
    tail = x[most - half - 1 : most - 1][::-1] if frames * HOP + half > most and len(samples) > most - half else np.zeros(half)
    x = np.concatenate([x[half:0:-1], x[:most], tail])
    x = np.concatenate([x, np.zeros(max(0, frames * HOP + WINDOW - len(x)))])
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    power = np.empty((frames, bands))
    for k in range(0, frames, 1000):
        at = np.arange(k, min(frames, k + 1000)) * HOP
        power[k : k + 1000] = np.abs(np.fft.rfft(x[at[:, None] + np.arange(WINDOW)] * hann, axis=1)) ** 2 @ mel_filters(bands).T
    logs = np.log10(np.maximum(power, 1e-10))
    least = max(float(logs.max()) if frames else -10.0, -10.0) - 8
    out = (np.maximum(logs, least) + 4) / 4
    if padded:
        out = np.concatenate([out, np.full((most // HOP - frames, bands), (max(-10.0, least) + 4) / 4)])
    return out.astype(np.float32)


def windows(samples: np.ndarray, seconds: float = SECONDS, overlap: float = 0.0, rate: int = RATE) -> list[np.ndarray]:
    """Stretches of ``seconds`` that share ``overlap`` seconds with the next; the last one ends with the samples."""
    size, step = int(rate * seconds), int(rate * (seconds - overlap))
    if step <= 0:
        raise ValueError("windows must be longer than what they share")
    return [samples[k : k + size] for k in range(0, max(1, len(samples) - (size - step)), step)] if len(samples) else []


def _feature_batches(batches: Iterator[pa.RecordBatch], seconds: int, bands: int, padded: bool) -> Iterator[pa.RecordBatch]:
    """Of (key, bytes or samples): (k, part, n, f), whole windows, in batches of about HELD_BYTES."""

    def handed(keys: pa.Array, rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        at, parts, made = zip(*rows, strict=True)
        ends = np.cumsum([0, *[f.size for f in made]], dtype=np.int32)
        columns = [keys.take(pa.array(at)), pa.array(parts, pa.int32()), pa.array([len(f) for f in made], pa.int32()), pa.ListArray.from_arrays(ends, np.concatenate([f.ravel() for f in made]))]
        return pa.RecordBatch.from_arrays(columns, names=["k", "part", "n", "f"])

    for batch in batches:
        keys, audio = batch.columns
        raw = pa.types.is_binary(audio.type) or pa.types.is_large_binary(audio.type)
        rows, held = [], 0
        for i, x in enumerate(audio):
            if not x.is_valid:
                continue
            for part, w in enumerate(windows(np.frombuffer(x.as_buffer(), np.uint8) if raw else x.values.to_numpy(zero_copy_only=False), seconds)):
                rows.append((i, part, log_mel(_decoded(w) if raw else w, seconds, bands, padded)))
                held += rows[-1][2].nbytes
                if held >= HELD_BYTES:
                    yield handed(keys, rows)
                    rows, held = [], 0
        if rows:
            yield handed(keys, rows)


def features(audio: DataFrame, key: str, samples: str, seconds: int = SECONDS, bands: int = MELS, padded: bool = True) -> DataFrame:
    """(key, part, n_frames, features): a row for each ``seconds`` of a recording, features by frame, then band. Null and empty recordings have none.

    ``samples`` is an array of samples, or bytes that are samples of 8 bits as for ``pcm``: a quarter of the array's memory.
    """
    kind = audio.select(key).dtypes[0][1]
    run = lambda batches: _feature_batches(batches, seconds, bands, padded)
    out = audio.select(F.col(key).alias("k"), F.col(samples).alias("x")).mapInArrow(run, f"k {kind}, part int, n int, f array<float>")
    return out.select(F.col("k").alias(key), "part", F.col("n").alias("n_frames"), F.col("f").alias("features"))


def seam(left: list[str], right: list[str], shared: int | None = None) -> tuple[int, int]:
    """Where to change from the left words to the right ones: the end of the longest run of words that they have in common.

    shared: how many words the ends should share, if that is known. Then only these are compared, and each word by which a
    run is off that place counts two words less, so a text that repeats itself is not cut short. Equal runs: the later one on the left.
    """
    a = left[-shared:] if shared else left
    b = right[:shared] if shared else right
    code: dict[str, int] = {}
    x, y = (np.fromiter((code.setdefault(w, len(code)) for w in ws), np.int64, len(ws)) for ws in (a, b))
    best, run = (0, 0, 0, 0), np.zeros(len(y) + 1, np.int64)
    for i in range(len(x)):
        run[1:] = np.where(y == x[i], run[:-1] + 1, 0)
        worth = run[1:] - 2 * np.abs((i - len(x)) - (np.arange(len(y)) - (shared or 0))) if shared else run[1:]
        j = int(np.where(run[1:] > 0, worth, -(1 << 40)).argmax()) if len(y) else 0
        if len(y) and run[j + 1] and (int(worth[j]), i) >= best[:2]:
            best = (int(worth[j]), i, j, int(run[j + 1]))
    if not best[3]:
        return len(left), 0
    return len(left) - len(a) + best[1] + 1, best[2] + 1


def merged(parts: list[list[str]], shared: int | None = None) -> list[str]:
    """The words of overlapping windows as one text: neighbours are joined at their ``seam``, what the left one has behind it and the right one before it goes."""
    out: list[str] = []
    since = 0  # the words of the last window begin here
    for words in parts:
        keep, skip = seam(out[since:], words, shared) if out else (0, 0)
        del out[since + keep :]
        since = len(out) - skip if skip else len(out)
        out += words[skip:]
        since = max(0, since)
    return out


def merged_text(parts: Column, shared: int | None = None) -> Column:
    """One text of an array of window texts, in order."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(merged([(t or "").split() for t in ts], shared)) if ts is not None else None for ts in texts], dtype=object)

    return F.pandas_udf(run, "string")(parts)


def transcribed(audio: DataFrame, make: Callable[[], Callable[[list[np.ndarray]], list[str]]], key: str, samples: str, rate: int = RATE, seconds: float = SECONDS, overlap: float = 0.0) -> DataFrame:
    """(key, prediction): each window of a recording is a row for the model; the texts of a recording are merged, without overlap joined by blanks.

    ``make`` returns the function that works on a list of windows, once a task. Rows of one key are one recording each.
    """
    size, step = int(rate * seconds), int(rate * (seconds - overlap))
    if step <= 0:
        raise ValueError("windows must be longer than what they share")
    rows = audio.select(F.col(key).cast("string").alias("k"), F.monotonically_increasing_id().alias("row"), F.coalesce(samples, F.array().cast("array<float>")).alias("x"))
    n = F.when(F.size("x") == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((F.size("x") - (size - step)) / step)))
    cut = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<bigint>")), lambda p: F.struct(p.alias("part"), F.slice("x", (p * step + 1).cast("int"), F.lit(size)).alias("w")))
    pieces = rows.select("k", "row", F.explode_outer(cut).alias("c")).select("k", "row", "c.part", "c.w")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            given = [np.asarray(w, np.float32) for w in pdf["w"] if w is not None]
            texts = iter(model(given) if given else [])
            yield pd.DataFrame({"k": pdf["k"], "row": pdf["row"], "part": pdf["part"], "text": [next(texts) if w is not None else "" for w in pdf["w"]]})

    said = pieces.mapInPandas(run, "k string, row long, part long, text string")
    texts = said.groupBy("row").agg(F.first("k").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x.text).alias("texts"))
    text = merged_text(F.col("texts")) if overlap else F.array_join("texts", " ")
    return texts.select(F.col("k").alias(key), F.trim(text).alias("prediction"))
