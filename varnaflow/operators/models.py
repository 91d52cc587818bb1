"""Where a model enters: hooks over Arrow batches, the model loaded once a worker process.

Model weights are outside this library: a caller hands over ``make``, which returns the function that works on a batch.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists
from .audio import RATE, resampled, transcribed  # noqa: F401

def wav_samples(data: bytes) -> tuple[np.ndarray, int]:
    """One channel of a PCM WAV file (the mean of its channels), from -1 to 1, and its rate."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / (1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width} bit samples")
    return x.reshape(-1, channels).mean(axis=1), rate


def decoded(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[np.ndarray, int]] = wav_samples, to: int = RATE) -> DataFrame:
    """(path, samples): audio files decoded and resampled to ``to``. A file that can't be decoded has no samples (null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                try:
                    out.append(resampled(*decode(content), to))
                except (ValueError, EOFError, wave.Error):
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "samples": out})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, samples array<float>")


def present(spark: SparkSession, paths: dict[str, str | None]) -> list[str]:
    """The names of models that are there, in order: those without a path always, the others if their path exists."""
    return [name for name, path in paths.items() if path is None or exists(spark, path)]


def prepared(rows: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Features and label ids in place of the columns of ``rows``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        convert = make()
        for pdf in batches:
            yield convert(pdf)

    return rows.mapInPandas(run, schema)


def best_checkpoint(step: str = "step", wer: str = "wer") -> Column:
    """The step of the lowest rate; an aggregate, the earliest step on ties."""
    return F.min(F.struct(F.col(wer), F.col(step)))[step]
