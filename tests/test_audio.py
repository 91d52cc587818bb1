import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from varnaflow.operators import audio

SF = "/root/testdata/sf0.001"


def tone(hertz, rate, seconds=2.0):
    return np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("rate", [48_000, 44_100, 32_000, 22_050, 8_000])
def test_tones_pass_below_the_new_band_and_vanish_above(rate):
    low = audio.resampled(tone(1000, rate), rate)
    assert len(low) == 32_000 and np.abs(low - tone(1000, 16_000))[500:-500].max() < 1e-5
    for hertz in (8_200, 9_000, 10_500):
        if hertz < rate / 2:
            assert np.abs(audio.resampled(tone(hertz, rate), rate)[500:-500]).max() < 1e-3  # 60 dB
    assert np.abs(audio.resampled(np.full(rate, 0.5), rate) - 0.5).max() < 1e-6


@pytest.mark.parametrize("rate", [44_100, 22_050, 8_000, 16_000])
def test_chunks_give_the_same_samples_as_the_whole(rate):
    rng = np.random.default_rng(3)
    x, one, two, parts, k = rng.normal(size=rate * 3 + 77), audio.Resampler(rate), audio.Resampler(rate), [], 0
    whole = np.concatenate([one.push(x), one.flush()])
    while k < len(x):
        n = int(rng.integers(0, 9000))
        parts.append(two.push(x[k : k + n]))
        k += n
    parts.append(two.flush())
    assert np.array_equal(np.concatenate(parts), whole) and len(whole) == round(len(x) * 16_000 / rate)
    assert len(two.kept) == 0 and not len(audio.Resampler(rate).flush())


def direct(samples, frames):
    """Log-mel values by a direct transform of the whole padded signal."""
    full = np.zeros(480_000)
    full[: len(samples)] = samples
    p = np.concatenate([full[200:0:-1], full, full[-2:-202:-1]])
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    wave = np.exp(-2j * np.pi * np.outer(np.arange(201), np.arange(400)) / 400)
    power = np.array([np.abs(wave @ (p[t * 160 : t * 160 + 400] * hann)) ** 2 for t in frames])
    return np.log10(np.maximum(power @ audio.mel_filters().T, 1e-10))


@pytest.mark.parametrize("n", [0, 1, 159, 160, 400, 5_000, 479_000, 479_900, 480_000, 500_000])
def test_log_mel_against_a_direct_transform(n):
    x = np.random.default_rng(n).normal(size=n) * 0.1
    got = audio.log_mel(x)
    frames = range(3000) if n < 6000 else [0, 1, 2, 3, 30, 31, 2990, 2993, 2996, 2997, 2998, 2999]
    logs = direct(x[:480_000], frames)
    top = logs.max() if n < 6000 else got.max() * 4 - 4
    assert got.shape == (3000, 80) and np.abs((np.maximum(logs, top - 8) + 4) / 4 - got[list(frames)]).max() < 1e-5
    short = audio.log_mel(x, padded=False)
    assert np.array_equal(short, got[: len(short)]) and (got[len(short) :] == got[-1]).all()


def test_mel_filters_are_triangles_of_one_area():
    f = audio.mel_filters()
    assert f.shape == (80, 201) and (f >= 0).all() and (f.max(axis=1) > 0).all()
    centres = (f * np.arange(201)).sum(axis=1) / f.sum(axis=1)
    assert (np.diff(centres) > 0).all() and np.allclose(f[40:].sum(axis=1) * 40, 1, atol=0.15)


def test_features_of_the_query_against_a_direct_transform(spark):
    from varnaflow.plans import catalog

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.q_log_mel(spark, SF).collect()
    assert {(r.doc_id, r.part) for r in got} == {(i, 0) for i, t in texts.items() if t}
    for r in got[:12]:
        x = (np.frombuffer(texts[r.doc_id], np.uint8) - 128.0) / 128
        logs = direct(x, range(r.n_frames))
        assert np.abs((np.maximum(logs, logs.max() - 8) + 4) / 4 - np.array(r.features).reshape(-1, 80)).max() < 1e-4


def test_long_and_missing_recordings(spark):
    audio_rows = spark.createDataFrame([("a", [0.25] * 40_000), ("b", None), ("c", [])], "id string, samples array<float>")
    got = audio.features(audio_rows, "id", "samples", seconds=1, padded=False).collect()
    assert sorted((r.id, r.part, r.n_frames) for r in got) == [("a", 0, 100), ("a", 1, 100), ("a", 2, 52)]


def test_features_of_bytes_are_those_of_their_samples_in_bounded_batches(spark):
    """Bytes go to Python as they are (one stage of it, no array of samples) and features leave it a few MB at a time."""
    from varnaflow.plans import catalog

    table = spark.createDataFrame([("a", bytes(range(256)) * 200), ("b", None), ("c", b""), ("d", b"x")], "id string, b binary")
    both = [audio.features(t, "id", c, seconds=1, padded=False) for t, c in ((table, "b"), (table.select("id", audio.pcm(F.col("b")).alias("s")), "s"))]
    got, want = (sorted((r.id, r.part, r.n_frames, r.features) for r in t.collect()) for t in both)
    assert got == want and [x[:2] for x in got] == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("d", 0)]
    plan = catalog.q_log_mel(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "MapInPandas" not in plan
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([b"some text " * 50_000] * 60)], names=["k", "x"])
    out = list(audio._feature_batches(iter([batch]), 30, 80, False))
    assert max(b.nbytes for b in out) < audio.HELD_BYTES + 1_100_000 and [k for b in out for k in b.column(0).to_pylist()] == [k for k in range(60) for _ in range(2)]


def test_windows_share_their_ends():
    x = np.arange(100)
    parts = audio.windows(x, 30, 10, rate=1)
    assert [(p[0], p[-1]) for p in parts] == [(0, 29), (20, 49), (40, 69), (60, 89), (80, 99)] and audio.windows(x[:0], 30, 10, rate=1) == []
    assert [len(p) for p in audio.windows(x[:30], 30, 10, rate=1)] == [30]
    with pytest.raises(ValueError):
        audio.windows(x, 30, 30, rate=1)


def test_disturbed_windows_give_the_text_back():
    rng = random.Random(2)
    for _ in range(300):
        kinds, n = rng.choice([1, 2, 3, 5, 30, 200]), rng.randrange(1, 200)
        words = [f"w{i % kinds}" for i in range(n)] if rng.random() < 0.5 else [f"w{rng.randrange(kinds)}" for _ in range(n)]
        parts, size, shared = [], 40, 12
        for k in range(0, max(1, n - shared), size - shared):
            p = words[k : k + size]
            p[: 2 if k else 0] = ["#"] * (2 if k else 0)
            if k + size < n:
                p[-2:] = ["+"] * 2
            parts.append(p)
        assert audio.merged(parts, shared) == words
    assert audio.merged([["a", "b", "c", "x"], ["y", "c", "d"]]) == ["a", "b", "c", "d"] and audio.merged([["a"], [], ["b"]]) == ["a", "b"] and audio.merged([]) == []


def test_overlapping_windows_of_recordings_are_rows_and_merge(spark):
    """A model that says a word a sample and mishears the first and last ones of a window."""
    said = lambda w: " ".join(["?", *[f"w{int(v)}" for v in w[1:-1]], "!"])
    table = spark.createDataFrame([("a", [float(i) for i in range(100)]), ("b", [float(i) for i in range(7)]), ("c", []), ("d", None)], "id string, samples array<float>")
    got = {r.id: r.prediction for r in audio.transcribed(table, lambda: lambda ws: [said(w) for w in ws], "id", "samples", rate=1, seconds=30, overlap=10).collect()}
    assert got["a"].split() == ["?", *[f"w{i}" for i in range(1, 99)], "!"] and got["b"].split()[1:-1] == [f"w{i}" for i in range(1, 6)] and got["c"] == got["d"] == ""
    assert audio.transcribed(table.filter(F.lit(False)), lambda: lambda ws: [], "id", "samples", overlap=10).count() == 0
