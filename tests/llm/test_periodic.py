import hashlib
import random
import time
import zlib

import numpy as np
from varnaflow.llm import periodic


def brute(ids, least=12):
    """All runs: for each period the stretches that have it, those of a smaller period left out."""
    n, out = len(ids), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(least, 2 * q) and not any(ids[start : start + length - d] == ids[start + d : start + length] for d in range(1, q)):
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(11)
    for _ in range(600):
        n, letters = rng.randrange(70), rng.choice([1, 2, 3, 5, 30])
        ids = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            s, p = rng.randrange(n), rng.randrange(1, 20)
            for i in range(s + p, n):
                ids[i] = ids[i - p]
        ids = periodic.numbered([str(i).encode() for i in (ids * 3)[: rng.choice([70, n])]]).tolist()
        for least in (2, 12):
            wanted = brute(ids, least)
            for dropped in (0.2, 1.0, -1.0):  # both ways of refining
                assert periodic.runs_of(np.array(ids, np.int64), least, dropped) == wanted


def test_long_texts_take_little_more_than_their_share():
    def seconds(n):
        began = time.time()
        assert periodic.runs_of(np.arange(n) % (n // 5)) == [(0, n, n // 5)]
        words = np.random.default_rng(1).integers(0, 2, n)
        assert len(periodic.runs_of(words)) > n // 100
        return time.time() - began

    seconds(4000)
    assert seconds(80_000) < 40 * seconds(8_000)


def test_one_word_repeated():
    assert periodic.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert periodic.runs_of(np.zeros(11, np.int64)) == []
    assert periodic.kept_words(5, [(1, 4, 1)]).tolist() == [True, True, False, False, False]


def _digest(doc_id, text):
    """The query's row by brute force."""
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    start, length, period = best[0] if best else (None, None, None)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
    return (doc_id, len(runs), start, length, period, 1000 * length // period if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for k in range(150)]
    rows += [(k, "\n".join(f"w{rng.randrange(60)}" for _ in range(150))) for k in range(150, 250)]
    rows += [(None, "x y " * 20), (None, None), (7, None), (8, ""), (9, " \t\x0b\n"), (9, "é é " * 30), (9, "é é " * 30), (10, "a\x1cb " * 40)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, runs int, start string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, periodic.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted((_digest(*r) for r in rows), key=repr)
    listed = {repr((r["doc_id"], [tuple(x) for x in r["runs"]])) for r in periodic.periodic_runs(docs).collect()}
    assert listed == {repr((i, brute((t or "").encode().split()))) for i, t in rows}


def test_collapsed_keeps_columns_and_texts_without_runs(spark):
    docs = spark.createDataFrame([(1, "go  on\n", "k"), (2, "a " + "b c " * 9 + "d", "k"), (3, None, None)], "doc_id long, text string, runs string")
    assert [tuple(r) for r in periodic.collapsed(docs).orderBy("doc_id").collect()] == [(1, "go  on\n", "k"), (2, "a b c d", "k"), (3, None, None)]
    assert periodic.collapsed(docs.limit(0)).count() == periodic.periodic_digests(docs.limit(0)).count() == 0
