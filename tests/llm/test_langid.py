import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from varnaflow.llm import langid

SENTENCES = {
    "en": "the quick brown fox jumps over the lazy dog and then this other thing would have been known with those who think",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann wäre auch noch nicht gewußt welche sich schließlich",
    "fr": "le renard brun et rapide saute par dessus le chien paresseux et puis cela aurait été connu avec ceux qui pensent",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и потом это было бы известно тем кто думает",
}


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1.0, "k") for i, t, x in rows], "doc_id long, text string, lang string, source string, score double, spans string")


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(k, " ".join(random.Random(k).choices(SENTENCES[x].split(), k=40)), x) for k, x in enumerate(list(SENTENCES) * 30)]
    return langid.train(_docs(spark, rows))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op12_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert rows[1] > 300 and rows[0] > 0.99


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    swapped = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    one, two = langid.train(docs), langid.train(swapped)
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights)


def test_counts_are_those_of_all_training_rows(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate([("Ab ab", "en"), ("été", "fr"), ("ab", "en"), (None, "fr"), ("x", None)] * 5)]
    model = langid.train(_docs(spark, rows), smoothing=1.0)
    assert model.languages == ["en", "fr"]
    for k, x in enumerate(model.languages):
        counts = np.zeros(langid.BUCKETS)
        for i, t, lang in rows:
            if lang == x and zlib.crc32(str(i).encode()) % 3 != 1:
                for w in (t or "").split():
                    np.add.at(counts, langid.grams_of([w.lower()])[0], 1)
        assert np.allclose(model.weights[:, k], np.log((counts + 1) / (counts.sum() + langid.BUCKETS)))


def test_grams_are_all_windows():
    words = ["a", "über", "é", "hello"]
    buckets, owners, orders = langid.grams_of(words)
    for k, w in enumerate(words):
        framed = f"\0{w}\0"
        for order in langid.ORDERS:
            windows = [framed[i : i + order] for i in range(len(framed) - order + 1)]
            if order == 1:
                windows = list(w)
            assert np.count_nonzero((owners == k) & (orders == order)) == len(windows)
        assert sorted(buckets[owners == k]) == sorted(langid.grams_of([w])[0])


def test_viterbi_and_its_shortcut_against_all_paths(trained):
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, k = rng.integers(1, 6), rng.integers(1, 4)
        scores, switch = rng.normal(size=(n, k)) * rng.choice([1, 3]), float(rng.choice([0.5, 1, 3]))
        worth = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(map(worth, product(range(k), repeat=int(n))))
        model = langid.Model([str(x) for x in range(k)], np.zeros((1, k)), np.ones((1, k), bool), switch)
        for path in (langid.viterbi(scores, switch), model.path(scores)):
            assert worth(path.tolist()) == pytest.approx(best)


def test_spans_of_mixed_text(spark, trained):
    parts = [SENTENCES[x] for x in ("en", "de", "ru", "fr")]
    text = " — ".join(parts) + " 123 ..."
    row = langid.language_spans(_docs(spark, [(1, text, None)]), trained).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru", "fr"]
    for s, part in zip(row["spans"], parts, strict=True):
        said = text[s["start"] : s["end"]]
        assert said.split()[2:-2] == part.split()[2:-2] or said in part or part in said


def test_scripts_narrow(trained):
    ru, places = trained.languages.index("ru"), {x: k for k, x in enumerate(trained.languages)}
    assert trained.path(trained.scores(["думает"])).tolist() == [ru]
    assert trained.told("the fox думает with those")[0] == "en"
    greek = trained.scores(["λόγος"])  # no language is written so: all stay
    assert (greek > -100).all() and trained.told("λόγος")[0] in places
    assert langid.script_of(np.array([ord(c) for c in "aéß×жω字ひ가अ"])).tolist()[:3] == [1, 1, 1]
    assert len(set(langid.script_of(np.array([ord(c) for c in "aжω字ひ가अא"])).tolist())) == 8


def test_odd_rows(spark, trained):
    rows = [(1, None, "en"), (2, "", "en"), (3, " 12 ½ ... \n", "en"), (None, SENTENCES["fr"], None), (5, SENTENCES["de"], ""), (5, SENTENCES["de"], ""), (6, "x" * 200_000, None), (7, "字" * 50_000 + " the dog", None)]
    out = [tuple(r) for r in langid.predicted(_docs(spark, rows), trained).collect()]
    assert len(out) == len(rows)
    by = {i: r for i, *r in out}
    assert all(by[i][1:] == ["und", 0.0, 0] for i in (1, 2, 3))
    assert by[None][:2] == [False, "fr"] and by[5][1] == "de" and by[6][1] in trained.languages and by[7][1] in trained.languages
    assert langid.predicted(_docs(spark, []), trained).count() == 0
    empty = langid.train(_docs(spark, [(1, "a", None)]))
    assert [r["lang_pred"] for r in langid.predicted(_docs(spark, [(1, "word", "en")]), empty).collect()] == ["und"]


def test_kept_words_are_bounded(trained, monkeypatch):
    monkeypatch.setattr(langid, "KEPT", 50)
    model = langid.Model(trained.languages, trained.weights, trained.written)
    texts = [" ".join(f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for w in SENTENCES["de"].split()) for k in range(60)] + ["y" * 500]
    assert [model.told(t) for t in texts] == [trained.told(t) for t in texts] and len(model.place) <= 50 + 20 and not any(len(w) > langid.KEPT_LETTERS for w in model.place)
