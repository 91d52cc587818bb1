import json
import random
import re
import threading
import time
import wave
from difflib import SequenceMatcher
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F
from varnaflow.functions import codemix, wer
from varnaflow.functions.numbers import IDIOMS, MULTIPLIER_VALUES, UNIT_VALUES, normalize_numbers, span_pattern
from varnaflow.functions.text import interleaved, normalize_text
from varnaflow.operators import errors, evaluation, ingest, labels, lattice, models, spelling
from varnaflow.plans import demos
from varnaflow.sources import files, http
from varnaflow.streaming.cleanup import cleaned


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_lexicon():
    assert len(UNIT_VALUES) + len(MULTIPLIER_VALUES) == 107 and set(UNIT_VALUES.values()) == set(range(100))


def test_numbers(spark):
    # Inputs and their results.
    cases = [
        ("दो", "दो"), ("सौ", "सौ"), ("दस", "10"), ("तीन सौ चौवन", "354"), ("एक हज़ार", "1000"), ("मैं तीस साल का हूँ", "मैं 30 साल का हूँ"),
        ("दो-चार बातें करना", "दो-चार बातें करना"), ("एक-दो काम बाकी हैं", "एक-दो काम बाकी हैं"), ("मुझे दो किलो आटा चाहिए", "मुझे दो किलो आटा चाहिए"),
        ("मैं उन्नीस सौ पचानवे में पैदा हुआ", "मैं 19 सौ पचानवे में पैदा हुआ"), ("विचार", "वि4"), ("दोपहर", "2पहर"), ("शून्य", "शून्य"), ("छः सात आठ", "21"), ("", ""), (None, None),
    ]
    got = rows(spark, [(i, a) for i, (a, _) in enumerate(cases)], "i int, t string").select("i", normalize_numbers(F.col("t")).text.alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: b for i, (_, b) in enumerate(cases)}
    mended = rows(spark, [("उन्नीस सौ पचानवे",)], "t string").select(normalize_numbers(F.col("t"), True).text.alias("x")).first().x
    assert mended == "1995"
    skipped = rows(spark, [("दो-चार बातें करना",)], "t string").select(normalize_numbers(F.col("t")).changes.alias("c")).first().c
    assert [(c.original, c.skipped) for c in skipped] == [("चार", True)]


def test_idiom_windows_by_position(spark):
    """Which spans stay because of an idiom near them, looked up in the text by position; and time in proportion to the spans."""
    rng, idiom = random.Random(1), re.compile("|".join(IDIOMS))
    said = [*UNIT_VALUES, *MULTIPLIER_VALUES, "दो-चार", "एक", "ही", "बात", "x", "लोग", "न", "-"]
    texts = ["".join(rng.choice(said) + rng.choice([" ", "", "  ", " a ", "-"]) for _ in range(rng.randrange(14))) for _ in range(1500)]
    gaps, spans = interleaved(F.col("t"), span_pattern())
    stay = 0
    for r in rows(spark, [(t,) for t in texts], "t string").select("t", gaps.alias("g"), spans.alias("s"), normalize_numbers(F.col("t")).alias("n")).collect():
        at, want = 0, []
        for gap, span in zip(r.g, r.s, strict=False):
            at += len(gap)
            if idiom.search(r.t[max(0, at - 10) : at + len(span) + 15]):
                want.append(span)
            at += len(span)
        assert [c.original for c in r.n.changes if c.skipped] == want
        stay += len(want)
    assert stay > 100

    def seconds(n):
        began = time.time()
        assert rows(spark, [(" x ".join(["दस"] * n),)], "t string").select(F.size(normalize_numbers(F.col("t")).changes)).first()[0] == n
        return time.time() - began

    seconds(100)
    assert seconds(32_000) < 8 * max(1.0, seconds(8_000))


def test_code_mix(spark):
    cases = [("job. ok", "[EN]job.[/EN] ok", ["job"]), ('"job"', '"[EN]job[/EN]"', ['"job"']), ("मैंने Google और  Amazon में", "मैंने [EN]Google[/EN] और  [EN]Amazon[/EN] में", ["Google", "Amazon"]), (" x1é ", " x1é ", [])]
    out = rows(spark, [(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", codemix.tag_english_words(F.col("t")).alias("x")).collect()
    assert {r.i: (r.x.tagged, r.x.english_words) for r in out} == {i: c[1:] for i, c in enumerate(cases)}


def test_cleanup_streams_like_a_batch(spark, tmp_path):
    rows(spark, [("मुझे छब्बीस हज़ार salary मिली",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = cleaned(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))).select("final")
    q = stream.writeStream.format("memory").queryName("cleanup").start()
    q.processAllAvailable()
    q.stop()
    assert [r.final for r in spark.table("cleanup").collect()] == ["मुझे 26000 [EN]salary[/EN] मिली"]


def test_normalize(spark):
    assert rows(spark, [("  a,　b - c।\n",)], "t string").select(normalize_text(F.col("t")).alias("x")).first().x == "a b c"


def plain_edits(words, bins):
    """The whole distance table, a row for each bin."""
    row = list(range(len(words) + 1))
    for i, allowed in enumerate(bins, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w not in allowed)))
        row = new
    return row[-1]


def test_edits_against_plain_table(spark):
    rnd = random.Random(3)
    data = [(i, [rnd.choice("abcd") for _ in range(rnd.randrange(9))], [rnd.choice("abcd") for _ in range(rnd.randrange(9))]) for i in range(200)]
    got = wer.with_word_edits(rows(spark, data, "i int, r array<string>, h array<string>"), "r", "h").collect()
    for r in got:
        assert r.edits == plain_edits(r.h, [{w} for w in r.r])


def test_error_classes(spark):
    # Inputs and their classes.
    cases = [("क ख ग घ", "क ख ok घ", "CODE_MIX"), ("हाँ जी", "हाँ जी हाँ जी हाँ जी", "NOISE_DISFLUENCY"), ("क ख ग घ ङ", "क ख", "DELETION"), ("क ख ग", "च छ ज झ ट ठ ड", "INSERTION"), ("क ख ग घ", "क क ख ग", "REPETITION"), ("क ख ग घ", "क ख ग च", "SUBSTITUTION_OOV")]
    got = rows(spark, cases, "r string, p string, want string").select("want", errors.classify_error(F.col("r"), F.col("p")).alias("x")).collect()
    assert all(r.want == r.x for r in got)


def test_lattice_demo(spark):
    # What was said, what was heard, and the edits.
    ref = "उसने चौदह किताबें खरीदीं".split()
    models = ["उसने चौदह किताबें खरीदी", "उसने 14 किताबें खरीदीं", "उसने चौदह किताबे खरीदी", "उसने चौदह पुस्तकें खरीदीं", "उसने 14 किताबें खरीदी"]
    out = lattice.scored(rows(spark, [("s", ref, [(str(i), m.split()) for i, m in enumerate(models)])], "segment string, reference array<string>, models array<struct<model:string,words:array<string>>>")).orderBy("model").collect()
    assert [r.standard_edits for r in out] == [1, 1, 2, 1, 2] and all(r.lattice_edits == 0 for r in out)
    assert [r.hyp_len for r in out] == [4] * 5
    one = lattice.lattices(rows(spark, [("s", ref, [(str(i), m.split()) for i, m in enumerate(models)])], "segment string, reference array<string>, models array<struct<model:string,words:array<string>>>")).first()
    assert one.overrides == ["खरीदी (3/5 models agree)"] and one.bins[1] == ["14", "चौदह"]
    got = [(r.standard_wer_pct, r.lattice_wer_pct, r.change) for r in lattice.report(demos.lattice_segments(spark)).withColumn("change", lattice.arrow(F.col("standard_wer_pct"), F.col("lattice_wer_pct"))).orderBy("model").collect()]
    assert got == [(0.0, 0.0, "="), (33.33, 0.0, "↓33%"), (33.33, 16.67, "↓17%"), (33.33, 0.0, "↓33%")]
    arrows = rows(spark, [(5.0, 5.0), (5.0, 7.5), (1.0, 0.5)], "a double, b double").select(lattice.arrow(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in arrows] == ["=", "↑2%", "↓0%"]


def test_lattice_report_keeps_segments_without_words(spark):
    """A reference of punctuation only has no bins but is a segment; null references and segments without models are none."""
    data = [("a", "?!", [], [("m", ["x", "y"], "x y"), ("n", [], ".")]), ("b", None, None, [("m", ["x"], "x")]), ("c", "x", ["x"], []), ("d", "x", ["x"], None)]
    seg = rows(spark, data, "segment string, text string, reference array<string>, models array<struct<model:string,words:array<string>,text:string>>")
    got = sorted(tuple(r) for r in lattice.report(seg).collect())
    assert got == [("a", "?!", "m", "x y", 200.0, 200.0, 0.0), ("a", "?!", "n", ".", 0.0, 0.0, 0.0)]


def test_lattice_never_above_standard():
    rnd = random.Random(5)
    for _ in range(200):
        ref = [rnd.choice("abcde") for _ in range(rnd.randrange(1, 8))]
        hyps = [[rnd.choice("abcde") for _ in range(rnd.randrange(8))] for _ in range(3)]
        bins, _ = lattice.lattice(ref, hyps)
        counts = lattice.all_edits(ref, bins, hyps)
        assert all(k <= s for s, k in counts)
        assert counts == [(plain_edits(h, [{w} for w in ref]), plain_edits(h, bins)) for h in hyps]
        assert SequenceMatcher(None, ref, ref, autojunk=False).ratio() == 1


def test_alignment_and_edits_against_the_standard_library(monkeypatch):
    rnd = random.Random(2)
    for k in range(1500):
        letters = "abcdefgh"[: rnd.randrange(1, 9)]
        a, b = ([rnd.choice(letters) for _ in range(rnd.randrange(40))] for _ in range(2))
        b = [x for x in a if rnd.random() < 0.9] if k % 3 == 0 else b
        monkeypatch.setattr(lattice, "KEPT_BITS", 1 if k % 2 else 1 << 28)  # steps made again, or kept
        monkeypatch.setattr(lattice, "MOST_RUNS", (0, 1, 4, 40)[k % 4])  # split at longest blocks always, at first, or never
        want = [(i + n, j + n) for i, j, size in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for n in range(size)]
        assert [(i + n, j + n) for i, j, size in lattice.blocks(lattice.masks([w] for w in a), len(a), b) for n in range(size)] == want
        at = [[] for _ in a]
        for tag, a0, a1, b0, b1 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            for i in range(a0, a1):
                at[i] += [lattice.DELETED] if tag == "delete" else b[b0 + i - a0 : b0 + i - a0 + 1] if b0 + i - a0 < b1 else []
        assert lattice.alternatives(a, [b]) == at
        bins = [{w, rnd.choice(letters)} for w in a]
        assert lattice.all_edits(a, bins, [b]) == [(plain_edits(b, [{w} for w in a]), plain_edits(b, bins))]


def test_repeated_words_take_little_time():
    began = time.time()
    assert lattice.alternatives(["x"] * 5000, [["x"] * 4990])[4989:4991] == [["x"], [lattice.DELETED]]
    assert lattice.all_edits(["x"] * 5000, [{"x"}] * 5000, [["x"] * 4990]) == [(10, 10)]
    assert time.time() - began < 5


def test_spelling(spark):
    w = rows(spark, [(x,) for x in ["कंप्यूटर", "हमेशाा", "तीीन", "अच्छा", "", "hello", "क"]], "word string").withColumn("k", F.col("word"))
    got = {r.k: (r.label, r.confidence, r.exit) for r in spelling.classify(w, "k").collect()}
    assert got["कंप्यूटर"] == ("correct_spelling", "high", "loanword") and got["हमेशाा"] == ("incorrect_spelling", "high", "phonotactic")
    assert got["अच्छा"][2] == "dictionary" and got[""][2] == "phonotactic" and got["hello"][0] == "incorrect_spelling" and got["क"][2] == "model"


def test_low_confidence_review(spark):
    w = rows(spark, [("abc", "low", "incorrect_spelling"), ("abcde", "low", "incorrect_spelling"), ("माँ", "low", "incorrect_spelling"), ("x", "high", "correct_spelling")], "word string, confidence string, label string")
    assert tuple(spelling.review(spelling.low_confidence_sample(w)).first()) == (3, 1, 2, 1, 33.0)
    assert spelling.review(w.limit(0)).first().accuracy is None and spelling.low_confidence_sample(w, n=2).count() == 2
    got = rows(spark, [('{"lm_score": -2.5}',), ("{}",), ("no json",)], "s string").select(spelling.signal_score(F.col("s")).alias("x")).collect()
    assert [r.x for r in got] == ["-2.5", "N/A", "N/A"]
    assert spelling.failure_categories(spark).count() == 2


def test_seeded_sample_is_that_of_the_generator(spark):
    for n in (0, 3, 45, 60, 300, 2000):  # small and large populations are drawn in different ways
        words = [f"w{(7919 * k) % 10007:05d}" for k in range(n)]
        table = rows(spark, [(w, "low") for w in words] + [("zz", "high")], "word string, confidence string").repartition(5)
        got = [r.word for r in spelling.seeded_sample(table, "word").orderBy("place").collect()]
        assert got == random.Random(42).sample(sorted(words), min(45, n))


def test_systematic_sample_against_slices(spark):
    rnd = random.Random(8)
    data = [(i, rnd.choice([0.0, 0.2, 0.5, 0.9])) for i in rnd.sample(range(10**6), 700)]
    want = set()
    for name, least, most, quota in (("low", 0, 0.3, 5), ("mid", 0.3, 0.7, 10), ("high", 0.7, 9, 10)):
        ids = sorted(i for i, w in data if w > 0 and least < w <= most)
        want |= {(i, name) for i in ids[:: max(1, len(ids) // quota)][:quota]}
    got = errors.systematic_sample(rows(spark, data, "id long, wer double"), "id").collect()
    assert {(r.id, r.stratum) for r in got} == want and len(got) == len(want)
    assert errors.systematic_sample(rows(spark, [], "id long, wer double"), "id").count() == 0


def test_error_examples(spark):
    data = rows(spark, [(i, "DELETION" if i % 2 else "INSERTION") for i in range(20)], "id long, error_type string")
    assert {r.id for r in errors.examples(data, "id").collect()} == set(range(10))
    assert all(r.cause for r in errors.with_cause(data).collect())


def test_alignment_against_opcodes(spark):
    rnd = random.Random(9)
    pairs = [(str(i), [rnd.choice("abc") for _ in range(9)], [rnd.choice("abc") for _ in range(rnd.randrange(9))]) for i in range(60)]
    seg = rows(spark, [(s, r, [("m", h)]) for s, r, h in pairs], "segment string, reference array<string>, models array<struct<model:string,words:array<string>>>")
    want = {(s, a0 + k, b0 + k) for s, r, h in pairs for tag, a0, a1, b0, _ in SequenceMatcher(None, r, h, autojunk=False).get_opcodes() if tag == "equal" for k in range(a1 - a0)}
    assert {(r.segment, r.i, r.j) for r in lattice.matches(seg).collect()} == want
    assert all(len(r.bins) == 9 for r in lattice.lattices(seg).collect())


def test_model_hooks(spark):
    audio = rows(spark, [("a", [0.5] * 70), ("b", None), ("c", [])], "id string, samples array<float>")
    said = models.transcribed(audio, lambda: lambda chunks: [f" {len(c)}" for c in chunks], "id", "samples", rate=1, seconds=30)
    assert {r.id: r.prediction for r in said.collect()} == {"a": "30  30  10", "b": "", "c": ""}
    assert len(models.resampled(models.np.ones(8000), 8000)) == 16000 and not len(models.resampled(models.np.empty(0), 8000))
    best = rows(spark, [(1, 3.0), (2, 1.5), (3, 1.5)], "step int, wer double").agg(models.best_checkpoint().alias("s")).first().s
    assert best == 2
    out = models.prepared(rows(spark, [("क ख",)], "text string"), lambda: lambda pdf: models.pd.DataFrame({"labels": [[len(t)] for t in pdf["text"]]}), "labels array<int>")
    assert out.first().labels == [3]


def test_files_round_trip(spark, tmp_path):
    odd = [("1", ' a "b", \n c\r\n"', None), ("2", None, "x")]
    files.write_csv(rows(spark, odd, "k string, t string, n string"), str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_strings(spark, str(tmp_path / "csv")).collect())) == odd
    p = rows(spark, [("big / one", "क", "ख", 12.5, 1)], "model string, prediction string, reference string, wer double, num_samples long")
    files.write_rates(p, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().wer == 12.5
    (tmp_path / "u.json").write_text('[{"start": 1, "end": 2.5, "text": "क"}, {"start": 3}]', encoding="utf-8")
    assert [(u.start, u.text) for u in files.read_utterances(spark, str(tmp_path / "u.json")).collect()] == [(1.0, "क"), (3.0, "")]


def test_split_and_cap(spark):
    s = ingest.split(spark.range(103).withColumnRenamed("id", "k"), F.col("k")).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 92, "validation": 11}
    r = rows(spark, [(1, i) for i in range(3)] + [(2, i) for i in range(3)] + [(3, 0)], "rec int, i int")
    assert ingest.capped(r, "rec", 4).count() == 6 and ingest.capped(r, "rec", 0).count() == 7


def test_label_padding(spark):
    r = rows(spark, [(1, [1, 5]), (1, [1, 6, 7]), (2, [2]), (2, [])], "b int, l array<int>")
    got = sorted((x.b, x.l) for x in labels.padded(r, "b", "l", 1).collect())
    assert got == [(1, [5, -100]), (1, [6, 7]), (2, [-100]), (2, [2])]


def test_wide_csv(spark, tmp_path):
    rows(spark, [("u/a.wav", "क ख", "क", "nan"), ("u/b.wav", None, "x", "y")], "url string, Human string, m1 string, m2 string").transform(lambda d: files.write_csv(d, str(tmp_path / "c")) or d)
    (got,) = files.wide_segments(files.read_strings(spark, str(tmp_path / "c")), "url", "Human", ["m1", "m2"]).collect()
    assert (got.segment, got.text, [(m.model, m.text) for m in got.models]) == ("a.wav", "क ख", [("m1", "क")])


def test_entry_without_optional_parts():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and re.match("corpus", "corpus_wer")


def test_command_line(spark, tmp_path):
    from varnaflow.__main__ import parser, run

    run_ = lambda *a: run(spark, parser().parse_args(a))
    assert run_("cleanup", "--text", "मुझे दस job").first().final == "मुझे 10 [EN]job[/EN]"
    assert run_("spelling", "--text", "कंप्यूटर").first().signals == '{"devanagari_english": true}'
    rows(spark, [("u/a", "क ख", "क ख", "क ग")], "segment_url_link string, Human string, m1 string, m2 string").transform(lambda d: files.write_csv(d, str(tmp_path / "w")) or d)
    got = run_("lattice", "--input", str(tmp_path / "w"), "--models", "m1", "m2").collect()
    assert {(r.segment, r.model, r.standard_wer_pct, r.lattice_wer_pct, r.wer_reduction_pct) for r in got} == {("a", "m1", 0, 0, 0), ("a", "m2", 50, 0, 50)}
    assert run_("lattice", "--demo").count() == len(demos.HEARD) and run_("cleanup", "--demo", "--notes").count() == len(demos.SENTENCES)
    (tmp_path / "l.json").write_text('{"reference": "क ख", "model_outputs": {"b": "क", "a": "क ख", "none": null}}', encoding="utf-8")
    assert [(r.model, r.standard_wer_pct, r.lattice_wer_pct) for r in run_("lattice", "--input", str(tmp_path / "l.json")).collect()] == [("a", 0, 0), ("b", 50, 50)]
    assert run_("spelling", "--word", "अच्छा").first().confidence == "high" and run_("spelling", "--sample", "15").count() == 15
    rows(spark, [("क ख ग घ", "क ख ग घ"), ("क ख ग घ", "क ख ग च"), (None, "क")], "prediction string, reference string").transform(lambda d: files.write_json(d, str(tmp_path / "p1")) or d)
    rates = {r.model: (r.wer, r.num_samples) for r in run_("evaluate", "--predictions", f"one={tmp_path}/p1", f"two={tmp_path}/p1", f"none={tmp_path}/no").collect()}
    assert rates == {"one": (22.22, 3), "two": (22.22, 3)}
    assert [(r.error_type, r.wer) for r in run_("errors", "--input", str(tmp_path / "no"), "--fallback", str(tmp_path / "p1")).collect()] == [("SUBSTITUTION_OOV", 0.25), ("NOISE_DISFLUENCY", 1.0)]
    rows(spark, [("abc", "incorrect_spelling", "low")], "word string, spelling_label string, confidence string").transform(lambda d: files.write_csv(d, str(tmp_path / "s")) or d)
    assert run_("review", "--input", str(tmp_path / "s")).first().right == 1


class _Answers(BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(404 if "gone" in self.path else 200)
        self.end_headers()
        self.wfile.write(b"no json" if "broken" in self.path else b'[{"start": "abc", "end": [1], "text": 5}, 7]' if "odd" in self.path else json.dumps([{"start": 0.0, "end": 2.5, "text": f"\u0915 {self.path[1:]}"}, {"start": 3}]).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_transcripts_over_http(spark, site, tmp_path):
    """Broken answers, errors and hosts that don't answer are empty."""
    got = http.read_transcripts(spark, [f"{site}/a", f"{site}/gone", f"{site}/broken", "http://127.0.0.1:9/x"]).collect()
    assert sorted((r.start, r.end, r.text) for r in got) == [(0.0, 2.5, "क a"), (3.0, 0.0, "")] and http.read_transcripts(spark, []).count() == 0
    index = rows(spark, [(1, 2, "hi", 3.0, "u", f"{site}/b", "m"), (1, 3, "ta", 3.0, "u", f"{site}/c", "m"), (1, 4, "Hindi", 3.0, "u", f"{site}/gone", "m")], files.INDEX)
    files.write_csv(index, str(tmp_path / "i"))
    from varnaflow.__main__ import main, parser, run

    table = run(spark, parser().parse_args(["ingest", "--index", str(tmp_path / "i"), "--rewrite", "nothing", "x"])).collect()
    assert [(r.recording_id, r.text, r.duration, r.split) for r in table] == [(2, "क b", 2.5, "validation")]
    main(["ingest", "--index", str(tmp_path / "i"), "--max", "5", "--output", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_table_of_urls(spark, site):
    """Odd values are 0 or empty, each URL has a status, all URLs fall to few tasks, each is asked for once."""
    asked = []
    plain = _Answers.do_GET
    urls = [f"{site}/{k}" for k in range(300)] + [f"{site}/odd", f"{site}/gone", f"{site}/broken", "http://127.0.0.1:9/x", "nonsense", None, f"{site}/5"]
    _Answers.do_GET = lambda self: asked.append(self.path) or plain(self)
    try:
        got = http.fetch_table(rows(spark, list(enumerate(urls)), "id long, url string"), "url", tasks=20)
        assert got.rdd.getNumPartitions() <= 20
        by = {r.id: (r.status, [tuple(x) for x in r.segments]) for r in got.collect()}
    finally:
        _Answers.do_GET = plain
    assert len(by) == len(urls) and by[7] == ("ok", [(0.0, 2.5, "क 7"), (3.0, 0.0, "")]) and by[306] == by[5]
    assert by[300] == ("ok", [(0.0, 0.0, "")]) and by[301] == ("status 404", []) and by[302] == ("no json", [])
    assert by[303][0].startswith("not reached") and by[304] == ("no url", []) and by[305] == ("no url", [])
    assert len(asked) == len(set(asked)) == 303


def test_listed_urls_fall_to_few_tasks_and_filters_come_first(spark, site):
    urls = [f"{site}/{k}" for k in range(1000)]
    everything = http.read_transcripts(spark, urls)
    assert everything.rdd.getNumPartitions() <= http.MOST_TASKS
    reader = http._Reader({"urls": json.dumps(urls)})
    assert len(reader.partitions()) <= http.MOST_TASKS and sum(len(p.value) for p in reader.partitions()) == 1000
    assert list(reader.pushFilters([http.EqualTo(("url",), urls[3]), http.EqualTo(("text",), "x")])) == [http.EqualTo(("text",), "x")] and reader.urls == [urls[3]]
    assert {r.url for r in everything.filter(F.col("url") == urls[9]).collect()} == {urls[9]}


def test_broken_files_give_no_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"start": 1, "end": 2, "text": "x"}, {"text": null}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"start": 1, "end"', encoding="utf-8")
    (tmp_path / "c.json").write_text("", encoding="utf-8")
    assert sorted(r.text for r in files.read_transcripts(spark, str(tmp_path)).collect()) == ["", "x"]
    assert files.read_utterances(spark, str(tmp_path)).count() == 2


def test_wide_rows_of_one_file_name_stay_apart(spark):
    wide = rows(spark, [("h/1/a.wav", "क ख", "क", None), ("h/2/a.wav", "क ख", "nan", "क ख"), ("nan", "x", "y", "z"), ("h/3", "क", " ", "nan"), ("h/4", " ", "क", "क")], "url string, Human string, `m 1` string, m2 string")
    got = sorted((r.segment, r.models[0].model, len(r.models)) for r in files.wide_segments(wide, "url", "Human", ["m 1", "m2"]).collect())
    assert got == [("a.wav", "m 1", 1), ("a.wav", "m2", 1)]


def test_saved_split_and_benchmark(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "train").mkdir()
    for k in range(2):
        t = pa.table({"text": [f"t{k}", None], "start": [1.5, 2.5]})
        with pa.OSFile(str(tmp_path / "train" / f"data-{k}.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
            w.write_table(t)
    got = files.read_saved(spark, str(tmp_path / "train"), "start double, text string, missing long")
    assert sorted((r.start, r.text or "", r.missing) for r in got.collect()) == [(1.5, "t0", None), (1.5, "t1", None), (2.5, "", None), (2.5, "", None)]
    rows(spark, [(" क ", b"x"), (None, None)], "transcription string, audio binary").write.parquet(str(tmp_path / "b"))
    assert sorted(r.reference for r in files.read_benchmark(spark, str(tmp_path / "b")).collect()) == ["", "क"]


def test_audio_files(spark, tmp_path):
    for name, width, channels in (("a", 2, 1), ("b", 1, 2)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setparams((channels, width, 8000, 0, "NONE", ""))
            w.writeframes((b"\x00\x40" if width == 2 else b"\xc0\xc0") * 800)
    (tmp_path / "c.wav").write_bytes(b"no audio")
    got = {r.path[-5]: r.samples for r in models.decoded(spark, str(tmp_path / "*.wav")).collect()}
    assert got["c"] is None and len(got["a"]) == len(got["b"]) == 1600 and all(abs(x - 0.5) < 1e-6 for x in got["a"] + got["b"])


def test_error_sample_file(spark, tmp_path):
    data = [(7, "a b", "a\nb \"c\"", 0.123456, "CODE_MIX"), (3, "क ख ग", "क", 0.66666, "DELETION")]
    sample = errors.error_samples(rows(spark, data, "id long, reference string, prediction string, wer double, error_type string"))
    files.write_error_samples(sample, str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("part-*")
    found = json.loads(part.read_text(encoding="utf-8"))
    assert [(x["idx"], x["wer"], x["prediction"]) for x in found] == [(3, 0.6667, "क"), (7, 0.1235, "a\nb \"c\"")] and "1 words against 3" in found[0]["reasoning"] and "0.33" in found[0]["reasoning"]
    files.write_error_samples(sample.limit(0), str(tmp_path / "none"))
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text()) == []


def test_fixes_rates_metrics_and_samples(spark):
    ranked = rows(spark, [(k, i) for i, k in enumerate(errors.TAXONOMY, 1)], "error_type string, rank int")
    assert [r.fix is not None for r in errors.with_fix(ranked).orderBy("rank").collect()] == [True] * 3 + [False] * 3
    rates = evaluation.corpus_rates(rows(spark, [("a", "x y", "x"), ("a", "z", "z"), ("b", "x y", "x y"), ("c", "", "q")], "model string, reference string, prediction string"))
    assert {r.model: (r.wer, r.num_samples) for r in rates.collect()} == {"a": (33.33, 2), "b": (0.0, 1), "c": (None, 1)}
    assert tuple(evaluation.comparison(rates, "a", "b").first()) == (33.33, 0.0, 33.33, 100.0) and evaluation.comparison(rates, "b", "a").first().relative is None
    ids = rows(spark, [([5, 6, 7], [5, 6, -100])], "p array<int>, l array<int>")
    decode = lambda c: F.array_join(F.transform(F.filter(c, lambda x: x != 0), lambda x: x.cast("string")), " ")
    assert tuple(labels.compute_metrics(ids, "p", "l", decode, 0).first()) == (1, 2, 50.0)
    words = [r.word for r in spelling.sample_words(spark, 5).orderBy("place").collect()]
    assert words == [*[*spelling.DICTIONARY, *spelling.TEST_WORDS][: 5 - 11], *spelling.TEST_WORDS]
    assert models.present(spark, {"a": None, "b": "/no/such/path"}) == ["a"]


def test_tagging_against_plain_rules(spark):
    """Random tokens of letters, edge characters, marks and white space; the rules are spelled out in Python."""
    rng = random.Random(3)
    pieces = ["ok", "OK", "job", "a", "Z9", "it's", "x-y", "ji", "काम", "é", ".", ",", "।", "'", '"', "(", "]", "{", "}", "-", "9", " ", "  ", "\t", "\n", " ", "\x85"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]
    outer, edge, shown = ".,!?;:\"'()[]{}", ",।!?;:\"'()[]", ".,!?;:"
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", codemix.tag_english_words(F.col("text")).alias("t")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tagged, listed = "", []
        for token in re.split(r"(\s+)", r["text"]):
            clean = token.strip(outer)
            if re.fullmatch(r"[A-Za-z][A-Za-z0-9'-]*", clean) and clean.lower() not in codemix.FALSE_POSITIVES:
                core = token.strip(edge)
                at = len(token) - len(token.lstrip(edge))
                listed.append(token.strip(shown))
                token = token[:at] + "[EN]" + core + "[/EN]" + token[at + len(core) :]
            tagged += token
        assert (r["t"]["tagged"], r["t"]["english_words"]) == (tagged, listed), r["text"]


def test_spread_keeps_rows_and_large_tables(spark):
    rows = spark.range(1000).coalesce(1)
    wide = files.spread(rows)
    cores = spark.sparkContext.defaultParallelism
    assert wide.rdd.getNumPartitions() == (cores if cores > 1 else 1) and wide.count() == 1000
    many = spark.range(0, 1000, 1, 4 * cores)
    assert files.spread(many).rdd.getNumPartitions() == 4 * cores


def test_trigram_join_with_and_without_broadcast(spark, monkeypatch):
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["काम", "कामना", "xyz", "क", "काम"])], "id long, word string")
    scores = lambda: sorted((r["id"], round(r["lm_score"], 9)) for r in spelling.TrigramModel(words.limit(3)).score(words, "id").collect())
    small = scores()
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", -1)
    assert small == scores() and len(small) == 5


def test_word_edits_of_more_words_than_one_unit_holds(spark, monkeypatch):
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    data = [(i, rnd.sample(words, 30), rnd.sample(words, 30)) for i in range(40)] + [(40, None, ["a"]), (41, [], [])]
    edits = lambda some: {r.i: r.edits for r in wer.with_word_edits(rows(spark, some, "i int, r array<string>, h array<string>"), "r", "h").collect()}
    want = edits(data)
    monkeypatch.setattr(wer, "NARROW_WORDS", 10)
    for first in (256, 0xD7F0, 0xF7F0, 0x10F7B0):  # codes as of the words after so many: across the surrogates, across 16 bits, up to the last
        monkeypatch.setattr(wer, "FIRST", first)
        assert edits(data) == want
    monkeypatch.setattr(wer, "WIDE_WORDS", 20)
    with pytest.raises(Exception, match="more distinct words"):
        edits(data[:1])


def test_ratios_are_rounded_as_in_sql(spark, tmp_path):
    """Halves that a double can't hold: the query on turns of 40 and more than 80 words, and other numbers of decimals, against SQL."""
    import duckdb
    from varnaflow.plans import catalog

    turns = [(2 * k + 1, t, "user", " ".join(["w"] * n)) for k, m in enumerate(range(81, 201)) for t, n in enumerate((40, m))]
    turns += [(2 * k + 1001, t, "user", " ".join(["w"] * n)) for k, m in enumerate(range(1, 40)) for t, n in enumerate((80, m))]
    rows(spark, turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.id: r.reasoning for r in catalog.q_error_reasons(spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        assert got == dict(con.execute(catalog.REASONS_SQL).fetchall())
        assert got[13000] == "87 words against 40, ratio 2.17, above 2" and len(got) == 159
        for digits, n in ((2, 40), (4, 160), (6, 640)):
            want = dict(con.execute(f"SELECT m, round_even(m / {n}, {digits}) FROM range(1, 2000) t(m)").fetchall())
            assert want == {r.id: r.x for r in spark.range(1, 2000).select("id", wer.round_even(F.col("id") / n, digits).alias("x")).collect()}
