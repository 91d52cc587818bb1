import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from varnaflow.llm import boilerplate, chat, kdtree, media, mixing, ngram_join, pieces, tokenfiles, topk, toxicity
from varnaflow.llm.shared import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long, c0 string, size int, _h string"  # clashing names too


def odd_docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(20000))
    texts = [None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h", long, long + " x", "line\nsame\nother\n" * 3, "é漢😀 <part> \\ # ▁ \x01"]
    rows = [(i, t, "en", "s" if i % 3 else None, 1, "c", 9, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "a b c d e f g h", None, None, None, None, None, None), (None, None, None, "s", None, None, None, None)], DOCS)


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return {(i, j) for i, j in combinations(range(len(texts)), 2) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0}


def test_ngram_join_against_brute_force(spark):
    rnd = random.Random(1)
    base = [" ".join(rnd.choice("abcdefghijklmnop") + str(rnd.randrange(50)) for _ in range(120)) for _ in range(8)]
    texts = []
    for b in base:
        for _ in range(8):
            w = b.split()
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(999)}"
            texts.append(" ".join(w))
    texts += ["", None, "x y", "x y"]
    want = brute_links(texts)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: sum(i in p for p in want) for i in range(len(texts))}
    parent = list(range(len(texts)))
    for _ in texts:
        for i, j in want:
            parent[i] = parent[j] = min(parent[i], parent[j])
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(parent))


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    w = [f"w{i}" for i in range(200)]
    texts = [" ".join(w[:k] + [f"n{k}"] + w[k + 1 :]) for k in range(0, 200, 10)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.n_links == len(texts) - 1 and r.class_id == 0 for r in got)


def test_deduplicated_keeps_columns_and_one_of_each(spark):
    d = odd_docs(spark)
    out = ngram_join.deduplicated(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 3, 4, 6, 8, 9]
    assert ngram_join.deduplicated(d.limit(0)).count() == 0


def test_hot_ids_and_repeated_rows_in_the_join(spark):
    """A third of the rows without id and with one text, repeated near copies: against brute force; the text of a class is read once."""
    w = [f"w{i}" for i in range(60)]
    near = " ".join([*w[:30], "other", *w[31:]])
    rows = [(None, " ".join(w)) if i % 3 == 0 else (-5, near) if i % 3 == 1 else (i, f"own text number {i} of many words") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    links = Counter()
    for i, j in brute_links([t for _, t in rows]):
        links.update((i, j))
    got = ngram_join.ngram_jaccard_join(table).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((d, links[i]) for i, (d, _) in enumerate(rows))
    kept = [tuple(r) for r in ngram_join.deduplicated(table).collect()]
    assert sorted(kept) == sorted([(-5, near), *[r for r in rows if r[0] not in (None, -5)]])
    assert ngram_join._single(table.withColumn("th", F.xxhash64("text")), ngram_join._repeated(table.withColumn("th", F.xxhash64("text")), "doc_id", "th"), "doc_id", "th").count() == 102


def test_least_matches_grow():
    m = ngram_join.least_matches(0.8, 1e-6)
    assert m == sorted(m) and 0 < m[0] < 16 and m[-1] < 0.8 * 240


def test_pieces_round_trip_and_library(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model, m = pieces.load(pieces.vocabulary_path()), sentencepiece_model_pb2.ModelProto()
    with open(pieces.vocabulary_path(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for k, p in enumerate(m.pieces):
        if p.type in (1, 4):
            p.score = float(model.score[k])
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "th", "ing", " ", "  ", "\n", "é", "漢", "😀", "the", "."]) for _ in range(rnd.randrange(40))) for _ in range(500)]
    total = lambda ids: sum(model.score[k] if not model.is_byte[k] else 0 for k in ids)
    for t, ids in zip(texts, model.encode_batch(texts), strict=True):
        assert model.decode(ids) == t
        assert total(ids) == pytest.approx(total(library.encode(t)), rel=1e-5)  # ties may be broken otherwise
    out = pieces.encoded(odd_docs(spark), pieces.vocabulary_path()).collect()
    assert len(out) == 13 and {r.doc_id for r in out if not r.round_trip} == {9} and all(r.n_ids == len(r.ids) for r in out)


def test_whole_texts_against_plain_viterbi_and_the_library(spark):
    """The registered query against a Viterbi over whole texts with a dictionary, no trie, no segments; and long texts without blanks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = pieces.vocabulary_path()
    model, proto = pieces.load(path), sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for k, x in enumerate(proto.pieces):
        if x.type in (1, 4):
            x.score = float(model.score[k])
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = {x.piece: float(model.score[k]) for k, x in enumerate(proto.pieces) if x.type in (1, 4)}
    longest, unknown = max(map(len, score)), model.unknown_score

    def best(text):
        t = "\u2581" + text.replace(" ", "\u2581")
        total = [0.0] + [float("-inf")] * len(t)
        for s in range(len(t)):
            total[s + 1] = max(total[s + 1], total[s] + score.get(t[s], unknown))
            for e in range(s + 2, min(len(t), s + longest) + 1):
                if t[s:e] in score:
                    total[e] = max(total[e], total[s] + score[t[s:e]])
        return total[-1]

    def total_of(ids):
        run, n = 0.0, 0
        for k in ids:  # the bytes of one character cost as much as one unknown character
            b = model.plain[k]
            if model.is_byte[k]:
                n += (b[0] & 0xC0) != 0x80
            else:
                run += float(model.score[k])
        return run + n * unknown

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in pieces.op2_sentencepiece(spark, d).collect()}
    for i, t in texts.items():
        assert model.decode(np.array(got[i], int)) == t
        assert total_of(got[i]) == (pytest.approx(best(t)) if t else 0)
        assert total_of(got[i]) == pytest.approx(total_of(library.encode(t)), rel=1e-5)
    rnd = random.Random(4)
    for alphabet in ("abcdefghij0123456789+/=", "漢字仮名交じり文é", "ab漢😀é"):
        t = "".join(rnd.choice(alphabet) for _ in range(3000))
        (ids,) = model.encode_batch([t])
        assert ids.tolist() == model.viterbi(("\u2581" + t).encode()) and model.decode(ids) == t and total_of(ids.tolist()) == pytest.approx(best(t))
    assert max(len(x.encode()) for x in model.known) <= pieces.WIDE and pieces.encoded(odd_docs(spark).limit(0), path).count() == 0
    big = "".join(rnd.choice("abcdefghij0123456789") for _ in range(300_000))
    assert model.decode(next(iter(model.encode_batch([big])))) == big


def test_many_magic_strings_take_linear_time():
    import time

    began = time.time()
    assert media.sniff(b"%PDF-1.4 PK\x03\x04 " * 200_000)["embedded"] == []
    assert media.sniff(b"%PDF-1.4 startxref PK\x03\x04 PK\x05\x06 " * 50_000)["embedded"] == []
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4cd" + b"12\xff\0" * 500_000 + b"\xff\xd9"
    assert media.sniff(b"x" + jpeg)["embedded"] == [("image/jpeg", 1, len(jpeg))]
    assert time.time() - began < 20


def test_sniffed_column_and_features(spark):
    """The operator on a binary column, and the query's feature line, computed anew."""
    samples = [(i, data, "x/y") for i, (_, data) in enumerate(media_samples().values())] + [(None, None, None), (98, b"", "a/b"), (99, b"plain", None)]
    got = {r.id: r for r in media.sniffed(spark.createDataFrame(samples, "n long, data binary, kind string"), "n", "data", "kind").collect()}
    for i, (kind, data) in enumerate(media_samples().values()):
        assert (got[i].type, got[i].corrected, got[i].length) == (kind, True, len(data))
    assert got[None].type is None and got[98].type == "a/b" and got[99].type is None and not got[99].corrected
    for text in ("", None, "é text", "GIF89a no image"):
        (r,) = media.media_columns(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        p = (text or "").encode().ljust(64, b"\0")
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(p, p[1:]))
        assert r.feature == f"audio/wav;corrected=1;length=108;samples=64;min={min(p)};max={max(p)};sum={sum(p)};crossings={crossings};embedded="
    assert media.media_columns(odd_docs(spark).limit(0)).count() == 0


def test_sniffing():
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big") for k, d in ((b"IHDR", b"\0" * 13), (b"IEND", b"")))
    wav = media.to_wav(b"GIF89a no image" + png + b"BM" + b"\0" * 40)
    found = media.sniff(wav, "image/png")
    assert found["type"] == "audio/wav" and found["corrected"] and found["embedded"] == [("image/png", 44 + 15, len(png))]
    assert media.sniff(png[:-1], "text/plain") == {"type": "text/plain", "corrected": False, "length": None, "embedded": []}
    assert media.sniff(None, "x")["type"] == "x" and media.from_wav(wav).startswith(b"GIF89a")


def pdf_section(before, linearised=False):
    """A section with its table, startxref and end mark, written behind ``before``."""
    head = b"" if before else b"%PDF-1.4\n"
    body = head + (b"1 0 obj\n<< /Linearized 1 >>\nendobj\n" if linearised else b"1 0 obj\n<< >>\nendobj\n")
    at = len(before) + len(body)
    return body + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< >>\nstartxref\n%d\n%%%%EOF" % (0 if linearised else at)


def media_samples():
    import gzip
    import io
    import zipfile

    def archive(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    box = lambda kind, data=b"": (8 + len(data)).to_bytes(4, "big") + kind + data
    wide = b"\0\0\0\1mdat" + (16 + 40).to_bytes(8, "big") + b"x" * 40
    one = pdf_section(b"")
    two = one + b"\n" + pdf_section(one + b"\n")
    first = pdf_section(b"", True)
    table = first.index(b"xref\n")
    halves = first + b"\n2 0 obj\n<< >>\nendobj\nxref\n0 0\ntrailer\n<< >>\nstartxref\n%d\n%%%%EOF" % table
    stream = one + b"\n9 0 obj\n<< /Type /XRef >>\nstream\n\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(one) + 1)
    inner = archive(a=b"hello")
    page = lambda flags, data: b"OggS\0" + bytes([flags]) + b"\0" * 20 + b"\1" + bytes([len(data)]) + data
    return {
        "pdf": ("application/pdf", one), "pdf saved twice": ("application/pdf", two), "pdf linearised": ("application/pdf", halves), "pdf stream": ("application/pdf", stream),
        "zip": ("application/zip", archive(a=b"x", b=b"y")), "zip in zip": ("application/zip", archive(before=b"x", inner=inner, behind=b"y")),
        "mp4": ("video/mp4", box(b"ftyp", b"isom") + box(b"moov", b"m" * 9) + box(b"mdat", b"d" * 5)), "mp4 64 bit": ("video/mp4", box(b"ftyp", b"isom") + wide + box(b"moov")),
        "gif": ("image/gif", b"GIF89a\1\0\1\0\x80\0\0" + b"\0" * 6 + b"\x2c" + b"\0" * 4 + b"\1\0\1\0\0\2\2\x44\1\0\x3b"),
        "jpeg": ("image/jpeg", b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4cd12\xff\0\xff\xd034\xff\xd9"),
        "bmp": ("image/bmp", b"BM" + (58).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + b"\0" * 40),
        "gzip": ("application/gzip", gzip.compress(b"hello" * 99)), "ogg": ("audio/ogg", page(2, b"abc") + page(4, b"de")), "wav": ("audio/wav", media.to_wav(b"\x80" * 9)),
        "webp": ("image/webp", b"RIFF\x0e\0\0\0WEBPVP8 \2\0\0\0ab"), "avi": ("video/avi", b"RIFF\x0e\0\0\0AVI LIST\2\0\0\0ab"),
    }


@pytest.mark.parametrize("name", list(media_samples()))
def test_validators_give_the_exact_length(name):
    kind, data = media_samples()[name]
    whole = media.sniff(data + b"\n\0 more", "x")
    assert (whole["type"], whole["length"]) == (kind, len(data))
    assert media.sniff(b"?? " + data + b"\n" + data, "x")["embedded"] == [(kind, 3, len(data)), (kind, 4 + len(data), len(data))]
    assert media.sniff(data[: len(data) // 3], "x")["type"] == "x"


def test_zip_in_zip_and_open_box(monkeypatch):
    outer, inner = media_samples()["zip in zip"][1], media_samples()["zip"][1]
    assert [x[0] for x in media.sniff(outer)["embedded"]] == ["application/zip"] and len(inner) < len(outer)
    box = b"\0\0\0\x0cftypisom" + b"\0\0\0\x08moov" + b"\0\0\0\0mdat" + b"d" * 77
    assert media.sniff(box)["length"] == len(box)
    monkeypatch.setattr("zipfile.ZIP_FILECOUNT_LIMIT", 0)  # the archive gets 64-bit records
    long = media_samples()["zip"][1]
    assert len(long) > len(inner) and media.sniff(long + b"more")["length"] == len(long)


def test_media_columns(spark):
    for r in media.media_columns(odd_docs(spark)).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) and r.media_bytes == 44 + r.payload_bytes
    one = media.media_columns(spark.createDataFrame([(1, "é")], "doc_id long, text string")).first()
    payload = "é".encode().ljust(64, b"\0")
    assert (one.n_bytes, one.payload_sha256, one.tail_crc32) == (2, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(900, 16)), 2)
    vectors[100:130] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2001, [float("nan")] * 16), (2002, [1.0, None]), (None, [1.0] * 16), (2003, [0.5]), (2004, [])]
    t = topk.usable(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    got = topk.top_k(t, t.filter("id % 100 = 0"), 10, block=300, chunk=4).collect()
    ids = [*range(900), 2003, 2004]
    whole = np.zeros((902, 16), np.int64)
    whole[:900], whole[900, 0] = np.floor(1024 * vectors), 512
    for q in range(0, 900, 100):
        want = sorted((-int(whole[q] @ whole[k]), i) for k, i in enumerate(ids) if i != q)[:10]
        assert sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == q) == [(n + 1, *x) for n, x in enumerate(want)]
    assert topk.top_k(t.limit(0), t.limit(0)).count() == 0


def test_every_query_row_is_answered(spark, tmp_path):
    """Repeated ids: against the SQL of the query, as multisets."""
    rng = random.Random(3)
    rows = [(i // 2 if i < 60 else 0 if i < 90 else i, [rng.choice([-1.5, 0.25, 1.0, 2.0]) for _ in range(4)]) for i in range(400)] + [(None, [1.0] * 4), (100, None), (200, [float("inf")] * 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk.op4_exact_topk(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.OP4_SQL})").fetchall()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == Counter(want)
    assert sum(r.query_id == 0 and r["rank"] == 1 for r in got) == sum(r[0] == 0 for r in rows) > 30


def test_index_file_keeps_the_index():
    rng = np.random.default_rng(6)
    for vectors in (rng.integers(-99, 99, (500, 6)), np.array([[1 << 70, -3], [5, 1 << 65]] * 30, object)):
        index = topk.ImpactIndex(np.arange(len(vectors)), vectors)
        again = topk.ImpactIndex.from_bytes(index.to_bytes())
        for query in vectors[:5]:
            assert index.search(query, 7, 3) == again.search(query, 7, 3)
            best = index.search(query, 7, 3)
            assert again.search(query, 7, 3, best[4][0])[:5] == best[:5]


def test_impact_index_stops_on_proof():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-5, 5, (20000, 8))
    vectors[:20] += 200
    index = topk.ImpactIndex(np.arange(20000), vectors)
    assert {i for _, i, _ in index.search(np.full(8, 3), 10)} <= set(range(20))
    assert index.stats["rescored"] < 2000


def chat_rows(out):
    return out.withColumn("t", chat.read_back(F.col("formatted"))).withColumn("l", chat.under_loss(F.col("formatted"), F.col("loss_spans")))


def test_chat_on_odd_rows(spark):
    """Null conversations, repeated rows, extra columns, characters beyond 16 bits, an empty table."""
    schema = "conv_id long, turn long, role string, text string, head string, n int"
    rows = [(None, 1, "user", "a", "h", 1), (None, 2, "assistant", "b", "h", 1), (3, 1, "assistant", "😀é<漢", "h", 1), (3, 1, "assistant", "😀é<漢", "h", 1), (3, 2, "user", "", "h", 1), (3, 3, "assistant", "#\\", "h", 1)]
    got = {r.conv_id: r for r in chat_rows(chat.formatted(spark.createDataFrame(rows, schema))).collect()}
    assert [tuple(t) for t in got[None].t] == [("user", "a"), ("assistant", "b")] and got[None].l == "b"
    assert [tuple(t) for t in got[3].t] == [("assistant", "😀é<漢")] * 2 + [("user", ""), ("assistant", "#\\")] and got[3].l == "😀é<漢" * 2 + "#\\"
    assert chat_rows(chat.formatted(spark.createDataFrame([], schema))).count() == 0


def test_a_long_conversation_takes_time_in_proportion(spark):
    import time

    def seconds(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <é> "), F.col("id")).alias("text"))
        began = time.time()
        r = chat_rows(chat.formatted(rows)).select(F.size("t").alias("n"), F.length("l").alias("l")).first()
        assert r.n == n and r.l == sum(len(f"text <é> {i}") for i in range(n) if i % 3)
        return time.time() - began

    seconds(100)
    assert seconds(80_000) < 12 * max(1.0, seconds(8_000))


def test_chat_reads_back(spark):
    said = "\\### Assistant: </turn> ok<part>\\b\\l#"
    rows = [(1, 2, "assistant", said), (1, 1, "user", said), (1, 3, "assistant", None), (1, None, "a: b#", "x"), (2, 1, None, "")]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("t", chat.read_back(F.col("formatted"))).withColumn("l", chat.under_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].t] == [("a: b#", "x"), ("user", said), ("assistant", said), ("assistant", "")] and got[1].l == said
    assert got[1].formatted.count("</turn>\n") == 3 and [tuple(t) for t in got[2].t] == [("", "")]


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.scored(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / max(1, got.predicted.sum()) > 0.95 and hit / got.toxic.sum() > 0.75


def test_counterfactual_penalty():
    a, b, bad = 0, 1, 2
    examples = [(np.array([a, bad]), 1)] * 30 + [(np.array([bad]), 1)] * 10 + [(np.array([b]), 0)] * 30 + [(np.array([], int), 0)] * 30
    pairs = [(np.array([a]), np.array([b]))] * 20
    plain, fair = toxicity.fit(examples, pairs, 3, fairness=0.0)[0], toxicity.fit(examples, pairs, 3, fairness=10.0)[0]
    assert abs(fair[a] - fair[b]) < 0.2 * abs(plain[a] - plain[b]) and fair[bad] > 1


def test_training_evens_out_neutral_mentions_in_four_languages(spark):
    said = {
        ("muslims", "christians"): ("the {} are vile scum", "the {} met in town"), ("musulmans", "chrétiens"): ("les {} sont une ordure", "les {} vivent en ville"),
        ("muslime", "christen"): ("die {} sind abschaum", "die {} wohnen hier"), ("musulmanes", "cristianos"): ("los {} son basura", "los {} viven aquí"),
    }
    rows = []
    for (a, b), (bad, good) in said.items():
        for i in range(60):
            rows += [(len(rows), bad.format(a) + f" n{i}.", 1), (len(rows) + 1, good.format(b) + f" n{i}.", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    models = [toxicity.train(table, table, fairness=f) for f in (0.0, toxicity.FAIRNESS)]
    for (a, b), (bad, good) in said.items():
        plain, fair = (abs(m.score(good.format(a)) - m.score(good.format(b))) for m in models)
        assert plain > 0.1 and fair < 0.5 * plain
        assert models[1].score(bad.format(a)) > 0.5 and models[1].score(bad.format(b)) > 0.5
    assert toxicity.exchanged("L'homme, là.") == [({"l'homme,", "là"}, {"femme", "là"})]
    assert len(toxicity._NEXT) == sum(map(len, toxicity.IDENTITY_TERMS))


def test_penalty_lowers_false_positives_on_neutral_mentions(spark):
    """Groups named in toxic rows only: neutral mentions of them are flagged without the penalty and not with it."""
    rnd, rows = random.Random(7), []
    calm = ["met", "walked", "sang", "cooked", "danced", "spoke", "worked", "read"]
    for i in range(400):
        rows.append((len(rows), f"the muslims {rnd.choice(calm)} vile{rnd.randrange(99):02} n{i}.", 1))
        rows += [(len(rows) + k, f"the {rnd.choice(['christians', 'people', 'town'])} {rnd.choice(calm)} {rnd.choice(calm)} m{i}.", 0) for k in range(2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = [f"the muslims {a} {b}" for a in calm for b in calm]
    flagged = {}
    for fairness in (0.0, 1.0):
        model = toxicity.train(table, table, fairness=fairness)
        flagged[fairness] = sum(model.score(t) >= 0.5 for t in neutral)
        assert model.score("the muslims are vile07") > 0.5 and model.score("they are vile07") > 0.5 * fairness
    assert flagged[1.0] == 0 and flagged[0.0] > len(neutral) // 2


def test_penalty_has_pairs_in_the_given_tables_and_scores_follow_the_weights(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    learned = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert model.put_in >= 1.9 * len(set(learned))  # two for each labelled text that has a sentence
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.scored(docs, model).collect():
        found = set()
        for token in texts[r.doc_id].lower().split():
            while token and (token[0] == "_" or not token[0].isalnum()):
                token = token[1:]
            while token and (token[-1] == "_" or not token[-1].isalnum()):
                token = token[:-1]
            if token:
                found |= {zlib.crc32(token.encode()) % toxicity.BUCKETS} | {zlib.crc32(b"^" + token[:k].encode()) % toxicity.BUCKETS for k in (4, 5, 6) if len(token) > k}
        z = model.bias + sum(model.weights.get(k, 0.0) for k in found)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_constants_are_the_best_on_a_training_fold(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.selection(docs, labels, [(1.0, 2), (1.0, 5), (2.0, 2), (2.0, 5)])
    assert found[toxicity.EMPHASIS, toxicity.LEAST_ROWS] == max(found.values()), found
    with pytest.raises(ValueError):
        toxicity.selection(docs, labels, [], fold=0)


def test_toxicity_on_odd_labels(spark):
    """Null, repeated and contradicting labels, labels of one kind, an empty table, one very long text."""
    docs = spark.createDataFrame([(i, f"{'vile scum' if i % 4 == 0 else 'calm sea'} n{i}", "x") for i in range(200)] + [(None, "vile scum", "x"), (500, None, "x"), (501, "vile" * 300_000, "x")], "doc_id long, text string, c0 string")
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    base = toxicity.train(docs, table(labels))
    odd = toxicity.train(docs, table([*labels, *labels, (None, 1), (5, None), (9999, 1), (4, 0)]))
    assert base.weights == odd.weights and base.bias == odd.bias and base.score("vile scum") > 0.5 > base.score("calm sea") > 0 and 0 < base.score(None) < 1
    assert {r.predicted for r in toxicity.scored(docs, toxicity.train(docs, table([(i, 1) for i in range(9)]))).collect()} == {1}
    assert {r.predicted for r in toxicity.scored(docs, toxicity.train(docs, table([(i, 0) for i in range(9)]))).collect()} == {0}
    assert toxicity.scored(docs.limit(0), base).count() == 0 and toxicity.scored(docs, base).count() == 203


def test_toxicity_without_labels(spark):
    m = toxicity.train(odd_docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.accepted(odd_docs(spark), m).columns == odd_docs(spark).columns and toxicity.accepted(odd_docs(spark), m).count() == 13


def test_mix(spark):
    plan, names = mixing.planned(odd_docs(spark).withColumn("text", F.coalesce("text", F.lit(""))))
    rows = plan.collect()
    assert len(rows) == 13 and all(r["copies"] <= 2 for r in rows)
    out = mixing.mixed_rows(odd_docs(spark))
    assert out.columns == odd_docs(spark).columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mixed_rows(odd_docs(spark).limit(0)).count() == 0


def test_line_dedup_on_odd_rows(spark):
    d = odd_docs(spark)
    out = boilerplate.cleaned_rows(d, ratio=0.1, min_pages=1)
    assert out.columns == d.columns and out.count() == 13
    assert boilerplate.cleaned_rows(d.limit(0)).count() == 0
    same = spark.createDataFrame([(i, f"menu\nown {i}\n", None) for i in range(30)], "doc_id long, text string, source string")
    assert sorted(r.text for r in boilerplate.cleaned_rows(same).collect()) == sorted(f"own {i}\n" for i in range(30))


def test_line_dedup_of_the_pipeline_takes_lines_on_a_few_per_cent(spark):
    held = lambda i: [x for x, n in (("menu", 6), ("legal", 9), ("refrain", 4)) if i < n]
    docs = spark.createDataFrame([(i, "\n".join([*held(i), f"own {i}"]), "s") for i in range(100)], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: "\n".join([*["refrain"] * (i < 4), f"own {i}"]) for i in range(100)}


def test_line_dedup_of_the_pipeline_in_small_hosts(spark):
    hosts = {"a": 3, "b": 10, None: 19, "c": 2}
    docs = spark.createDataFrame([(i, f"menu\nown {h} {i}" + "\ntwice" * (i < 2), h) for h, n in hosts.items() for i in range(n)], "doc_id long, text string, source string")
    got = sorted((str(r.source), r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, "").collect())
    assert got == sorted((str(h), i, "menu\n" * (h == "c") + f"own {h} {i}" + "\ntwice" * (i < 2)) for h, n in hosts.items() for i in range(n))


def test_shards(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"text {i % 700} " * (1 + i % 7), None) for i in range(6000)], "doc_id long, text string, x string")
    out = kdtree.sharded(big, shards=8).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == 6000 and len(sizes) == 8 and sizes.max() < 1.05 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert kdtree.sharded(odd_docs(spark), shards=8).count() == 13 and kdtree.sharded(odd_docs(spark).limit(0), shards=8).count() == 0


def test_shards_keep_groups_whole_within_the_tolerance(spark):
    """Groups of up to 4 % of a shard stay whole; one of a third of all rows, without ids, is cut and the rest is not."""
    rows = [(i, f"group {i % 400} " + "x" * 50 * (i % 400 // 40)) for i in range(4000)]
    for extra in ([], [(None, "the hot text " * 9)] * 2000):
        out = kdtree.sharded(spark.createDataFrame(rows + extra, "doc_id long, text string"), shards=8).toPandas()
        sizes = out.groupby("shard")["size"].sum()
        assert len(out) == len(rows) + len(extra) and len(sizes) == 8 and (abs(sizes / sizes.mean() - 1) < kdtree.TOLERANCE + 0.01).all()
        cut = out.groupby("text_crc32")["shard"].nunique()
        assert set(cut[cut > 1].index) <= {zlib.crc32(b"the hot text " * 9)} and (not extra or (cut > 1).any())
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    again = kdtree.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).toPandas()
    first = kdtree.sharded(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), shards=8).toPandas()
    assert again.sort_values("id").shard.tolist() == first.sort_values("id").shard.tolist()


def test_shards_by_target_bytes(spark):
    docs = spark.createDataFrame([(i, "y" * (i * 37 % 901)) for i in range(2000)], "doc_id long, text string")
    out = kdtree.sharded(docs, target_bytes=100_000).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == -(-out["size"].sum() // 100_000) and sizes.max() <= 1.1 * sizes.mean()
    assert set(kdtree.sharded(docs.limit(3), shards=8).toPandas().shard) <= set(range(8))


def test_rank_of_hot_ids(spark, monkeypatch):
    """Null and repeated ids beyond what a window may hold: the rank is that of one sort."""
    from varnaflow.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 50)
    rnd = random.Random(12)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, rnd.choice(["a", "b", None]), rnd.randrange(4)) for i in range(3000)]
    table = shared.with_id_hash(spark.createDataFrame(rows, "id long, g string, size long"), "id")
    got = [tuple(r) for r in shared.distributed_rank(table, ["g"], "_h", ["id", "size"]).select("g", "_rank", "id", "size").collect()]
    want = []
    for g in ("a", "b", None):
        mine = sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0, s) for i, x, s in rows if x == g)
        want += [(g, k, i if there else None, s) for k, (_, there, i, s) in enumerate(mine)]
    assert Counter(got) == Counter(want)


def test_mix_of_hot_ids(spark, monkeypatch):
    """The query's plan on null and repeated ids, against its SQL."""
    from varnaflow.llm import shared

    rnd = random.Random(13)
    rows = [(None if i % 3 == 0 else i // 4, "w " * rnd.randrange(40), rnd.choice(["p", "q", None])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", pa.table({k: [r[i] for r in rows] for i, k in enumerate(("doc_id", "text", "source"))}))
    want = Counter(con.execute("SELECT doc_id, size, source_size, target, taken FROM (" + mixing.OP7_SQL + ")").fetchall())
    for hot in (1 << 16, 64):
        monkeypatch.setattr(shared, "HOT_ROWS", hot)
        plan, _ = mixing.planned(docs)
        assert Counter(tuple(r) for r in plan.select("c0", "size", "source_size", "target", "taken").collect()) == want


def token_rows(docs, ids_of):
    """What the files must give, for rows in any order: (doc_id, n_tokens, crc32)."""
    out = []
    for r in docs:
        ids = [*ids_of(r.text or ""), 0]
        out.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return Counter(out)


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    d = odd_docs(spark)
    got = tokenfiles.read(spark, tokenfiles.write(d, path, str(tmp_path / "t"))).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == token_rows(d.collect(), lambda t: library.encode(t, add_special_tokens=False).ids)
    assert tokenfiles.read(spark, tokenfiles.write(d.limit(0), path, str(tmp_path / "none"))).count() == 0
    for bits in (1, 7, 16, 17):
        x = np.random.default_rng(bits).integers(0, 1 << bits, 777).astype(np.uint32)
        assert (tokenfiles.unpack(tokenfiles.pack(x, bits), 777, bits) == x).all()


def test_token_query_on_a_hot_id(spark, tmp_path):
    """The registered query on a table where a third of the rows has no id, and on an empty one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    rows = [(None if i % 3 == 0 else i // 2, rnd.choice([None, "", "same text", f"text {i}.\nline {i % 7}  two"])) for i in range(900)]
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = tokenfiles.op9_token_files(spark, f"{tmp_path}/some").collect()
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0, *[r.n_tokens for r in in_order]])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in in_order]
    assert ids == sorted(ids)
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == token_rows(docs, lambda t: library.encode(t, add_special_tokens=False).ids)
    assert tokenfiles.op9_token_files(spark, f"{tmp_path}/none").count() == 0


def test_batches_of_odd_white_space_as_the_library_gives_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, rnd = Tokenizer.from_file(path), tokenfiles.Encoder(path), random.Random(8)
    calm = ["a", "th ", "ing", " x", " y", "\nz", "é", "the ", "word ", "'s", "12 "]
    wild = [*calm, "  ", "\n\n", "漢", "😀", ".", "\t", "\xa0", "\x1c", "\x85", "\u3000", "\u200b", "<|endoftext|>", "\r\n"]
    texts = ["".join(rnd.choice(wild if k % 2 else calm) for _ in range(rnd.randrange(12))) for k in range(3000)] + [None, "", "x" * 500]
    for a in range(0, len(texts), 41):
        ids, lengths = own.batch(texts[a : a + 41], 0)
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts[a : a + 41]]
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [k for x in want for k in x]
    assert max(map(len, own.words)) <= tokenfiles.CACHED_CHARS


def test_added_tokens_as_the_library_gives_them():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokenfiles.Encoder(path)
    (token,) = {t.content for t in library.get_added_tokens_decoder().values()}
    for text in (token, f"one {token} two", f"one{token}two", f"a  {token}  b", f"a\n {token}\n{token} b", f"one {token[:-1]} two"):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.ids(f"one {token} two").tolist().count(library.token_to_id(token)) == 1


def test_pipeline_stages_keep_columns(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, "/root/testdata/sf0.001").columns == d.columns

def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on its predecessor's output, against plain Python."""
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for i in range(160):
        lines = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(6)]
        if i % 4 == 0:
            lines[2] += " vile filthy scum"
        docs.append((i, "\n".join(["menu home contact about", *lines]), "en", "ab"[i % 2], 0))
    docs += [(200 + i, docs[4 * i + 1][1] + " end", "en", "a", 0) for i in range(20)]  # near copies
    docs += [(300, docs[1][1], "en", "b", 0), (301, None, None, None, None), (302, "", "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], int("vile" in (d[1] or ""))) for d in docs[:160]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, str(tmp_path)), "out")
        seen.append([r.asDict() for r in now.collect()])
    toxic, lines, near, mix, ids = seen

    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    fitted = toxicity.train(table, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert sorted(r["doc_id"] for r in toxic) == sorted(d[0] for d in docs if fitted.score(d[1]) < 0.5)
    right = [d[0] for d in docs if (fitted.score(d[1]) >= 0.5) == ("vile" in (d[1] or ""))]
    assert len(right) > 0.9 * len(docs)  # few labels, many words

    pages, held = Counter(r["source"] for r in toxic), Counter()
    for r in toxic:
        held.update((r["source"], x) for x in set((r["text"] or "").split("\n")) if x.strip())
    drop = {k for k, n in held.items() if n >= boilerplate.LEAST_HELD and n > boilerplate.RATIO * pages[k[0]]}
    want = {r["doc_id"]: r["text"] and "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in drop) for r in toxic}
    assert {r["doc_id"]: r["text"] for r in lines} == want and ("a", "menu home contact about") in drop

    order = sorted(lines, key=lambda r: r["doc_id"])
    group = list(range(len(order)))
    for i, j in sorted(brute_links([r["text"] for r in order])):
        old, new = max(group[i], group[j]), min(group[i], group[j])
        group = [new if g == old else g for g in group]
    assert sorted(r["doc_id"] for r in near) == sorted({order[g]["doc_id"] for g in group}) and len(near) < len(lines)

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([{k: r[k] for k in ("doc_id", "text", "source")} for r in near]))
    copies = {r[0]: r[5] for r in con.execute("SELECT doc_id, size, source_size, target, taken, copies FROM (" + mixing.OP7_SQL + ")").fetchall()}
    assert Counter(r["doc_id"] for r in mix) == Counter({k: n for k, n in copies.items() if n})

    model = pieces.load(pieces.vocabulary_path())
    plain = {r["doc_id"]: r["text"] or "" for r in near}
    assert sorted(r["doc_id"] for r in ids) == sorted(r["doc_id"] for r in mix)
    for r in ids:
        one = [k for s in model.segments(plain[r["doc_id"]]) for k in model.viterbi(s.encode())]
        assert r["ids"] == one and r["round_trip"] and model.decode(np.array(r["ids"], int)) == plain[r["doc_id"]]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in whole) == Counter((r["doc_id"], tuple(r["ids"])) for r in ids)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries_against_brute_force(spark):
    """The queries without SQL, on all rows of a small table."""
    from varnaflow.llm import registry

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    found = registry.queries()
    got = found["op2_sentencepiece"](spark, d).collect()
    model = pieces.load(pieces.vocabulary_path())
    assert len(got) == len(docs)
    for r in got:
        assert r.ids == [k for s in model.segments(docs[r.doc_id]) for k in model.viterbi(s.encode())] and r.round_trip
    for r in found["op3_media_columns"](spark, d).collect():
        b = docs[r.doc_id].encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (44 + len(p), hashlib.sha256(media.to_wav(p)).hexdigest())
    got = found["op10_kd_shards"](spark, d).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert sorted(sizes) == list(range(8)) and all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(8))
    got = found["op6_toxicity"](spark, d).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
