"""Exactness and bounds of the operators on hard inputs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from varnaflow.llm import media, mixing, ngram_join, topk, toxicity
from varnaflow.llm.shared import stored


def near_ties(rng, n, dims, top=65_535.0):
    """Vectors close to the largest components that 64-bit integers hold, almost alike."""
    v = np.full((n, dims), top) - rng.integers(0, 3, (n, dims)) / 1024
    v[: n // 3, : dims // 2] *= -1
    v[: n // 3, dims // 2 :] = top - rng.integers(0, 3, (n // 3, dims - dims // 2)) / 1024
    return v


def exact(vectors, q, k=10):
    whole = [[int(x * 1024) if x >= 0 else -int(-x * 1024) for x in row] for row in vectors.tolist()]
    return sorted((-sum(a * b for a, b in zip(whole[q], row, strict=True)), i) for i, row in enumerate(whole) if i != q)[:k]


@pytest.mark.parametrize(("dims", "n", "block"), [(64, 800, 16384), (64, 800, 150), (2500, 90, 40)])
def test_top_k_of_near_ties_is_exact(spark, dims, n, block):
    vectors = near_ties(np.random.default_rng(dims + block), n, dims)
    t = stored(topk.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, e array<double>"), "vec_id", "e"), "v")
    got = topk.top_k(t, t.filter("id % 50 = 0"), 10, block=block, chunk=5).collect()
    for q in range(0, n, 50):
        found = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        assert found == [(k, -limit(-s), i) for k, (s, i) in enumerate(exact(vectors, q), 1)]


def test_impact_index_of_near_ties_is_exact():
    rng = np.random.default_rng(9)
    for trial in range(30):
        vectors = near_ties(rng, 300, 64)
        index = topk.ImpactIndex(np.arange(300), topk.integers(vectors))
        q = int(rng.integers(300))
        best = index.search(topk.integers(vectors)[q], 10, q)
        assert [(-s, i) for s, i, _ in best] == exact(vectors, q)
        floor = best[-1][0]
        assert index.search(topk.integers(vectors)[q], 10, q, floor) == best, trial


def test_fitted_rows_are_bounded_when_ids_repeat(spark, monkeypatch):
    seen = []
    plain = toxicity.fit

    def fit(examples, pairs, *more, **options):
        seen.append((len(examples), len(pairs)))
        return plain(examples, pairs, *more, **options)

    monkeypatch.setattr(toxicity, "fit", fit)
    base = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("women said "), F.when(F.col("id") % 2 == 0, "awful trash").otherwise("nice words"), F.lit(". men too. "), F.col("id").cast("string")).alias("text"))
    often = base.filter("doc_id = 7 OR doc_id = 8").crossJoin(spark.range(100_000)).select("doc_id", F.concat("text", F.lit(" "), (F.col("id") % 50).cast("string")).alias("text"))
    docs, labels = stored(base.unionByName(often), "docs"), spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("toxic"))
    toxicity.train(docs, labels, sample_rows=20)
    assert seen[0][0] <= 20 and seen[0][1] <= 20 * (toxicity.PAIRS + 2)
    toxicity.train(docs, labels)
    assert seen[1][0] <= 60


def test_texts_that_share_half_their_words_are_not_compared(spark, monkeypatch):
    rng = random.Random(1)
    common = [f"c{i}" for i in range(100)]
    texts = [" ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(100)]) for _ in range(2000)]
    texts[5] = texts[1000] + " end"
    ties = []
    plain = ngram_join.components

    def components(edges):
        edges = stored(edges, "seen")
        ties.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(ngram_join, "components", components)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_links"] for r in got if r["n_links"]} == {5: 1, 1000: 1}
    assert ties[0] <= 20  # of some 25,000 pairs that meet in a band


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Links with buckets pruned, and with none (all ties unseen)."""
    rng = random.Random(6)
    texts = []
    for base in range(6):
        words = [f"b{base}w{i}" for i in range(80)]
        for _ in range(25):
            w = list(words)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
            texts.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pruned = sorted(map(tuple, ngram_join.ngram_jaccard_join(table).collect()))
    monkeypatch.setattr(ngram_join, "BUCKET", 0)
    assert pruned == sorted(map(tuple, ngram_join.ngram_jaccard_join(table).collect()))
    assert any(links for _, _, links in pruned)


def test_ties_connect_what_pruning_leaves():
    fewest = ngram_join.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.integers(0, 256, (4, 240), dtype=np.uint8)
        values = np.where(rng.random((40, 240)) < rng.choice([0.05, 0.2, 0.5]), rng.integers(0, 256, (40, 240), dtype=np.uint8), base[rng.integers(0, 4, 40)])
        same = np.cumsum((values[:, None, :] == values[None, :, :]), axis=2)[:, :, ngram_join.STEP - 1 :: ngram_join.STEP]
        left = (same >= np.array(fewest)).all(axis=2)
        root = list(range(40))

        def top(i, root=root):
            return i if root[i] == i else top(root[i])

        for i, j in ngram_join.tied(values, fewest)[0]:
            assert left[i, j]
            root[top(j)] = top(i)
        assert all(top(i) == top(j) for i in range(40) for j in range(40) if left[i, j])


def test_many_documents_in_one_value_take_linear_time():
    def pdf(linearised):
        head = b"%PDF-1.4\n1 0 obj\n<< " + (b"/Linearized 1 " if linearised else b"") + b">>\nendobj\n"
        return head + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< >>\nstartxref\n%d\n%%%%EOF" % (0 if linearised else len(head))

    def seconds(n, linearised):
        began, one = time.time(), pdf(linearised)
        assert [x[2] for x in media.sniff(b"x" + one * n)["embedded"]] == [len(one)] * n
        return time.time() - began

    for linearised in (False, True):
        seconds(500, linearised)
        assert seconds(16_000, linearised) < 24 * max(0.02, seconds(2_000, linearised))


def test_a_pdf_inside_a_pdf_ends_with_the_outer_one():
    table = b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< >>\nstartxref\n%d\n%%%%EOF"
    inner = b"%PDF-1.4\n1 0 obj\n<< >>\nendobj\n"
    inner += table % len(inner)
    body = b"%PDF-1.7\n1 0 obj\nstream\n" + inner + b"\nendstream\nendobj\n"
    outer = body + table % len(body)
    assert media.sniff(outer + b" more")["length"] == len(outer)


def test_the_mix_takes_the_same_texts_again(spark):
    """Rows of one id and one size with different texts, dealt otherwise."""
    rows = [(k % 5, f"w{k} w", "ab"[k % 2]) for k in range(400)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixes = [sorted(map(tuple, mixing.mixed_rows(t).collect())) for t in (table, table.repartition(7, "text"), table.orderBy("text"))]
    assert mixes[0] == mixes[1] == mixes[2] and len(mixes[0]) > 400
