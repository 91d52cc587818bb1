"""Toxicity: a linear classifier with a counterfactual penalty.

Features of a text: its words (lower case, outer punctuation off) and the beginnings of its words, each counted once, by
hash. Labels are learned from a bounded sample (SAMPLE_ROWS labelled ids, by a hash of the id, none of them held out; of an
id with several documents one text, the smallest, so the driver never gets more than SAMPLE_ROWS rows).
Pairs of sentences that should score alike are made of the sample: where a sentence names a group (IDENTITY_TERMS), with the
term exchanged for the next one of its list; and, so that every corpus gives pairs, one sentence of each row with a term put
in, against the same sentence with the next term, and without any. At most PAIRS sentences that name groups are taken from a
row. The loss is the logistic loss (toxic rows, the rarer kind, weigh EMPHASIS), plus ``fairness`` times the mean squared
change of the score over the pairs, plus a ridge. So the score hangs on what is said, not on which group is named, and
neutral mentions are not taken for attacks. ``selection`` is how EMPHASIS and LEAST_ROWS were chosen, on training rows only.

Everything but the sample covers all rows: each whole text is scored. Neither lang, source nor doc_id enter a score. The
held-out rows (crc32 of the id as text, mod 5 = 0) are never read for labels.

Defined cases: null and empty texts get the score of no evidence; null ids count as the empty text for the held-out rule and
have no label; a row labelled twice counts as toxic if one label says so; null labels are none; without labelled rows of both
kinds every score is the share of label 1 (0 if there is none); an empty table gives an empty result; further columns are
kept by ``accepted``, whatever their names, and not used by ``scored``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

SAMPLE_ROWS, FEATURES, BUCKETS, LEAST_ROWS, PAIRS = 16_000, 4_000, 1 << 22, 2, 8
#: Words whose features a worker keeps, and the longest of them.
KEPT, KEPT_CHARS = 200_000, 64
FAIRNESS, RIDGE, STEPS, EMPHASIS = 1.0, 2e-5, 400, 2.0
STARTS = (4, 5, 6)
#: Groups that may be named neutrally, in en, fr, de and es; the terms of a line are exchanged for each other. A word of two languages stands once.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"), ("immigrants", "natives"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"), ("musulmane", "chrétienne", "juive", "hindoue"), ("chrétiennes", "juives", "hindoues"),
    ("homosexuels", "hétérosexuels", "bisexuels", "transgenres"), ("homosexuel", "hétérosexuel", "bisexuel", "transgenre"),
    ("lesbienne", "hétérosexuelle", "bisexuelle"), ("lesbiennes", "hétérosexuelles", "bisexuelles"), ("noirs", "blancs", "asiatiques", "arabes"),
    ("noir", "blanc", "asiatique", "arabe"), ("noires", "blanches"), ("noire", "blanche"), ("immigrés", "autochtones"), ("immigré", "autochtone"),
    ("vieux", "jeunes"), ("vieille", "jeune"), ("handicapés", "sourds", "aveugles"), ("handicapé", "sourd", "aveugle"), ("handicapée", "sourde"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "buddhisten", "atheisten"), ("muslimin", "christin", "jüdin"),
    ("muslimische", "christliche", "jüdische", "hinduistische", "buddhistische", "atheistische"),
    ("muslimischen", "christlichen", "jüdischen", "hinduistischen", "buddhistischen", "atheistischen"), ("schwule", "lesbische", "heterosexuelle"),
    ("schwulen", "lesbischen", "heterosexuellen", "bisexuellen"), ("schwarze", "weiße", "asiatische"), ("schwarzen", "weißen", "asiatischen"),
    ("einwanderer", "einheimische"), ("einwanderern", "einheimischen"), ("alte", "junge"), ("ältere", "jüngere"), ("älteren", "jüngeren"),
    ("behinderte", "gehörlose", "blinde"), ("behinderten", "gehörlosen", "blinden"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"), ("musulmana", "cristiana", "judía", "atea"), ("musulmanas", "cristianas", "judías", "ateas"),
    ("homosexuales", "heterosexuales", "bisexuales"), ("homosexual", "heterosexual"), ("lesbianas", "gais"), ("negros", "blancos", "asiáticos", "latinos"),
    ("negro", "blanco", "asiático"), ("negras", "blancas", "asiáticas", "latinas"), ("negra", "blanca", "asiática", "latina"), ("inmigrantes", "autóctonos"),
    ("viejos", "jóvenes"), ("viejo", "joven"), ("discapacitados", "sordos", "ciegos"), ("discapacitado", "sordo", "ciego"), ("discapacitadas", "sordas", "ciegas"),
)
_NEXT = {t: line[(k + 1) % len(line)] for line in IDENTITY_TERMS for k, t in enumerate(line)}
_TERMS = tuple(_NEXT)
_ELIDED = re.compile(r"^(?:[dl]|qu)['’]")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(token: str) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings."""
    word = _OUTER.sub("", token)
    if not word:
        return ()
    return (crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS, *[crc32(b"^" + word[:k].encode("utf-8", "surrogatepass")) % BUCKETS for k in STARTS if len(word) > k])


class _Kept:
    """The features of words met before; at most KEPT of them, none long."""

    def __init__(self, wanted: dict | None = None):
        self.wanted, self.known = wanted, {}

    def of(self, tokens: set[str]) -> set[int]:
        known, out = self.known, set()
        for t in tokens:
            got = known.get(t)
            if got is None:
                got = features_of(t)
                if self.wanted is not None:
                    got = tuple(k for k in got if k in self.wanted)
                if len(t) <= KEPT_CHARS:
                    if len(known) >= KEPT:
                        known.clear()
                    known[t] = got
            if got:
                out.update(got)
        return out


@dataclass
class Model:
    """weights by feature; named and put_in: the pairs that the penalty acted on, of sentences that name groups and of terms put in."""

    weights: dict[int, float]
    bias: float
    named: int = 0
    put_in: int = 0
    kept: _Kept | None = field(default=None, repr=False)

    def hits(self, tokens: set[str]) -> set[int]:
        """The model's features among the tokens."""
        if self.kept is None:
            self.kept = _Kept(self.weights)
        return self.kept.of(tokens)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(self.weights[k] for k in self.hits(set((text or "").lower().split()))))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


def exchanged(text: str) -> list[tuple[set[str], set[str]]]:
    """For each sentence that names a group: its tokens, and those with every term exchanged."""
    out = []
    for sentence in _SENTENCE.findall(text.lower()):
        tokens = sentence.split()
        other = [_NEXT.get(_ELIDED.sub("", _OUTER.sub("", t)), t) for t in tokens]
        if other != tokens:
            out.append((set(tokens), set(other)))
    return out


def put_in(text: str) -> list[tuple[set[str], set[str]]]:
    """One sentence of the text, chosen by hash, with a term put in: against the next term, and against the sentence as it is."""
    sentences = [x for x in _SENTENCE.findall(text.lower()) if x.strip()]
    if not sentences:
        return []
    mark, sentence = min((crc32(x.encode("utf-8", "surrogatepass")), x) for x in sentences)
    term, tokens = _TERMS[mark % len(_TERMS)], set(sentence.split())
    return [(tokens | {term}, tokens | {_NEXT[term]}), (tokens, tokens | {term})]


def fit(examples: list[tuple[np.ndarray, int]], pairs: list[tuple[np.ndarray, np.ndarray]], size: int, fairness: float = FAIRNESS, ridge: float = RIDGE, steps: int = STEPS, emphasis: float = EMPHASIS) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient steps (Adam)."""
    y = np.array([label for _, label in examples], np.float64)
    n = np.array([len(x) for x, _ in examples])
    col = np.concatenate([x for x, _ in examples]).astype(np.int64) if n.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    p_row = np.concatenate([np.full(len(a) + len(b), k) for k, (a, b) in enumerate(pairs)]).astype(np.int64) if pairs else np.empty(0, np.int64)
    p_col = np.concatenate([np.concatenate(x) for x in pairs]).astype(np.int64) if pairs else np.empty(0, np.int64)
    p_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs]) if pairs else np.empty(0)
    share = np.where(y > 0, emphasis, 1.0)
    share /= share.sum()
    w, mean = np.zeros(size), float(share @ y)
    b = float(np.log(mean / (1 - mean)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(n)) + b
        error = (1 / (1 + np.exp(-z)) - y) * share
        g = np.bincount(col, error[row], size) + ridge * w
        if len(pairs):
            change = np.bincount(p_row, p_sign * w[p_col], len(pairs))
            g += 2 * fairness / len(pairs) * np.bincount(p_col, p_sign * change[p_row], size)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, fairness: float = FAIRNESS, ridge: float = RIDGE, emphasis: float = EMPHASIS, least_rows: int = LEAST_ROWS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic); the model of a bounded sample."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most sample_rows ids
    rows = stored(found.groupBy("_id", "y").agg(F.min("text").alias("text")).select("text", "y"), "labelled")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, total = _Kept(), [np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)]
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                total[int(y > 0)][list(kept.of(set((text or "").lower().split())))] += 1
        some = np.flatnonzero(total[0] + total[1])
        yield pd.DataFrame({"k": some, "n0": total[0][some], "n1": total[1][some]})

    counts = rows.mapInPandas(counted, "k long, n0 long, n1 long").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    kinds = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = kinds.get(0, 0), kinds.get(1, 0)
    if not n0 or not n1:
        return Model({}, 40.0 if n1 else -40.0)
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (F.lit(float(n)) - F.col(c) + 0.5))
    strength = F.abs(odds("n1", n1) - odds("n0", n0)) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = counts.filter(F.col("n0") + F.col("n1") >= least_rows).select("k", strength.alias("s")).orderBy(F.col("s").desc(), "k").limit(features).collect()
    place = {k: i for i, k in enumerate(dict.fromkeys([r["k"] for r in best] + [k for t in _NEXT for k in features_of(t)]))}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(dict.fromkeys(place, 0.0), 0.0)
        at = lambda tokens: sorted(place[k] for k in model.hits(tokens))
        for pdf in batches:
            out = []
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                text = text or ""
                out.append((int(y > 0), at(set(text.lower().split())), []))
                pairs = exchanged(text)
                if len(pairs) > PAIRS:
                    pairs = sorted(pairs, key=lambda p: crc32(" ".join(sorted(p[0])).encode("utf-8", "surrogatepass")))[:PAIRS]
                out += [(-1, at(a), at(b)) for a, b in pairs] + [(-2, at(a), at(b)) for a, b in put_in(text)]
            yield pd.DataFrame(out, columns=["y", "a", "b"])

    seen = rows.mapInPandas(placed, "y int, a array<int>, b array<int>").toPandas()
    seen = seen.assign(order=[(r.y, tuple(r.a), tuple(r.b)) for r in seen.itertuples()]).sort_values("order")  # the same sums in any run
    examples = [(np.asarray(r.a), r.y) for r in seen.itertuples() if r.y >= 0]
    pairs = [(np.asarray(r.a), np.asarray(r.b)) for r in seen.itertuples() if r.y < 0]
    w, b = fit(examples, pairs, len(place), fairness, ridge, emphasis=emphasis)
    return Model({k: float(w[i]) for k, i in place.items()}, b, int((seen["y"] == -1).sum()), int((seen["y"] == -2).sum()))


def selection(docs: DataFrame, labels: DataFrame, options: list[tuple[float, int]], fold: int = 1) -> dict[tuple[float, int], float]:
    """F1 of each (emphasis, least_rows) on one fold of the training rows (crc32 of the id, mod 5 = ``fold``), trained on the others. Held-out rows (0) take no part."""
    if not fold % 5:
        raise ValueError("fold 0 is held out")
    inside = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == fold % 5
    judged = stored(labels.filter(inside & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y")).join(docs.select("doc_id", "text"), "doc_id"), "fold")
    out = {}
    for emphasis, least_rows in options:
        model = train(docs, labels.filter(~inside), emphasis=emphasis, least_rows=least_rows)
        hit = judged.select("y", (score_column(model, F.col("text")) >= 0.5).alias("p"))
        both, p, y = hit.agg(F.sum((F.col("p") & (F.col("y") > 0)).cast("int")), F.sum(F.col("p").cast("int")), F.sum((F.col("y") > 0).cast("int"))).first()
        out[emphasis, least_rows] = 2 * (both or 0) / max(1, (p or 0) + (y or 0))
    return out


def score_column(model: Model, text: Column) -> Column:
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(scores, "double")(text.cast("string"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    out = docs.select(docs["doc_id"], score_column(model, docs["text"]).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    names = docs.columns
    rows = docs.select(score_column(model, docs["text"]).alias("_score"), *[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    return rows.filter("_score < 0.5").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
