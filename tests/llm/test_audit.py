import random
import re
from collections import Counter
from itertools import permutations

from varnaflow.llm import audit

FIELDS = "doc_id long, text string, lang string, mask int, h string, words int"


def _brute(docs, labels):
    """The rows of the audit, one document after the other."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((lang or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        total = Counter()
        for order in permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            mine = list(left)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                redundant = sum(f in x[1] for x in mine) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _audited(spark, docs, labels):
    rows = audit.filter_audit(spark.createDataFrame(docs, FIELDS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COUNTS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_against_every_order_one_by_one(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        n = rng.choice([0, 3, 199, 200, 230])
        words = [rng.choice(["aa", "bb", f"w{rng.randrange(500)}", "Éa", "XY" if rng.random() < 0.2 else "z", "50%" if rng.random() < 0.05 else "q"]) for _ in range(n)]
        text = rng.choice([" ", "\n", "\t "]).join(words)
        docs.append((rng.choice([i, i, i, None, 7]), rng.choice([text, text, text, None, "same text", "same text"]), rng.choice(["en", "fr", None, ""]), 1, "x", 2))
        labels.append((rng.choice([i, i, None, 7]), rng.choice([0, 1, None]), rng.choice([0, 1, None])))
    assert _audited(spark, docs, labels) == _brute(docs, labels)


def test_audit_on_the_bounds(spark):
    texts = [" ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(199)), " ".join(f"w{k % 100}" for k in range(200)), " ".join(f"w{k % 99}" for k in range(200)), "A" * 3 + "a" * 97, "A" * 4 + "é" * 96, "", None]
    docs = [(k, t, "en", 0, "", 0) for k, t in enumerate(texts)] * 2 + [(None, "lone", None, 0, "", 0)]
    assert _audited(spark, docs, []) == _brute(docs, [])


def test_audit_of_many_copies(spark):
    """A third of the rows is one text, another third one id."""
    docs = [(k, "copy", "en", 0, "", 0) for k in range(3000)] + [(5, f"t {k % 900}", "fr", 0, "", 0) for k in range(3000)] + [(k, f"own {k}", None, 0, "", 0) for k in range(3000, 6000)]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 6000, 2)]
    assert _audited(spark, docs, labels) == _brute(docs, labels)


def test_audit_of_nothing(spark):
    assert _audited(spark, [], [(1, 1, 1)]) == {}


def test_weights_are_shares_of_all_orders():
    weights = audit.shapley_weights()
    for mask in range(32):
        bits = bin(mask).count("1")
        assert weights[mask].tolist() == [120 // bits if mask >> k & 1 else 0 for k in range(5)]
    for v in audit.incidence().values():
        assert v.shape == (32, 600)
