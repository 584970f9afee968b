"""Quality: n-grams and weights against plain Python, held-out accuracy, edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from folioframe.llm import quality as Q
from folioframe.llm._text import Texts


def plain_grams(text):
    """Names of a text's n-grams, in place of hashes."""
    w = re.findall(r"[^ \t-\r]+", text or "")
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
    sign = lambda b: "0" if 48 <= b < 58 else "A" if 65 <= b < 91 else "a" if 97 <= b < 123 or b > 127 else chr(b)
    shape = [re.sub(r"(?s)(.)\1+", r"\1", "".join(sign(b) for b in x.encode())) + ("=" if k and low[k] == low[k - 1] else "") for k, x in enumerate(w)]
    out = [("w", x) for x in low] + [("ww", *p) for p in zip(low, low[1:], strict=False)]
    out += [("s", x) for x in shape] + [("ss", *p) for p in zip(shape, shape[1:], strict=False)]
    return out + [("sss", *p) for p in zip(shape, shape[1:], shape[2:], strict=False)]


TEXTS = ["Some Words here, and THERE!!", "", None, "the the the THE a1 1a | x | y\n| z", "Éü ß $$$ %%% $$$", "one", "a\tb\x0bc"]


def test_ngrams():
    own, place = Q.ngrams(Texts.of(pa.array(TEXTS)))
    name_of = {}
    for k, t in enumerate(TEXTS):
        want = Counter(plain_grams(t))
        got = Counter(place[own == k].tolist())
        assert sorted(got.values()) == sorted(want.values())  # the same multiplicities; no two names met in these texts
        for name, n in want.items():
            name_of.setdefault(name, set()).update(p for p, m in got.items() if m == n)
    alone = {t: set(Q.ngrams(Texts.of(pa.array([t])))[1].tolist()) for t in TEXTS if t}
    assert all(set(place[own == k].tolist()) == alone.get(t, set()) for k, t in enumerate(TEXTS))


def test_weights_follow_the_updates():
    """The vectorised updates against the published ones, coordinate by coordinate."""
    rows = [({1: 0.5, 7: 1.0}, 1), ({7: 0.3, 9: 0.8}, 0), ({1: 1.0}, 1), ({9: 1.0, 1: 0.2}, 0)] * 10
    model, z, n = Q.Leader(), Counter(), Counter()

    def weight(i):
        l1, l2 = (0, 0) if i == Q.INTERCEPT else (Q.L1, Q.L2)
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + l2)

    for x, y in rows:
        at = np.array([*sorted(x), Q.INTERCEPT])
        model.learn(at, np.array([*[x[i] for i in sorted(x)], 1.0]), y)
        x = x | {Q.INTERCEPT: 1.0}
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, w in {i: weight(i) for i in x}.items():
            g = (p - y) * x[i]
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA * w
            n[i] += g * g
    got = model.weights(np.array([1, 7, 9, Q.INTERCEPT, 5]))
    assert np.allclose(got, [weight(i) for i in (1, 7, 9, Q.INTERCEPT, 5)]) and got[4] == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.op11_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    good, bad = ([r.predicted for r in got if r.quality == k] for k in (1, 0))
    assert len(good) > 700 and sum(good) >= 0.99 * len(good)
    assert len(bad) > 100 and sum(bad) <= 0.05 * len(bad)


def test_edges(spark):
    rows = [(i, "ROW!! OF!! JUNK!! " * 9 if i % 3 == 0 else f"Plain words number {i} stand here, in a row.") for i in range(300)]
    rows += [(None, "MORE!! JUNK!! HERE!!"), (1000, None), (1001, ""), (3, "again"), (1002, "JUNK!! OF!! IT!! " * 60000), (1003, "x" * 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as score", "1 as label", "2 as blob").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7000, 1), (5, None), (6, 0)], "doc_id long, quality int")
    got = Q.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in got.collect() if r.doc_id != 3}
    assert len(got) == len(rows) - 2 and got[None].predicted == got[1002].predicted == got[6].predicted == 0 and got[7].predicted == 1
    assert got[1000].score == got[1001].score and not got[None].held_out
    assert Q.score(docs.where("doc_id < 0"), labels).count() == 0
    assert {(r.score, r.predicted) for r in Q.score(docs, labels.where("doc_id < 0")).collect()} == {(0.5, 0)}
    again = {r.doc_id: r.score for r in Q.score(docs.repartition(7), labels).collect() if r.doc_id != 3}
    assert again == {k: r.score for k, r in got.items()}
