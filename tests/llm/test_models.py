"""Decontamination against brute force; toxicity by held-out accuracy."""

import hashlib
import random
import re
from collections import defaultdict

from folioframe.llm import decontaminate as D
from folioframe.llm import toxicity
from folioframe.llm.decontaminate import contaminated, decontaminate, find_matches

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall((t or "").encode().lower())


def brute(docs, items, window):
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i) if i is not None else "")
    lengths = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = tokens(t)
        hit, own = [0] * len(w), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    own |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), sum(hit) > 0))
    return sorted(out, key=str)


def test_decontamination(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        v = ["ab", "Cé", "x9", "Über", "q", "zz"]
        text = lambda n: "".join(rnd.choice(v) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))
        items = [(i, text(rnd.randint(0, 9))) for i in range(14)] + [(99, None), (None, text(6)), (3, text(7))]
        docs = [(i, text(rnd.randint(0, 80))) for i in range(80)] + [(500, None), (501, ""), (None, text(30)), (7, text(9)), (502, "ab " * 60000)]
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as item_id", "1 as n_hit").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text as doc_id")
        want = brute(docs, items, 5)
        assert sorted(map(tuple, contaminated(d, b, 5).collect()), key=str) == want
        assert sorted((r.doc_id for r in decontaminate(d, b, 5).collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str)
        assert contaminated(d.where("doc_id < 0"), b).count() == 0
        assert contaminated(d, b.where("item_id < 0")).where("contaminated").count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    """Several blocks give what one gives, also where rows of an item lie in different blocks."""
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice(["ab", "cd", "ef", "gh"]) for _ in range(n))
    items = [(str(i % 9), text(rnd.randint(3, 9))) for i in range(20)] + [(None, text(6)), ("", text(6))]
    docs = [(i % 30, text(rnd.randint(0, 90))) for i in range(60)] + [(None, None), (None, text(50)), (99, items[-1][1] + " " + items[-2][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    one = sorted(map(tuple, contaminated(d, b, 5).collect()), key=str)
    far = sorted(map(tuple, find_matches(d, b, 5).collect()), key=str)
    kept = sorted((r.doc_id, r.text) for r in decontaminate(d, b, 5).where("doc_id is not null").collect())
    assert [r[3] for r in one if r[0] == 99] >= [2]  # null and '' are two items
    monkeypatch.setattr(D, "BLOCK_BYTES", 100)
    assert sorted(map(tuple, contaminated(d, b, 5).collect()), key=str) == one
    assert sorted(map(tuple, find_matches(d, b, 5).collect()), key=str) == far
    assert sorted((r.doc_id, r.text) for r in decontaminate(d, b, 5).where("doc_id is not null").collect()) == kept


def test_decontamination_query(spark):
    """The registered query with its own window over whole tables."""
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, D.op8_decontamination(spark, sf).collect()), key=str) == brute(docs, items, 10)


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "a b c a b")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "a b c z b c a z c a b")], "item_id long, text string")
    assert sorted((r.start, r.n_words) for r in find_matches(d, b, 3).collect()) == [(0, 3), (1, 3), (2, 3)]
    d = spark.createDataFrame([(1, "x a b c d e f g y a b c d")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "a b c d e f g h"), (6, "c d e")], "item_id long, text string")
    got = sorted((r.item_id, r.start, r.n_words) for r in find_matches(d, b, 4).collect())
    assert got == [("5", 1, 7), ("5", 9, 4), ("6", 3, 3)]


def test_toxicity(spark):
    """On labelled rows that the model never saw: toxic ones are found, clean ones left alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in got)
    toxic, clean = ([r.predicted for r in got if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 80 and sum(toxic) >= 0.9 * len(toxic)
    assert len(clean) > 600 and sum(clean) <= 0.01 * len(clean)


def test_toxicity_edges(spark):
    rows = [(i, "you idiot " * (i % 2) + "fine words") for i in range(60)] + [(None, "idiot"), (100, None), (101, ""), (3, "again"), (102, "idiot " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as w", "1 as score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (700, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect() if r.doc_id != 3}
    assert got[1] == got[102] == got[None] == 1 and got[2] == got[100] == got[101] == 0
    assert toxicity.score(docs.where("doc_id < 0"), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.where("doc_id < 0")).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
