"""The Jaccard join against all pairs."""

import random

from folioframe.llm.jaccard_join import jaccard_classes, op7_ngram_jaccard_join


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(d), find(rows[j][0])))
                parent[y] = x
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets, strict=True))


def corpus(seed, n=220):
    rnd = random.Random(seed)
    v = [f"w{k}" for k in range(60)]
    common = [rnd.choice(v) for _ in range(25)]
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.65 and out:
            w = out[rnd.randrange(min(len(out), 12 if rnd.random() < 0.6 else 999))][1].split()
            for _ in range(rnd.randint(0, 5)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(v)
        else:
            w = [rnd.choice(v) for _ in range(rnd.randint(0, 80))]
            if rnd.random() < 0.4:
                w[10:10] = common
        t = " ".join(w)
        out.append((i * 7 % 1009, t.upper() if rnd.random() < 0.2 else t))
    return out


def test_all_pairs(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed) + [(2000, ""), (2001, "a b"), (2002, "A  b"), (2003, "a b c"), (2004, "y " * 40000), (2005, "Y " * 40001)]
        rows.append((rows[5][0], rows[5][1]))
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as tok", "doc_id as id", "1 as n").repartition(5)
        assert sorted(map(tuple, jaccard_classes(docs).collect())) == brute(rows)


def test_query(spark):
    """The registered query over a whole table."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op7_ngram_jaccard_join(spark, sf).collect())) == brute(rows)


def test_unlike_families(spark):
    """Families of near copies that share most shingles with each other, but for some pairs not enough to link: groups meet
    in the token-group matrix, and only members that can link are compared."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**5)}"
    base = [word() for _ in range(120)]
    rows = []
    for family in range(6):
        own = list(base)
        at = rnd.randrange(70)
        own[at : at + 14 + 4 * family] = [word() for _ in range(14 + 4 * family)]
        for _ in range(12):
            w = list(own)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = word()
            rows.append((len(rows) * 37 % 101, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard_classes(docs).collect())) == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five six"), (4, "one two three four five six")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs).collect()}
    assert got == {1: (0, 1), 2: (0, 2), None: (2, 4), 4: (2, 4)}
    assert jaccard_classes(docs.where("doc_id < 0")).count() == 0


def test_repeated_ids(spark):
    """Different texts under one doc_id or none keep all their links."""
    for seed in (4, 5):
        rows = [(i % 40, t) for i, t in corpus(seed, 120)] + [(2000 + i, t) for i, t in corpus(seed, 60)] + [(3000, ""), (3000, "p q r s t u"), (3001, "p q r s t u")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert sorted(map(tuple, jaccard_classes(docs).collect())) == brute(rows)
    pair = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n o"), (3, "a b c d e f g x"), (None, "q r s t u v"), (None, "A A A A A A"), (5, "q r s t u v")]
    got = sorted(map(str, jaccard_classes(spark.createDataFrame(pair, "doc_id long, text string")).collect()))
    assert got == sorted(f"Row(doc_id={d}, n_shingles={n}, component_id={c})" for d, n, c in [(1, 3, 1), (1, 3, 1), (2, 4, 1), (3, 4, 1), (None, 2, 5), (None, 1, 5), (5, 2, 5)])
