"""Collocations against brute force."""

import random
import re
from collections import Counter

from folioframe.llm import phrases


def brute(docs, top=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for k in range(len(w) - size + 1):
                    f[lang, tuple(w[k : k + size])] += 1
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 10}
    gone = {(lang, p) for (lang, w), a in kept.items() if len(w) == 3 for p in (w[:2], w[1:]) if 100 * a >= 50 * f[lang, p]}
    out = {}
    for (lang, w), a in kept.items():
        if (lang, w) not in gone:
            cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top]))


def answer(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_brute_force(spark):
    """Nine shards, and few words, so that parts, covers and ties occur."""
    for seed in range(2):
        rnd = random.Random(seed)
        v = ["ab", "Éc", "x9", "über", "AB", "zz", "q-q", " "] + [f"w{k}" for k in range(30)]
        text = lambda n: "".join(rnd.choice(v[: rnd.choice([8, 38])]) + rnd.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r", "!"]) for _ in range(n))
        docs = [(text(rnd.randint(0, 60)), rnd.choice(["en", "de", None, "und", "l\nx", ""])) for _ in range(900)]
        docs += [(None, "en"), ("", None), ("ab", "once"), ("ab ab " * 3000, "en"), (" . ", "dots")] + [("New York City stands", "en")] * 12 + [("new york", "en")] * 5
        d = spark.createDataFrame(docs, "text string, lang string").selectExpr("*", "text as phrase", "1 as a", "cast(null as long) as doc_id", "2 as n").repartition(9)
        want = brute(docs)
        assert answer(phrases.collocations(d)) == want and len(want) > 100
        assert answer(phrases.collocations(d, 3)) == brute(docs, 3)


def test_empty(spark):
    d = spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert answer(phrases.collocations(d)) == answer(phrases.collocations(d.where("lang = 'x'"))) == []


def test_counts_beyond_64_bits(spark):
    rows = [(10**12, 10**12, 10**12, 3 * 10**12, 10**12)]
    d = spark.createDataFrame(rows, "a long, l1 long, r1 long, l2 long, r2 long")
    assert tuple(d.select(phrases._score("l1", "r1"), phrases._score("l2", "r2")).first()) == (1000000, 333333)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    assert answer(phrases.op13_phrases(spark, sf)) == brute(docs)
