"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from folioframe.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items())


def answer(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def table_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "text as form").repartition(3)


def test_chains_ties_and_edges(spark):
    words = {"abcdef": 700, "abcdeg": 130, "abcdxg": 24, "abcdxgy": 5, "abcdezg": 5, "bcdefg": 9, "zbcdefg": 45, "bcdefgz": 45, "Éabcdé": 6, "éabcdé": 40, "short": 90, "x" * 300: 60, "x" * 299: 5, "x" * 150 + "y" + "x" * 150: 7}
    rows, k = [(None, None), (7, ""), (8, "12 . ,")], 10
    for w, n in words.items():
        rows += [(k, " ".join([w] * (n // 2))), (k + 1, "_".join([w.upper() if w.isascii() else w] * (n - n // 2)))]
        k += 2
    rows += [(None, "abcdef; abcdef"), (10, "abcdef " * 3), (10, "abcdef " * 3)]
    assert answer(spelling.variants(table_of(spark, rows))) == brute(rows)
    assert answer(spelling.variants(table_of(spark, rows).where("doc_id = 7"))) == []
    assert spelling.variants(table_of(spark, rows)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_lists_that_are_split(spark, monkeypatch):
    """Words that share a half, so that keys are split down to one code point; the same pairs as without splitting."""
    rnd = random.Random(3)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 9))) for _ in range(150)} | {"common" + "".join(rnd.choice("abc") for _ in range(3)) for _ in range(20)}
    rows = [(k, " ".join([w] * rnd.choice([5, 6, 40]))) for k, w in enumerate(sorted(words))]
    want = brute(rows)
    assert sum(r[4] for r in want) > 500
    assert answer(spelling.variants(table_of(spark, rows))) == want
    monkeypatch.setattr(spelling, "PAIRS", 4)
    assert answer(spelling.variants(table_of(spark, rows))) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert answer(spelling.op12_spelling_variants(spark, sf)) == brute(docs)
