"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from folioframe.llm import _chunks, _repeats
from folioframe.llm.substring_dedup import op2_substring_dedup, substring_dedup
from folioframe.llm.suffix_dedup import multikey, op9_suffix_array_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = [rnd.choice("abcdeé") * rnd.randint(1, 3) + str(k) for k in range(40)]
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.3 and out:
            w = out[rnd.randrange(len(out))][1]
            w = (w or "").split()
            for _ in range(rnd.randint(0, 3)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            t = " ".join(w[rnd.randint(0, 9) :])
        elif kind < 0.4:
            t = "x " * rnd.randint(0, 90)
        else:
            t = rnd.choice([" ", "\n", "\t\x0b"]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 120)))
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (3, out[3][1]), (None, out[5][1]), (None, out[5][1]), (n + 2, "long" * 30000)]
    return out


def brute_words(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    c = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if c[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def brute_bytes(rows, length):
    big = 1 << 62
    least = {}
    data = [(big if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            least[k] = min(d, least.get(k, big))
    out = []
    for (d, _), (n, b) in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < n:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(left).hexdigest()))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=str)


def test_words(spark, monkeypatch):
    monkeypatch.setattr(_chunks, "CHUNK_BYTES", 2000)
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as kept", "doc_id as chunk", "1 as bucket").repartition(4)
        assert key(substring_dedup(docs, 12, 4, digest=True).collect()) == key(brute_words(rows, 12))


def test_bytes(spark):
    for seed in (3, 4):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as kept", "doc_id as chunk", "1 as bucket").repartition(4)
        assert key(suffix_dedup(docs, 30, 12, digest=True).collect()) == key(brute_bytes(rows, 30))


def test_kept_texts_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d y"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in substring_dedup(docs, 4, 2).collect()}
    assert got == {1: ("e f", 6, 4), 2: ("x y", 6, 4), 3: ("", 0, 0)}
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup(spark.createDataFrame([(1, "abcdefghijkl-1"), (2, "2-abcdefghijkl")], "doc_id long, text string"), 10, 8).collect()}
    assert got == {1: b"abcdefghijkl-1", 2: b"2-"}
    none = docs.where("doc_id < 0")
    assert substring_dedup(none).count() == 0
    assert suffix_dedup(none).count() == 0


def test_queries(spark):
    """The registered queries, with their own windows, over a whole table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert key(op2_substring_dedup(spark, SF).collect()) == key(brute_words(rows, 35))
    assert key(op9_suffix_array_dedup(spark, SF).collect()) == key(brute_bytes(rows, 50))


def test_many_runs_of_one_anchor():
    """Every one of very many runs at an anchor is told apart from the others."""
    rnd = np.random.default_rng(5)
    run = np.unique(rnd.integers(0, 2**63, 200_000, dtype=np.int64).astype(np.uint64) << np.uint64(1))
    blobs = [np.full(len(x), 7, np.uint32).tobytes() + x.tobytes() for x in np.array_split(rnd.permutation(run), 9)]
    code = lambda blobs: np.concatenate([np.frombuffer(_repeats.C.unsqueeze(b), np.uint8) for b in _repeats._first_answer(blobs)])
    assert len(code(blobs)) == len(run) and (code(blobs) == 3).all()  # hot: its windows are dealt one by one
    cold = [np.frombuffer(_repeats.C.unsqueeze(b), np.uint8) for b in _repeats._first_answer(blobs, 10**9)]
    assert (np.concatenate(cold) == 2).all()


def test_hot_anchors(spark, monkeypatch):
    """A passage in all documents, each time among other words: the same result when its windows are dealt one by one."""
    rnd = random.Random(9)
    own = lambda n: " ".join(f"u{rnd.randrange(10**6)}" for _ in range(n))
    passage = " ".join(f"p{k}" for k in range(45))
    rows = [(i, f"{own(20)} {passage} {own(20)}") for i in range(150)] + [(500, f"{own(3)} {passage[:60]} {own(40)}"), (None, passage), (7, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words, chars = key(brute_words(rows, 35)), key(brute_bytes(rows, 50))
    assert key(substring_dedup(docs, digest=True).collect()) == words and key(suffix_dedup(docs, digest=True).collect()) == chars
    for crowd, hot in ((2, 10**9), (10**9, 1), (0, 0)):
        monkeypatch.setattr(_repeats, "CROWD", crowd)
        monkeypatch.setattr(_repeats, "HOT", hot)
        assert key(substring_dedup(docs, digest=True).collect()) == words
        assert key(suffix_dedup(docs, digest=True).collect()) == chars


def test_multikey_sort():
    rnd = random.Random(8)
    data = bytes(rnd.choice(b"ab") for _ in range(4000)) + b"abab" * 300
    at = np.array([rnd.randrange(len(data) - 30) for _ in range(3000)])
    first = at % 3
    got = multikey(np.frombuffer(data, np.uint8), at, 30, first)
    strings = [(f, data[a : a + 30]) for a, f in zip(at.tolist(), first.tolist())]
    number = {x: i for i, x in enumerate(sorted(set(strings)))}
    assert got.tolist() == [number[x] for x in strings]
