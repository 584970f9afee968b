"""Packing: token ids, pieces, places and fill."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioframe.llm import packing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder(tokenizer):
    rnd = random.Random(1)
    v = [" ", "\n", "a", "Bc", "é", "'s", "'", "1", "23", "  ", "\t", ".", ",", "!!", "中", "<|endoftext|>", "\x00", " ", "_", "́", "ab.", " "]
    texts = ["".join(rnd.choice(v) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    got = packing.encoder(packing.tokenizer_folder()).encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == ids(tokenizer, t)[:-1], repr(t)


def check(rows, docs, tokenizer, capacity):
    want = {}
    for d, t in docs:
        x = ids(tokenizer, t)
        for k, (s, n) in enumerate(packing.cut(len(x), capacity)):
            want[d, k] = (s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_pack(spark, tokenizer):
    rnd = random.Random(2)
    docs = [(i, "word " * rnd.randint(0, 90)) for i in range(300)] + [(900, None), (901, ""), (902, "long text\n" * 4000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as piece", "1 as rank").repartition(4)
    n, least = check(packing.pack(d, 64).collect(), docs, tokenizer, 64)
    assert n <= least * 1.01 + 1
    assert packing.pack(d.where("doc_id < 0"), 64).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string")).count() == 2


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, least = check(packing.op1_best_fit_packing(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 1024)
    assert n <= least * 1.002 + 1


def test_crossover_keeps_all_pieces():
    rnd = random.Random(3)
    counts = {rnd.randint(1, 100): rnd.randint(1, 50) for _ in range(40)}
    a, b = packing.best_fit(counts, {}, 100), packing.evolve(counts, 100, 5, [])[0]
    child = packing.crossover(a, b, counts, 100, rnd)
    for p in (a, b, child):
        seen = defaultdict(int)
        for bin_, m in p.items():
            assert packing.filled(bin_) <= 100
            for s, k in bin_:
                seen[s] += k * m
        assert dict(seen) == counts


def triplets(n, capacity, seed):
    """Lengths of which three at a time fill n sequences without a gap."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        a = rnd.randint(int(0.38 * capacity), int(0.49 * capacity))
        b = rnd.randint(capacity // 4 + 1, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    return Counter(out)


def test_evolution_beats_its_seeds():
    """Where best fit leaves gaps, crossover finds packings that no member of the first population has."""
    for seed in range(3):
        counts = triplets(40, 1024, seed)
        seedling = packing.cost(packing.best_fit(dict(counts), {}, 1024), 1024)[0]
        first = packing.cost(packing.evolve(dict(counts), 1024, seed, [], 0)[0], 1024)[0]
        best = packing.evolve(dict(counts), 1024, seed, [], 120)[0]
        assert sum(best.values()) <= 41 < first < seedling
        got = Counter()
        for b, m in best.items():
            assert packing.filled(b) <= 1024
            for s, k in b:
                got[s] += k * m
        assert got == counts


def test_islands_beat_best_fit(spark):
    rnd = random.Random(3)
    counts = Counter(min(1024, int(rnd.lognormvariate(5.6, 0.9)) + 1) for _ in range(30000))
    best = packing.plan(spark, dict(counts), 1024)
    assert sum(best.values()) < packing.cost(packing.best_fit(dict(counts), {}, 1024), 1024)[0]
    got = Counter()
    for b, m in best.items():
        assert packing.filled(b) <= 1024
        for s, k in b:
            got[s] += k * m
    assert got == counts


def test_fullest():
    rnd = random.Random(4)
    for _ in range(60):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(5)}
        room = rnd.randint(1, 60)
        every = {0}
        for s, c in counts.items():
            every = {x + s * k for x in every for k in range(c + 1) if x + s * k <= room}
        got = packing.fullest(counts, room)
        assert sum(s * k for s, k in got) == max(every) and all(k <= counts[s] for s, k in got)
