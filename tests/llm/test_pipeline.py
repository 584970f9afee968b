"""The pipeline's stages against plain versions of them on a small fixture."""

import random
import re

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline
from folioframe.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.score(docs, labels).collect() if r.predicted}
    out = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        seen.append(sorted({r.doc_id for r in out.select("doc_id").collect()}))
    assert seen[0] == sorted(set(rows) - bad)
    norm = lambda i: re.sub("[\x20\x09-\x0d]", "", rows[i] or "")
    best = {}
    for i in seen[0]:
        best.setdefault(norm(i), []).append((-len(rows[i] or ""), i))
    assert seen[1] == sorted(min(g)[1] for g in best.values())

    def shingles(i):
        w = (rows[i] or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(i) for i in seen[1]}
    of = {i: i for i in seen[1]}
    for i in seen[1]:
        for j in seen[1]:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((of[i], of[j]))
                of = {k: a if v == b else v for k, v in of.items()}
    assert seen[2] == sorted(i for i in of if of[i] == i)
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall((r.text or "").encode().lower())
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if w}
    sizes = {len(w) for w in windows}

    def hit(i):
        w = word.findall((rows[i] or "").encode().lower())
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    assert seen[3] == [i for i in seen[2] if not hit(i)]
    assert seen[4] == seen[3]


def test_near_copies_without_ids(spark):
    """Rows without a doc_id, or with that of another text, go only if they themselves link with one that stays."""
    near, other = "a b c d e f g h i j k l", "one two three four five six"
    rows = [(None, near + " m", "x"), (None, "clean words that no other row of them has", "y"), (None, None, "z"), (None, "", "v"), (7, near, "w"), (8, other, "u"), (8, "quite another text under the same number", "t"), (9, other, "s"), (None, "left alone here by all of the others", "r"), (None, "left alone here by all of the others", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    kept = [r.lang for r in out.collect()]
    assert sorted(set(kept) - {"q", "r"}) == sorted("yzvwut") and len(kept) == 7


def test_run_on_odd_rows(spark, tmp_path):
    """run() itself over nulls, empty and long texts, ties, repeated rows and columns whose names the stages use too."""
    words = [f"w{k}" for k in range(400)]
    para = lambda a, n=40: " ".join(random.Random(a).choices(words, k=n))
    toxic = [(1000 + i, para(i) + " you idiot idiot", "en", 9, "x") for i in range(40)]
    clean = [(i, para(i), "en", i, "t") for i in range(40)]
    odd = [
        (100, None, None, 0, "a"), (101, "", "en", 0, "b"), (102, "  \n", "en", 0, "c"), (None, "", "de", 1, "d"),  # equal once blanks go
        (110, para(50), "en", 1, "e"), (111, para(50), "en", 1, "e"), (111, para(50), "en", 1, "e"),  # copies, one of them repeated
        (120, para(61, 80), "en", 1, "f"), (121, para(61, 80) + " more", "en", 1, "g"),  # near copies
        (130, "before " + para(71, 12) + " after", "en", 1, "h"),  # holds a benchmark item
        (None, para(81), "en", 1, "i"), (None, para(91), None, None, None), (140, "long words here " * 20000, "en", 1, "j"),
    ]
    schema = "doc_id long, text string, lang string, n long, tok string"
    spark.createDataFrame(clean + toxic + odd, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 0) for r in clean] + [(r[0], 1) for r in toxic] + [(None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("1", para(71, 12)), (None, None), ("", "")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = sorted({r.doc_id for r in rows if r.doc_id is not None})
    assert not any(i >= 1000 for i in ids)  # toxic
    assert [i for i in ids if i < 100] == list(range(40))  # clean ones stay
    assert [i for i in ids if i >= 100] == [102, 110, 120, 140]
    assert len([r for r in rows if r.doc_id is None]) == 2  # their texts are like no other
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 1024 for b in bins.values())
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(tmp_path / f"none/{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
