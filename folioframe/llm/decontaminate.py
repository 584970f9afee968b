"""Benchmark decontamination with suffix arrays over the training documents.

Each shard of documents (a few MB) gets an array of its word suffixes, sorted by their words in sequence; every test
suffix is binary-searched in the array of every shard, which gives all places where its next ``window`` words occur
verbatim. From there both texts are compared word by word to the left and right, which gives the longest verbatim matches
and where they lie. An item with fewer words is one window of all its words. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered. Suffixes whose leading words lead no test suffix can't match and are
left out before sorting; words that no item has share one number that no window holds.

The benchmark is dealt into blocks of about BLOCK_BYTES, and one block at a time is collected, broadcast, and searched in
one pass over the documents, so what is held anywhere doesn't grow with the benchmark. Documents are never
shuffled; with several blocks only the hits are.

Cases: a null or empty text or item has no words; texts of any length are searched whole; repeated rows give repeated
results; repeated items are one item if their item_id is the same; ids may be null, and null and '' are two items though both
are written as ''; without items nothing is contaminated; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import CHUNK_BYTES
from ._runtime import discard, lean, materialize, small_batches, table
from ._text import ALNUM, LOWER, Texts, word_hashes, words

WINDOW = 10
LEAD = 3
BLOCK_BYTES = 4 << 20


def _tokens(texts: Texts):
    data = LOWER[texts.data]
    ws, we, offsets = words(data, texts.offsets, ALNUM)
    return word_hashes(data, ws, we), offsets, ws, we


class Index:
    """The test suffixes of one block of items, sorted by their windows."""

    def __init__(self, items: list[tuple], window: int):
        texts = Texts.of(pa.array([t or "" for _, t in items], pa.large_string()))
        h, offsets, *_ = _tokens(texts)
        own = sorted({i for i, _ in items}, key=lambda i: (i is not None, str(i)))
        number = {i: k for k, i in enumerate(own)}
        self.names, self.window = [str(i) if i is not None else "" for i in own], window
        self.tagged = [f"1{i}" if i is not None else "0" for i in own]  # null and '' kept apart
        self.vocabulary = np.unique(h)
        #: numbers of all items' words, from 1; the item of each, and where its text begins and ends
        self.ids = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
        lens = np.diff(offsets)
        self.item = np.repeat(np.array([number[i] for i, _ in items], np.int32), lens)
        self.row, self.row_names = np.repeat(np.arange(len(items)), lens), [str(i) if i is not None else "" for i, _ in items]
        self.begin, self.end = np.repeat(offsets[:-1], lens), np.repeat(offsets[1:], lens)
        at = np.arange(len(h))
        size = np.minimum(self.end - self.begin, window)
        starts = np.flatnonzero(at + size <= self.end)
        padded = np.concatenate([self.ids, np.zeros(window, np.int32)])
        #: window length -> (distinct windows in order, borders of each one's suffixes, suffixes)
        self.suffixes, self.leads = {}, {}
        for n in np.unique(size[starts]).tolist():
            q = starts[size[starts] == n]
            key = _packed(padded[q[:, None] + np.arange(n)])
            order = np.argsort(key, kind="stable")
            distinct, first = np.unique(key[order], return_index=True)
            self.suffixes[n] = (distinct, np.append(first, len(q)), q[order])
            d = min(n, LEAD)
            self.leads[d] = np.union1d(self.leads.get(d, np.zeros(0, np.int64)), _lead(padded, d)[q])

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0).astype(np.int32)

    def matches(self, ids: np.ndarray, offsets: np.ndarray):
        """(places in the shard, window length, test suffixes) of every window that occurs there."""
        n, w = len(ids), self.window
        if not n or not self.suffixes:
            return
        padded = np.concatenate([ids, np.zeros(w, np.int32)])
        leads = np.zeros(n, bool)
        for d, known in self.leads.items():
            code = _lead(padded, d)[:n]
            leads |= known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
        starts = np.flatnonzero(leads & (ids > 0))
        left = np.repeat(offsets[1:], np.diff(offsets))[starts] - starts  # words up to the text's end
        columns = padded[starts[:, None] + np.arange(w)]
        columns[np.arange(w) >= left[:, None]] = 0
        order = np.lexsort(columns.T[::-1])  # the suffix array of this shard
        array, place = columns[order], starts[order]
        for length, (keys, border, suffixes) in self.suffixes.items():
            own = _packed(array[:, :length])
            low, high = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
            for k in np.flatnonzero(high > low):
                yield place[low[k] : high[k]], length, suffixes[border[k] : border[k + 1]]

    def longest(self, ids: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item's row, first word in the text, words) of the verbatim matches that lie in no longer one of that row."""
        begin, end = (np.repeat(o, np.diff(offsets)) for o in (offsets[:-1], offsets[1:]))
        found: dict[tuple[int, int], dict[int, int]] = {}
        for place, length, suffixes in self.matches(ids, offsets):
            p, q = np.repeat(place, len(suffixes)), np.tile(suffixes, len(place))
            inner = (p > begin[p]) & (q > self.begin[q])
            inner[inner] = ids[p[inner] - 1] == self.ids[q[inner] - 1]  # part of the match that begins a word before
            p, q = p[~inner], q[~inner]
            size = np.full(len(p), length)
            open_ = np.arange(len(p))
            while len(open_):
                a, b = p[open_] + size[open_], q[open_] + size[open_]
                open_ = open_[(a < end[p[open_]]) & (b < self.end[q[open_]])]
                a, b = p[open_] + size[open_], q[open_] + size[open_]
                open_ = open_[ids[a] == self.ids[b]]
                size[open_] += 1
            for x, i, m in zip(p.tolist(), self.row[q].tolist(), size.tolist(), strict=True):
                at = found.setdefault((int(np.searchsorted(offsets, x, "right")) - 1, i), {})
                at[x] = max(m, at.get(x, 0))
        out = []
        for (d, i), at in sorted(found.items()):
            reach = -1
            for x, m in sorted(at.items()):
                if x + m > reach:
                    out.append((d, i, x - int(offsets[d]), m))
                    reach = x + m
        return out


def _lead(padded: np.ndarray, depth: int) -> np.ndarray:
    """The leading words at each place as a number; equal words, equal numbers."""
    out = np.zeros(len(padded) - depth + 1, np.int64)
    for j in range(depth):
        out = out * np.int64(1_000_003) + padded[j : j + len(out)]
    return out


def _packed(columns: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort as they do."""
    return np.ascontiguousarray(columns.astype(">u4")).view(f"S{4 * columns.shape[1]}").ravel()


def _shards(texts: Texts, index: Index):
    """(first text, number of texts, word numbers, offsets) of a few MB of texts at a time."""
    for a, b in texts.slices(CHUNK_BYTES):
        h, offsets, *_ = _tokens(texts.part(a, b))
        yield a, b - a, index.numbers(h), offsets


def _found(texts: Texts, index: Index):
    """For each text: the mask of its words in occurrences of windows, and the items that these are from."""
    for _, many, ids, offsets in _shards(texts, index):
        hit = np.zeros(len(ids) + 1, np.int32)
        items: dict[int, set] = {}
        for place, length, suffixes in index.matches(ids, offsets):
            np.add.at(hit, place, 1)
            np.add.at(hit, place + length, -1)
            own = np.unique(index.item[suffixes]).tolist()
            for d in np.unique(np.searchsorted(offsets, place, "right") - 1).tolist():
                items.setdefault(d, set()).update(own)
        covered = np.cumsum(hit[:-1]) > 0
        for d in range(many):
            yield covered[offsets[d] : offsets[d + 1]], items.get(d, set())


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Index]:
    """The benchmark's blocks, one after the other; items are dealt by their content, so a block has about BLOCK_BYTES."""
    own = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    n = -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    of = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(max(n, 1)))
    for k in range(n):
        rows = own.where(of == k).collect()
        yield Index([(r.item_id, r.text) for r in rows], window)


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _each_block(docs: DataFrame, benchmark: DataFrame, window: int, search, schema: str) -> list[DataFrame]:
    """What ``search(index)`` makes of the documents for each block: lazy for a single block, else stored before the next
    block is broadcast."""
    spark, out, last = docs.sparkSession, [], None
    for index in _blocks(benchmark, window):
        if last:
            out[-1] = materialize(out[-1], "hits")
            last.destroy()
        last = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=last) -> Iterator[pa.RecordBatch]:
            lean()
            yield from search(batches, shared.value)

        out.append(docs.mapInArrow(run, schema))
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, item_id string, start long, n_words long): longest verbatim matches, start counted in words."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id string, start long, n_words long"

    def search(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, ids, offsets in _shards(Texts.of(batch.column(1)), index):
                if rows := index.longest(ids, offsets):
                    i, item, p, n = zip(*[(a + d, index.row_names[k], p, n) for d, k, p, n in rows], strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(item), pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "start", "n_words"])

    found = _each_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, search, schema)
    return functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _judged(batch: pa.RecordBatch, n_words: list[int], rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    hits = [h for h, _ in rows]
    values = [n_words, hits, [len(s) for _, s in rows], [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for _, s in rows], [h > 0 for h in hits]]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(values, kinds, strict=True)]], names=COLUMNS)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = -(-(benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // BLOCK_BYTES)

    def judge(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_found(Texts.of(batch.column(1)), index))
            yield _judged(batch, [len(c) for c, _ in found], [(int(c.sum()), [index.names[k] for k in s]) for c, s in found])

    if blocks == 1:
        return _each_block(own, benchmark, window, judge, schema)[0]
    # Hits of each block by row, then all of a row together
    own = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def hits(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, np.packbits(c).tobytes(), [index.tagged[k] for k in s]) for r, (c, s) in zip(batch.column(2).to_pylist(), _found(Texts.of(batch.column(1)), index), strict=True) if s]
            if rows:
                r, c, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(c, pa.binary()), pa.array(s, pa.list_(pa.string()))], names=["_row", "mask", "items"])

    found = _each_block(own, benchmark, window, hits, "_row long, mask binary, items array<string>")
    found = [materialize(x, "hits") for x in found[-1:]] + found[:-1]
    every = functools.reduce(DataFrame.unionByName, found) if found else own.sparkSession.createDataFrame([], "_row long, mask binary, items array<string>")
    of_row = every.groupBy("_row").agg(F.collect_list("mask").alias("masks"), F.flatten(F.collect_list("items")).alias("items"))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, rows = [], []
            for text, masks, items in zip(*[c.to_pylist() for c in batch.columns[1:4]], strict=True):
                _, offsets, *_ = _tokens(Texts.of(pa.array([text], pa.large_string())))
                n_words.append(int(offsets[-1]))
                mask = np.zeros(n_words[-1], bool)
                for m in masks or ():
                    mask |= np.unpackbits(np.frombuffer(m, np.uint8), count=len(mask)).astype(bool)
                rows.append((int(mask.sum()), [x[1:] for x in set(items or ())]))
            yield _judged(batch, n_words, rows)

    return own.join(of_row, "_row", "left").select("doc_id", "text", "masks", "items").mapInArrow(sum_up, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that share no window with an item, with all their columns; no shuffle."""
    small_batches(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not items for _, items in _found(Texts.of(_column(batch, "text")), index)], pa.bool_()))

    last = None
    for index in _blocks(benchmark, window):
        if last:  # what is left after one block is stored and goes on to the next
            before, docs = docs, materialize(docs, "clean")
            last.destroy()
            discard(before)
        last = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=last) -> Iterator[pa.RecordBatch]:
            lean()
            yield from clean(batches, shared.value)

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, g)),
a AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)
"""
