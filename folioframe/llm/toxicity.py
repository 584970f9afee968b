"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbours and pairs with one word between them, lower-cased
(A-Z), and the words cut to their first STEMS bytes, so that other endings of a word count too; all hashed to 2**BITS places. Training is FTRL-proximal with per-coordinate learning rates and L1, one pass per
epoch, on labelled rows with crc32(doc_id) mod 5 <> 0 only; labels, lang, source and doc_id are never features. At most
MAX_TRAIN labelled rows are used, those with the least hash of doc_id, and of them features that MIN_ROWS rows have; the
rows are hashed where they lie, so the one task that fits the model gets numbers and no texts. Everything else reads
all rows. The weights (a few hundred are not zero) are broadcast, and every text is scored whole in one pass over the
documents without a shuffle.

Cases: a null or empty text has the score of the intercept alone; very long texts count each feature once; repeated
rows give repeated scores, and of rows that share a doc_id the least text is trained on; labels that are null, or without a document, are not used; without any label the score is
0 for all; a null doc_id counts as not held out, and is never trained on; extra columns pass through ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import CHUNK_BYTES, squeeze, unsqueeze
from ._runtime import lean, materialize, small_batches, table
from ._text import ALNUM, LOWER, U64, Texts, mix, word_hashes, words

BITS = 20
STEMS = (4, 5, 6, 7)
MAX_TRAIN = 20_000
MIN_ROWS = 3
FOLDS = 5
EPOCHS = 3
#: L1 this strong leaves out features that a few documents explain, such as most pairs; the same for any number of rows.
ALPHA, BETA, L1, L2 = 1.5, 1.0, 3.0, 0.0
SLICES = 16


def features(texts: Texts):
    """For each text, the distinct places of its features."""
    data = LOWER[texts.data]
    ws, we, offsets = words(data, texts.offsets, ALNUM)
    h = word_hashes(data, ws, we)
    pairs = mix(h[:-1] * U64(3) + h[1:] * U64(5), 7) if len(h) > 1 else h[:0]
    skips = mix(h[:-2] * U64(7) + h[2:] * U64(11), 8) if len(h) > 2 else h[:0]
    stems = [np.where(we - ws > k, mix(word_hashes(data, ws, np.minimum(we, ws + k)), 12), mix(h, 6)) for k in STEMS]
    places = [(x >> U64(64 - BITS)).astype(np.int32) for x in (mix(h, 6), pairs, skips, *stems)]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.unique(np.concatenate([places[0][a:b], places[1][a : max(a, b - 1)], places[2][a : max(a, b - 2)], *[x[a:b] for x in places[3:]]]))


def all_features(texts: Texts):
    for a, b in texts.slices(CHUNK_BYTES):
        yield from features(texts.part(a, b))


class Ftrl:
    """The last coordinate is the intercept, which has no L1."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not zero, from (order, label, steps between the places of features)."""
    model = Ftrl()
    rows = [(np.cumsum(np.frombuffer(unsqueeze(x), np.int32), dtype=np.int32), label) for _, label, x in sorted(rows)]
    for _ in range(EPOCHS):
        for places, label in rows:
            model.learn(places, label)
    w = model.weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at]


def fold() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", "toxic", F.xxhash64("doc_id").alias("_order"))
    bounded = known.orderBy("_order", "doc_id").limit(MAX_TRAIN)
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id")  # MAX_TRAIN rows at most
    # One text of each doc_id, chosen before the exchange, so that a doc_id of very many rows is no larger than others.
    rows = materialize(rows.groupBy("doc_id", "_order", "toxic").agg(F.min("text").alias("text")).select("_order", "toxic", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        n = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for places in all_features(Texts.of(batch.column(2))):
                n[places] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(n, SLICES)], pa.binary())], names=["slice", "blob"])

    def add(t: pa.Table) -> pa.Table:
        many = sum(np.frombuffer(b.as_py(), np.int32) for b in t.column("blob")) >= MIN_ROWS
        return pa.table({"slice": t.column("slice")[:1], "blob": pa.array([np.packbits(many).tobytes()], pa.binary())})

    known = rows.mapInArrow(count, "slice int, blob binary").groupBy("slice").applyInArrow(add, "slice int, blob binary").collect()  # a bit for each place
    bits = b"".join(r.blob for r in sorted(known, key=lambda r: r.slice))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        often = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in batches:
            places = [squeeze(np.diff(p[often[p]], prepend=0).astype(np.int32).tobytes()) for p in all_features(Texts.of(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary())], names=["_order", "toxic", "places"])

    def learn(t: pa.Table) -> pa.Table:
        at, w = fit(list(zip(t.column(1).to_pylist(), t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)))
        return pa.table({"at": pa.array(at, pa.int32()), "w": pa.array(w, pa.float64())})

    if not known:
        return np.zeros(0, np.int64), np.zeros(0)
    got = rows.mapInArrow(hashed, "_order long, toxic int, places binary").select(F.lit(0).alias("_all"), "*").groupBy("_all").applyInArrow(learn, "at int, w double").toPandas()
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(np.float64)


def _dense(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros((1 << BITS) + 1)
    out[at] = w
    return out


def _scores(texts: Texts, w: np.ndarray) -> np.ndarray:
    sums = np.array([w[places].sum() for places in all_features(texts)], np.float64) + w[-1]
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35))) if w.any() else np.zeros(len(texts))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        w = _dense(*model.value)
        for batch in batches:
            s = _scores(Texts.of(batch.column(2)), w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (fold() == 0).alias("held_out"), "text").select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under one half, with all their columns; no shuffle of texts but those trained on."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        w = _dense(*model.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(Texts.of(batch.column(batch.schema.get_field_index("text"))), w) < 0.5))

    return docs.mapInArrow(clean, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
