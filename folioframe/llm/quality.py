"""Quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A word is a run of anything but white space. Its n-grams are taken of two sequences: the words themselves, lower-cased (A-Z),
singly and in pairs; and their shapes in up to three neighbours. A shape keeps what prose and junk differ in: each run of
lower-case letters, capitals, digits or of one punctuation mark counts as one sign, and a mark says whether the word equals
the one before. All are hashed to 2**BITS places; a place's value is the square root of its share among the text's n-grams, so that
values don't grow with the text.

Each text is hashed where it lies. Of the labelled rows (doc_id crc32 mod 4 <> 2) at most MAX_TRAIN are used, those with
the least hash of doc_id; their hashed features go to one task that reads them in order as a stream, EPOCHS times, and holds the
model alone (two numbers for each place), whatever the length of texts. L1 leaves some thousand weights; they are broadcast
(2**BITS at most), and every text is scored whole as one sparse dot product, without a shuffle.

Cases: a null or empty text scores as the intercept says; texts of any length are hashed in slices; of rows that share a doc_id one is
trained on, that with the least features; repeated rows give repeated scores; labels that are null, or without a document, are not used, and of several
labels of a doc_id the greatest counts; without any label the score is one half; a null doc_id is not held out and never trained on; other
columns, lang and source among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import CHUNK_BYTES, squeeze, unsqueeze
from ._runtime import lean, small_batches, table
from ._text import LOWER, SPACE, U64, Texts, mix, word_hashes, words

BITS = 18
MAX_TRAIN = 8_000
FOLDS, HELD_OUT = 4, 2
EPOCHS = 4
KEEP = 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 0.1
INTERCEPT = 1 << BITS
FEATURES = "ord long, doc_id long, label int, blob binary"

#: What bytes count as in a shape: capitals, small letters (all beyond ASCII too), digits, and every mark as itself.
SIGNS = np.arange(256, dtype=np.uint8)
SIGNS[0x30:0x3A] = ord("0")
SIGNS[0x41:0x5B] = ord("A")
SIGNS[0x61:0x7B] = SIGNS[0x80:] = ord("a")


def _shapes(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """Hashes of words after each run of one sign is cut to one."""
    sign = SIGNS[data]
    first = np.ones(len(sign), bool)
    first[1:] = sign[1:] != sign[:-1]
    first[ws] = True
    at = np.cumsum(first)
    return word_hashes(sign[first], at[ws] - 1, at[we - 1])


def ngrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every n-gram of these texts, in no order."""
    ws, we, offsets = words(texts.data, texts.offsets, ~SPACE)
    if not len(ws):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(texts)), np.diff(offsets))
    h = word_hashes(LOWER[texts.data], ws, we)
    shape = _shapes(texts.data, ws, we)
    shape[1:] ^= ((h[1:] == h[:-1]) & (own[1:] == own[:-1])).astype(U64) * U64(0x9E3779B97F4A7C15)
    pair, three = own[1:] == own[:-1], own[2:] == own[:-2]
    grams = [
        (own, mix(h, 21)),
        (own[1:][pair], mix(h[:-1] * U64(3) + h[1:] * U64(5), 22)[pair]),
        (own, mix(shape, 23)),
        (own[1:][pair], mix(shape[:-1] * U64(3) + shape[1:] * U64(5), 24)[pair]),
        (own[2:][three], mix(shape[:-2] * U64(3) + shape[1:-1] * U64(5) + shape[2:] * U64(7), 25)[three]),
    ]
    return np.concatenate([o for o, _ in grams]), (np.concatenate([g for _, g in grams]) >> U64(64 - BITS)).astype(np.int64)


def _valued(own: np.ndarray, place: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and value of each place that a text has."""
    key, count = np.unique(own << BITS | place, return_counts=True)
    own = key >> BITS
    return own, key & ((1 << BITS) - 1), np.sqrt(count / total[own])


class Leader:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the intercept, which isn't regularised."""

    def __init__(self):
        self.z = np.zeros(INTERCEPT + 1)
        self.n = np.zeros(INTERCEPT + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1, l2 = np.where(at == INTERCEPT, 0.0, L1), np.where(at == INTERCEPT, 0.0, L2)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (_logistic(w @ value) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fold() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """FEATURES of the rows to learn from, one for each doc_id."""
    known = labels.where("doc_id is not null and quality is not null").where(fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label")).select(F.xxhash64("doc_id").alias("ord"), F.col("doc_id").cast("long").alias("doc_id"), "label")
    bounded = known.orderBy("ord", "doc_id").limit(MAX_TRAIN)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(bounded), "doc_id").select("ord", "doc_id", "label", "text")  # MAX_TRAIN rows of numbers

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            blobs = []
            texts = Texts.of(batch.column(3))
            for a, b in texts.slices(CHUNK_BYTES):
                own, place = ngrams(texts.part(a, b))
                total = np.bincount(own, minlength=b - a)
                own, place, value = _valued(own, place, total)
                edge = np.searchsorted(own, np.arange(b - a + 1))
                for i, j in zip(edge[:-1], edge[1:], strict=True):
                    blobs.append(squeeze(np.diff(place[i:j], prepend=0).astype(np.int32).tobytes() + value[i:j].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=["ord", "doc_id", "label", "blob"])

    return rows.mapInArrow(hashed, FEATURES).groupBy("ord", "doc_id", "label").agg(F.min("blob").alias("blob"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not zero; the place INTERCEPT is there if there was anything to learn from."""
    small_batches(docs.sparkSession)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        model, any_row = Leader(), False
        for batch in batches:
            for label, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = unsqueeze(blob)
                place = np.cumsum(np.frombuffer(raw, np.int32, len(raw) // 8), dtype=np.int64)
                value = np.frombuffer(raw, np.float32, len(raw) // 8, len(raw) // 2)
                model.learn(np.append(place, INTERCEPT), np.append(value.astype(np.float64), 1.0), label)
                any_row = True
        w = model.weights(np.arange(INTERCEPT + 1))
        at = np.flatnonzero(w) if any_row else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["at", "w"])

    rows = _labelled(docs, labels).select("*", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"))
    # One task, over MAX_TRAIN rows that pass through it: updates build on each other.
    rows = rows.repartition(1).sortWithinPartitions("epoch", F.xxhash64("ord", "epoch"), "ord", "doc_id").select("label", "blob")
    got = rows.mapInArrow(learn, "at long, w double").toPandas()  # 2**BITS rows at most
    return got["at"].to_numpy(np.int64), got["w"].to_numpy(np.float64)


def scores(texts: Texts, w: np.ndarray) -> np.ndarray:
    """Of each text; ``w``: a weight for each place and the intercept."""
    out = np.full(len(texts), w[INTERCEPT])
    for a, b in texts.slices(CHUNK_BYTES):
        own, place = ngrams(texts.part(a, b))
        total = np.bincount(own, minlength=b - a)
        counts = w[place] != 0
        own, place, value = _valued(own[counts], place[counts], total)
        out[a:b] += np.bincount(own, w[place] * value, b - a)
    return _logistic(out)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        at, weights = model.value
        w = np.zeros(INTERCEPT + 1)
        w[at] = weights
        for batch in batches:
            s = scores(Texts.of(batch.column(2)), w)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= KEEP).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
