"""Chunks: a few MB of documents in one row, and exchanges of packed arrays between chunks and buckets.

Keys that must meet (hashes of grams, windows, shingles) are far more numerous than documents. Instead of one Spark
row per key, a chunk sends each bucket one row that holds all its keys for that bucket as a packed array, each key
once. So a key that occurs in every document costs its bucket one entry per chunk, and no key makes a partition hot.
Buckets answer every chunk in the order in which it asked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import lean, materialize, shuffle_partitions, small_batches
from ._text import Texts

#: Text bytes a chunk gathers; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: doc_id of rows that have none: greater than any other.
NO_ID = np.iinfo(np.int64).max
ASK = "bucket int, chunk long, blob binary"
SCHEMA = "chunk long, n_rows int, n_bytes long, ids binary, null_ids binary, offsets binary, payload binary"


def squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


def unsqueeze(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


class Chunk:
    def __init__(self, number: int, ids: np.ndarray, null_ids: np.ndarray, texts: Texts):
        self.number, self.ids, self.null_ids, self.texts = number, ids, null_ids, texts

    def id_column(self, rows: np.ndarray | None = None) -> pa.Array:
        ids, nulls = (self.ids, self.null_ids) if rows is None else (self.ids[rows], self.null_ids[rows])
        return pa.array(ids, pa.int64(), mask=nulls)


def _murmur(x: np.ndarray) -> np.ndarray:
    """Spark's hash of a long, by which it deals rows to buckets."""
    h = np.full(len(x), 42, np.uint32)
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    for k in (x.astype(np.uint32), (x >> 32).astype(np.uint32)):
        h = turn(h ^ turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def _numbers(part: int, n_buckets: int) -> Iterator[int]:
    """Chunk numbers of a task; all fall into one of the buckets in which chunks are stored, so a task writes one file."""
    at = part << 32
    while True:
        block = np.arange(at, at + 4096, dtype=np.int64)
        yield from block[np.mod(_murmur(block), n_buckets) == part % n_buckets].tolist()
        at += 4096


def _pack(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    lean()
    numbers = _numbers(TaskContext.get().partitionId(), n_buckets)
    ids: list[np.ndarray] = []
    nulls: list[np.ndarray] = []
    parts: list[Texts] = []
    held = 0

    def row() -> pa.RecordBatch:
        nonlocal held
        lens = np.concatenate([np.diff(t.offsets) for t in parts])
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        values = [next(numbers), len(lens), int(offsets[-1]), np.concatenate(ids).tobytes(), np.concatenate(nulls).tobytes(), offsets.tobytes(), squeeze(b"".join(t.data.tobytes() for t in parts))]
        held = 0
        for x in (ids, nulls, parts):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    for batch in batches:
        texts, own = Texts.of(batch.column(1)), batch.column(0)
        null = own.is_null().to_numpy(zero_copy_only=False)
        number_of = own.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        for a, b in texts.slices(CHUNK_BYTES):
            part = texts.part(a, b)
            if held and held + len(part.data) > CHUNK_BYTES:
                yield row()
            ids.append(number_of[a:b])
            nulls.append(null[a:b])
            parts.append(part)
            held += len(part.data)
    if parts:
        yield row()


def build(docs: DataFrame) -> DataFrame:
    """The documents' doc_id and text as a stored table of chunks, in buckets of their numbers: what is joined to it by
    chunk comes to the texts, which don't move."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(shuffle_partitions(docs.sparkSession), own.rdd.getNumPartitions())
    return materialize(own.mapInArrow(lambda batches: _pack(batches, n), SCHEMA), "chunks", "chunk", n)


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, dict]]:
    """Each chunk, with what other columns its row has."""
    lean()
    for batch in batches:
        for r in batch.to_pylist():
            data = np.frombuffer(unsqueeze(r["payload"]), np.uint8)
            yield Chunk(r["chunk"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["null_ids"], bool), Texts(data, np.frombuffer(r["offsets"], np.int64))), r


def buckets_for(chunks: DataFrame, bytes_per_text_byte: float, bucket_bytes: int = 24 << 20) -> int:
    """As many buckets as keep each one's entries within ``bucket_bytes``, as many as shuffle partitions at least."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(shuffle_partitions(chunks.sparkSession), math.ceil(total * bytes_per_text_byte / bucket_bytes))


def asked(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, c, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(x, pa.binary())], names=["bucket", "chunk", "blob"])


def exchange(asks: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Rows (chunk, answers array<struct<bucket, blob>>): what ``answer`` says to all blobs of a bucket."""

    def per_bucket(t: pa.Table) -> pa.Table:
        lean()
        order = np.argsort(t.column("chunk").to_numpy(), kind="stable")  # arrival differs from run to run
        t = t.take(pa.array(order))
        said = answer(t.column("blob").to_pylist())
        return pa.table([t.column("bucket"), t.column("chunk"), pa.array(said, pa.binary())], names=["bucket", "chunk", "blob"])

    return asks.groupBy("bucket").applyInArrow(per_bucket, ASK).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))


def with_answers(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    return chunks.join(answers, "chunk", "left")


def deal(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by bucket, the buckets that occur, and the borders of each in that order."""
    order = np.argsort(buckets, kind="stable")
    own, first = np.unique(buckets[order], return_index=True)
    return order, own, np.append(first, len(order))


def undeal(buckets: np.ndarray, answers: list[dict] | None, dtype) -> np.ndarray:
    """What the buckets answered, in the order of the entries that were dealt."""
    out = np.zeros(len(buckets), dtype)
    order, own, border = deal(buckets)
    said = {a["bucket"]: a["blob"] for a in answers or ()}
    for k, b in enumerate(own):
        out[order[border[k] : border[k + 1]]] = np.frombuffer(unsqueeze(said[int(b)]), dtype)
    return out
