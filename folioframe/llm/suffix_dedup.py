"""Suffix-array dedup: a sparse suffix array over the bytes of all documents.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller doc_id; matches
never cross documents, overlaps count, and strings are judged on the input.

Method: suffixes are dealt to buckets by sampled splitters over their leading GRAM bytes, so suffixes that begin with the
same gram never lie on both sides of a border and no comparison across borders is left over. Only suffixes at
winnowed anchors are dealt: each string of ``length`` bytes holds one at a place that its own content fixes, so equal
strings meet in one bucket, and a fourteenth of the suffixes settles all of them. Hashes tell first which grams occur
once; of the others the stretches themselves are sent, one copy of each, and buckets sort all suffixes
that begin in them by a multikey sort: eight bytes at a time, each round over the suffixes that are still tied with a
neighbour, so the depth at which neighbours part is their common prefix; strings of ``length`` bytes are equal where it is
as long as they are.

Cases: a null or empty text has no bytes; texts of any length are processed whole; rows that share a doc_id never
remove each other's bytes; a null doc_id counts as greater than any other and stays null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _chunks as C
from ._repeats import repeated
from ._runtime import table
from ._text import BYTE_VALUES, U64, Runs, Texts, spread

LENGTH, GRAM = 50, 24
#: Sampled suffixes for each bucket, and of each chunk that is sampled.
SAMPLES, OF_CHUNK = 16, 64
#: Suffixes sorted at a time.
SORTED = 1 << 19
SCHEMA = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _units(texts: Texts):
    return BYTE_VALUES[texts.data], texts.offsets, None


def _leads(data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """The leading bytes of the suffixes at ``at``, as strings that sort as they do."""
    return np.lib.stride_tricks.sliding_window_view(data, gram)[at].view(f"S{gram}").ravel() if len(at) else np.zeros(0, f"S{gram}")


def _first(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at ``at`` as numbers that sort as they do."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), ">u8", padded.data, strides=(1,))[at].astype(U64)


def _place(splitters: np.ndarray, data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """How many splitters are not greater than each suffix; whole grams are compared only where eight bytes don't tell."""
    if not len(splitters) or not len(at):
        return np.zeros(len(at), np.int64)
    raw = np.frombuffer(b"".join(x.ljust(gram, b"\0") for x in splitters.tolist()), np.uint8)
    heads, lead = _first(raw, np.arange(len(splitters)) * gram), _first(data, at)
    out = np.searchsorted(heads, lead, "left")
    tied = np.flatnonzero(out < np.searchsorted(heads, lead, "right"))
    out[tied] = np.searchsorted(splitters, _leads(data, at[tied], gram), "right")
    return out


def _splitters(length: int, gram: int):
    def dealer(chunks: DataFrame, n_buckets: int):
        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, _ in C.unpack(batches):
                u, offsets, _ = _units(chunk.texts)
                at = Runs(u, offsets, length, gram).at
                lead = _leads(chunk.texts.data, at[:: max(1, len(at) // OF_CHUNK)], gram)
                yield pa.RecordBatch.from_arrays([pa.array([x.ljust(gram, b"\0") for x in lead.tolist()], pa.binary())], names=["lead"])

        step = max(1, chunks.count() * OF_CHUNK // (n_buckets * SAMPLES))
        sampled = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(step)) == 0).mapInArrow(sample, "lead binary")
        leads = np.sort(np.array([bytes(r[0]) for r in sampled.collect()], f"S{gram}"))  # about SAMPLES for each bucket
        splitters = np.unique(leads[np.linspace(0, len(leads), n_buckets, endpoint=False, dtype=np.int64)[1:]]) if len(leads) else leads
        return lambda texts: lambda runs, x: _place(splitters, texts.data, runs.at[x], gram)

    return dealer


def _stretches(length: int):
    """How runs are described: by the bytes that their strings cover."""

    def describe(runs: Runs, which: np.ndarray, texts: Texts) -> np.ndarray:
        return texts.data[spread(runs.start[which], runs.windows[which] + length - 1)]

    return describe


def multikey(data: np.ndarray, at: np.ndarray, length: int, first: np.ndarray) -> np.ndarray:
    """Numbers of the distinct strings data[a : a + length], a in ``at``, that have the same ``first``, in sorted order.

    Suffixes are parted by eight bytes at a time; a round looks only at those that are tied with another one so far.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), ">u8", padded.data, strides=(1,))
    group = np.unique(first, return_inverse=True)[1]  # so far; numbers leave room for the parts of each
    tied = np.arange(len(at))
    for depth in range(0, length, 8):
        size = np.bincount(group[tied], minlength=1)
        tied = tied[size[group[tied]] > 1]
        if not len(tied):
            break
        word = words[at[tied] + depth].astype(U64)
        if length - depth < 8:
            word >>= U64(8 * (8 - length + depth))
        order = np.lexsort((word, group[tied]))
        g, w = group[tied][order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        # Renumber all groups: one more for each part that a tied group falls into
        parts = np.ones(int(group.max()) + 1, np.int64)
        starts = np.flatnonzero(np.diff(g, prepend=-1))
        parts[g[starts]] = np.add.reduceat(new.astype(np.int64), starts)
        base = np.cumsum(parts) - parts
        within = np.cumsum(new) - 1
        within -= np.repeat(within[starts], np.diff(np.append(starts, len(g))))
        moved = base[group]
        moved[tied[order]] = base[g] + within
        group = moved
    return group


def _equal(length: int):
    def equal(told: np.ndarray, at: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Suffixes of one anchor stay together; as many anchors at a time as fit SORTED."""
        order = np.argsort(anchor, kind="stable")
        border = np.append(np.flatnonzero(np.diff(anchor[order].astype(np.int64), prepend=-1)), len(order))
        many = np.concatenate([[0], np.cumsum(windows[order])])
        where = np.cumsum(windows) - windows
        out = np.empty(int(windows.sum()), np.int64)
        k = seen = 0
        while k < len(border) - 1:
            to = max(k + 1, int(np.searchsorted(many[border], many[border[k]] + SORTED, "right")) - 1)
            x = order[border[k] : border[to]]
            found = multikey(told, spread(at[x], windows[x]), length, np.repeat(anchor[x], windows[x]))
            out[spread(where[x], windows[x])] = seen + found
            seen += int(found.max()) + 1
            k = to
        return out

    return equal


def _finish(digest: bool):
    def finish(chunk: C.Chunk, _, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        kept, removed, spans = [], [], []
        for i in range(len(chunk.texts)):
            a, b = offsets[i], offsets[i + 1]
            g = gone[a:b]
            r = int(g.sum())
            removed.append(r)
            spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if r else 0)
            left = (chunk.texts.data[a:b][~g] if r else chunk.texts.data[a:b]).tobytes()
            kept.append(hashlib.sha256(left).hexdigest() if digest else left)
        ids, n, r, s = chunk.id_column(), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())
        columns = [ids, n, r, s, pa.array(kept, pa.string())] if digest else [ids, pa.array(kept, pa.binary()), n, r, s]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in (DIGEST if digest else SCHEMA).split(", ")])

    return finish


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, kept (the bytes left), n_bytes, n_removed, n_spans (maximal removed stretches).

    ``digest`` gives kept_sha256 in place of the bytes.
    """
    if gram < 8:
        raise ValueError("gram must be 8 bytes at least")
    how = {"dealer": _splitters(length, gram), "describe": _stretches(length), "size": lambda windows: windows + length - 1, "equal": _equal(length)}
    return repeated(docs, _units, _finish(digest), DIGEST if digest else SCHEMA, length, gram, True, 1.0, **how)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), digest=True)
