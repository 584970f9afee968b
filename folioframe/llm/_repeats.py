"""Stretches that occur more than once in a corpus, exactly, by winnowed anchors.

Every window of W units (words or bytes) is charged to its anchor, the least-hashed gram in it, and consecutive
windows with one anchor form a run. Two exchanges settle all windows:

1. Each chunk sends (anchor, run) hashes of its distinct runs. A bucket tells apart anchors that occur
   once, which are done, from those that occur again, and names for each distinct run one chunk to describe it.
2. Repeated runs are sent again; the named chunks add what their windows hold (hashes, or the bytes themselves). A bucket
   compares windows among the runs of an anchor, so matches are extended to both sides up to the last equal window, and
   answers a mask of each run's repeated windows.

No pair of documents is formed: a stretch shared by a million documents costs one entry per chunk. An anchor with very many
different runs around it is hot: a chunk with more than CROWD of them says only that, and wherever an anchor is
hot its windows are dealt to all buckets by their own hashes, in the second exchange, one entry per chunk for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _chunks as C
from ._runtime import materialize
from ._text import U64, Runs, mix, spread

ALL = U64(2**64 - 1)
#: Distinct runs at one anchor: from a chunk, and in a bucket, before it counts as hot.
CROWD, HOT = 64, 20_000
_CROWDED = U64(2**64 - 1)
#: A mask has 64 bits, so an anchor may lie in that many windows at most.
MOST_SPREAD = 64


class Entries:
    """The distinct runs of a chunk, in the order of their content hashes."""

    def __init__(self, runs: Runs, ids: np.ndarray, earlier: bool, bucket_of: Callable[[Runs, np.ndarray], np.ndarray]):
        order = np.lexsort((ids[runs.doc], runs.content)) if earlier else np.argsort(runs.content, kind="stable")
        c = runs.content[order]
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        first = np.flatnonzero(new)
        self.run = order[first]  # in ``earlier``, of the least doc_id
        self.of = np.empty(len(order), np.int64)  # the entry of each run
        self.of[order] = np.cumsum(new) - 1
        self.content, self.anchor = runs.content[self.run], runs.anchor[self.run]
        self.id = ids[runs.doc[self.run]] if len(ids) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(first, len(order)))
        if earlier:  # several documents, not several places
            last = ids[runs.doc[order[np.append(first[1:], len(order)) - 1]]] if len(order) else self.id
            self.many = last != self.id
        else:
            self.many = self.count > 1
        self.bucket = bucket_of(runs, self.run)


def _stand(e: Entries, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries that a chunk sends, and for every entry the one of them that stands for it; a crowded anchor sends one."""
    order = np.argsort(e.anchor, kind="stable")
    first = np.flatnonzero(np.diff(e.anchor[order].view(np.int64), prepend=~e.anchor[order[:1]].view(np.int64)) != 0) if len(order) else order
    many = np.diff(np.append(first, len(order)))
    crowded = np.zeros(len(order), bool)
    crowded[order] = np.repeat(many > crowd, many)
    head = np.empty(len(order), np.int64)
    head[order] = np.repeat(order[first], many)
    stand = np.where(crowded, head, np.arange(len(order)))
    return np.unique(stand), stand


def _first_ask(e: Entries, number: int, crowd: int):
    sent, stand = _stand(e, crowd)
    crowded = np.bincount(stand, minlength=len(e.run))[sent] > max(crowd, 0)
    run = np.where(crowded, _CROWDED, (e.content[sent] & ~U64(1)) | e.many[sent].astype(U64))
    order, own, border = C.deal(e.bucket[sent])
    anchor, run = e.anchor[sent].astype(np.uint32)[order], run[order]
    return [(int(b), number, anchor[border[k] : border[k + 1]].tobytes() + run[border[k] : border[k + 1]].tobytes()) for k, b in enumerate(own)]


def _codes(e: Entries, answers: list[dict] | None, crowd: int) -> np.ndarray:
    """The code of every entry, from the answers to those that were sent."""
    if not answers:
        return np.zeros(len(e.run), np.uint8)
    sent, stand = _stand(e, crowd)
    return C.undeal(e.bucket[sent], answers, np.uint8)[np.searchsorted(sent, stand)]


def _first_answer(blobs: list[bytes], most: int = HOT) -> list[bytes]:
    """0: the anchor occurs nowhere else; 1: it does; 2: it does with other runs, and this chunk describes its own; 3: it is
    hot."""
    sizes = [len(b) // 12 for b in blobs]
    anchor = np.concatenate([np.frombuffer(b, np.uint32, n) for b, n in zip(blobs, sizes, strict=True)])
    run = np.concatenate([np.frombuffer(b, U64, n, 4 * n) for b, n in zip(blobs, sizes, strict=True)])
    many = (run & U64(1)).astype(np.int64)
    run >>= U64(1)
    order = np.lexsort((run, anchor))
    a, r = anchor[order], run[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_r = new_a.copy()
    new_r[1:] |= r[1:] != r[:-1]
    starts = np.flatnonzero(new_a)
    group = np.cumsum(new_a) - 1
    again = (np.add.reduceat(1 + many[order], starts) > 1)[group]
    runs = np.add.reduceat(new_r.astype(np.int64), starts)
    hot = ((runs > most) | (np.maximum.reduceat(r, starts) == _CROWDED >> U64(1)))[group]
    code = np.empty(len(a), np.uint8)
    code[order] = np.where(hot, 3, again.astype(np.uint8) + (again & (runs > 1)[group] & new_r))
    return [C.squeeze(x.tobytes()) for x in np.split(code, np.cumsum(sizes)[:-1])]


def _second_ask(e: Entries, runs: Runs, code: np.ndarray, number: int, describe: Callable):
    kept = np.flatnonzero((code > 0) & (code < 3))
    order, own, border = C.deal(e.bucket[kept])
    out = []
    for k, b in enumerate(own):
        x = kept[order[border[k] : border[k + 1]]]
        tells = x[code[x] == 2]
        windows = runs.windows[e.run[x]] * (code[x] == 2)
        body = [np.array([len(x)], np.int64), e.content[x], e.id[x], e.anchor[x].astype(np.uint32), np.minimum(e.count[x], 2).astype(np.uint8), windows.astype(np.uint8), describe(runs, e.run[tells])]
        out.append((int(b), number, b"".join(y.tobytes() for y in body)))
    return out


class HotWindows:
    """The distinct windows of the runs at hot anchors, which are dealt by their own hashes."""

    def __init__(self, e: Entries, runs: Runs, code: np.ndarray, n_buckets: int):
        self.entry = np.flatnonzero(code == 3)
        self.count = runs.windows[e.run[self.entry]]
        h = runs.window_hashes(e.run[self.entry])
        owner = np.repeat(self.entry, self.count)
        self.hash, self.of = np.unique(h, return_inverse=True)
        self.id = np.full(len(self.hash), np.iinfo(np.int64).max)
        np.minimum.at(self.id, self.of, e.id[owner])
        self.many = np.bincount(self.of, np.minimum(e.count[owner], 2), len(self.hash)) > 1
        self.bucket = n_buckets + ((self.hash >> U64(7)) % U64(n_buckets)).astype(np.int64)

    def ask(self, number: int):
        """A blob that begins with a number below zero holds windows."""
        order, own, border = C.deal(self.bucket)
        out = []
        for k, b in enumerate(own):
            x = order[border[k] : border[k + 1]]
            out.append((int(b), number, b"".join(y.tobytes() for y in (np.array([-len(x)], np.int64), self.hash[x], self.id[x], self.many[x]))))
        return out

    def masks(self, e: Entries, answers: list[dict], earlier: bool) -> np.ndarray:
        """For each of ``entry``, a mask of its repeated windows."""
        told = C.undeal(self.bucket, answers, np.int64)[self.of]
        hit = told < np.repeat(e.id[self.entry], self.count) if earlier else told > 1
        bit = U64(1) << spread(np.zeros(len(self.entry), np.int64), self.count).astype(U64)
        return np.bitwise_or.reduceat(np.where(hit, bit, U64(0)), np.cumsum(self.count) - self.count)


def _window_answer(blobs: list[bytes], earlier: bool) -> list[bytes]:
    """For every window the least doc_id that has it, or how often it occurs."""
    sizes = [-int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
    h, ids, many = (np.concatenate([np.frombuffer(b, kind, n, 8 + n * at) for b, n in zip(blobs, sizes, strict=True)]) for kind, at in ((U64, 0), (np.int64, 8), (np.uint8, 16)))
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    group = np.empty(len(h), np.int64)
    group[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
    said = np.minimum.reduceat(ids[order], start) if earlier else np.add.reduceat(1 + many[order].astype(np.int64), start)
    return [C.squeeze(x.tobytes()) for x in np.split(said[group], np.cumsum(sizes)[:-1])]


def hashes(runs: Runs, which: np.ndarray, texts) -> np.ndarray:
    """Describes runs by the hashes of their windows."""
    return runs.window_hashes(which).view(np.uint8)


def equal_hashes(told: np.ndarray, at: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Numbers that are the same for equal windows, and only for them, of runs described by ``hashes`` from ``at`` on."""
    h = told.view(U64)[spread(at // 8, windows)]
    return np.unique(mix(h ^ (np.repeat(anchor.astype(U64), windows) << U64(32)), 5), return_inverse=True)[1]


def _second_answer(earlier: bool, size: Callable, equal: Callable) -> Callable[[list[bytes]], list[bytes]]:
    """size(windows): bytes that describe a run; equal: as ``equal_hashes``."""

    def answer(blobs: list[bytes]) -> list[bytes]:
        if np.frombuffer(blobs[0], np.int64, 1)[0] < 0:
            return _window_answer(blobs, earlier)
        parts: list[list[np.ndarray]] = []
        for b in blobs:
            n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
            part = []
            for kind, width in ((U64, 8), (np.int64, 8), (np.uint32, 4), (np.uint8, 1), (np.uint8, 1)):
                part.append(np.frombuffer(b, kind, n, at))
                at += n * width
            part.append(np.frombuffer(b, np.uint8, len(b) - at, at))
            parts.append(part)
        content, ids, anchor, count, windows, told_as = (np.concatenate([p[k] for p in parts]) for k in range(6))
        windows = windows.astype(np.int64)
        length = np.where(windows > 0, size(windows), 0)
        at = np.cumsum(length) - length  # where each entry's description begins
        # Runs of equal content, over all chunks
        order = np.lexsort((content, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (content[order][1:] != content[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
        starts = np.flatnonzero(new)
        run_of = np.empty(len(order), np.int64)
        run_of[order] = np.cumsum(new) - 1
        total = np.add.reduceat(count[order].astype(np.int64), starts)
        least = np.minimum.reduceat(ids[order], starts)
        # Their windows, where a chunk has described them
        told = np.flatnonzero(windows)
        run, first = np.unique(run_of[told], return_index=True)
        teller = told[first]
        own = np.repeat(np.arange(len(run)), windows[teller])
        place = spread(np.zeros(len(run), np.int64), windows[teller]).astype(U64)
        if len(own):
            w_of = equal(told_as, at[teller], windows[teller], anchor[teller])
            w_order = np.argsort(w_of, kind="stable")
            w_start = np.flatnonzero(np.diff(w_of[w_order], prepend=-1))
            w_total = np.add.reduceat(total[run[own]][w_order], w_start)[w_of]
            w_least = np.minimum.reduceat(least[run[own]][w_order], w_start)[w_of]
        described = np.full(len(total), -1, np.int64)
        described[run] = np.arange(len(run))
        known = described[run_of]
        if not earlier:
            mask = np.where(total[run_of] > 1, ALL, U64(0))
            if len(own):
                bits = np.bitwise_or.reduceat(np.where(w_total > 1, U64(1) << place, U64(0)), np.cumsum(windows[teller]) - windows[teller])
                mask = np.where(known >= 0, bits[known], mask)
        else:
            mask = np.where(least[run_of] < ids, ALL, U64(0))
            # Only runs that no smaller document repeats as a whole need to look at their windows.
            look = np.flatnonzero((known >= 0) & (mask == 0))
            if len(look):
                n = windows[teller][known[look]]
                x = spread((np.cumsum(windows[teller]) - windows[teller])[known[look]], n)
                hit = w_least[x] < np.repeat(ids[look], n)
                mask[look] = np.bitwise_or.reduceat(np.where(hit, U64(1) << place[x], U64(0)), np.cumsum(n) - n)
        return [C.squeeze(x.tobytes()) for x in np.split(mask.astype(U64), np.cumsum([len(p[0]) for p in parts])[:-1])]

    return answer


def _covered(e: Entries, runs: Runs, ids: np.ndarray, mask: np.ndarray, n: int, earlier: bool) -> np.ndarray:
    """Of each unit, whether a repeated window covers it; ``mask``: of each entry's windows."""
    full = mask
    of_run = full[e.of]
    if earlier:  # another document of this chunk with a smaller id has the same run
        of_run[ids[runs.doc] > e.id[e.of]] = ALL
    step = np.zeros(n + 1, np.int32)
    whole = np.flatnonzero(of_run == ALL)
    np.add.at(step, runs.start[whole], 1)
    np.add.at(step, runs.start[whole] + runs.windows[whole] - 1 + runs.window, -1)
    part = np.flatnonzero((of_run != ALL) & (of_run != 0))
    w = runs.windows[part]
    start = spread(runs.start[part], w)
    bit = (np.repeat(of_run[part], w) >> spread(np.zeros(len(part), np.int64), w).astype(U64)) & U64(1)
    start = start[bit > 0]
    np.add.at(step, start, 1)
    np.add.at(step, start + runs.window, -1)
    return np.cumsum(step[:n]) > 0


def repeated(docs: DataFrame, units: Callable, finish: Callable, schema: str, window: int, gram: int, earlier: bool, units_per_byte: float, dealer: Callable | None = None, describe: Callable = hashes, size: Callable = lambda windows: 8 * windows, equal: Callable = equal_hashes) -> DataFrame:
    """Rows that ``finish`` makes of each chunk and the mask of its units in repeated windows.

    units(Texts) -> (unit hashes, offsets of the texts in them, anything for ``finish``);
    finish(chunk, anything, offsets, mask) -> RecordBatch. dealer(chunks, n_buckets) -> (Texts -> (runs, indices) ->
    buckets) deals anchors to buckets, by their hash if it isn't given. ``earlier``: a window counts as repeated if it also
    starts in a document of smaller doc_id; else if it starts anywhere else. describe, size and equal say how buckets
    compare windows.
    """
    if window - gram + 1 > MOST_SPREAD:
        raise ValueError(f"window - gram must be under {MOST_SPREAD}")
    crowd, hot = CROWD, HOT
    chunks = C.build(docs)
    n_buckets = C.buckets_for(chunks, units_per_byte * 24 / (window - gram))
    deal = dealer(chunks, n_buckets) if dealer else lambda texts: lambda runs, x: ((runs.anchor[x] >> U64(33)) % U64(n_buckets)).astype(np.int64)

    def parts(chunk: C.Chunk):
        u, offsets, rest = units(chunk.texts)
        runs = Runs(u, offsets, window, gram)
        return u, offsets, rest, runs, Entries(runs, chunk.ids, earlier, deal(chunk.texts))

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in C.unpack(batches):
            *_, runs, e = parts(chunk)
            if len(e.run):
                yield C.asked(_first_ask(e, chunk.number, crowd))

    def ask_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, r in C.unpack(batches):
            if r["answers"]:
                *_, runs, e = parts(chunk)
                code = _codes(e, r["answers"], crowd)
                rows = _second_ask(e, runs, code, chunk.number, lambda runs, x: describe(runs, x, chunk.texts))
                if (code == 3).any():
                    rows += HotWindows(e, runs, code, n_buckets).ask(chunk.number)
                if rows:
                    yield C.asked(rows)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, r in C.unpack(batches):
            u, offsets, rest, runs, e = parts(chunk)
            code, mask = _codes(e, r["answers"], crowd), np.zeros(len(e.run), U64)
            if r["masks"]:
                told = (code > 0) & (code < 3)
                mask[told] = C.undeal(e.bucket[told], r["masks"], U64)
                if (code == 3).any():
                    windows = HotWindows(e, runs, code, n_buckets)
                    mask[windows.entry] = windows.masks(e, r["masks"], earlier)
            yield finish(chunk, rest, offsets, _covered(e, runs, chunk.ids, mask, len(u), earlier))

    known = materialize(C.exchange(chunks.mapInArrow(ask_first, C.ASK), lambda blobs: _first_answer(blobs, hot)), "known")
    flagged = C.with_answers(chunks, known)
    masks = C.exchange(flagged.mapInArrow(ask_second, C.ASK), _second_answer(earlier, size, equal))
    return flagged.join(masks.withColumnRenamed("answers", "masks"), "chunk", "left").mapInArrow(last, schema)
