"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

1. Each document becomes ids (``tokenizers``, byte_bpe_50k) and an end mark; one longer than a sequence is cut into
   pieces, all full but perhaps the first. Only lengths and checksums are stored.
2. Pieces of equal length are interchangeable, so a packing is a list of bins (so many pieces of each length) with
   multiplicities, and the problem is a histogram of at most ``capacity`` lengths however many documents there are.
3. Islands, one task each, evolve packings: crossover injects whole well-filled bins of one parent into the other and
   removes the bins that would use pieces twice. The displaced pieces, with those of the worst bins left, first swap places
   with one or two others where that fills a bin better, then fill new bins as full as their lengths allow, and the rest is
   best-fitted. The worst of a population gives way to a better child, and after each epoch every island's elite migrates to
   the next. The evolution stops when the lower bound is reached.
4. Each piece's rank among those of its length (counts per partition, then a running sum) places it in the best plan.

A text goes through the tokeniser by its blank-separated words, which are cached: the tokeniser never joins across a
single blank between two visible characters, so words with their blank can be encoded on their own (by tiktoken, from the
same vocabulary, which is faster on single words). Texts with other blanks, blanks next to each other, unprintable
characters or the text of a special token are encoded whole by ``tokenizers``.

Cases: null counts as empty; an empty document is one piece that holds the end mark; texts of any length are encoded
whole; repeated rows are packed like any other; a null doc_id stays null; no documents give no rows; other columns are
not read.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._runtime import materialize, small_batches, table

CAPACITY = 1024
END = 2
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 2, 12, 6
#: Kinds of bins that one child dissolves or fills anew at most; it bounds a generation's work, not what is packed.
DISPLACED = 400
#: Cached words, of so many characters at most; the cache starts anew when it is full.
CACHE, LONG = 1_000_000, 48
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _nth long"

SPECIAL = "<|endoftext|>"


def tokenizer_folder() -> str:
    import public_tokenizers

    return public_tokenizers.path("")


class Encoder:
    """Encodes word by word where that is sure to be the same, by way of tiktoken's form of the vocabulary."""

    def __init__(self, folder: str):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(os.path.join(folder, "byte_bpe_50k.json"))
        with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f)}
        self.single = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            self.bytes_of[v] = len(k)
        self.cache: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Encode words, each after a blank, all in one text; a word ends where its bytes end."""
        own = list(words)
        ids = np.array(self.single(" " + " ".join(own)), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in own])
        cut = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        raw, at = ids.tobytes(), 0
        for w, to in zip(own, (4 * cut).tolist(), strict=True):
            self.cache[w] = raw[at:to]
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(texts)
        late: list[tuple[int, list[str], list]] = []
        new: set[str] = set()
        if len(self.cache) > CACHE:
            self.cache.clear()
        get = self.cache.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or SPECIAL in text or not text.replace("\n", "").isprintable():
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            words = text.split(" ")
            found = list(map(get, words))
            found[0] = np.array(self.single(words[0]), "<u4").tobytes()
            if None in found:
                missing = [k for k, f in enumerate(found) if f is None]
                for k in missing:
                    if len(words[k]) > LONG:
                        found[k] = np.array(self.single(" " + words[k]), "<u4").tobytes()
                short = [words[k] for k in missing if len(words[k]) <= LONG]
                new.update(short)
                late.append((i, short, found))
            else:
                out[i] = b"".join(found)
        if new:
            self._learn(new)
        for i, words, found in late:
            rest = map(self.cache.__getitem__, words)
            out[i] = b"".join([f if f is not None else next(rest) for f in found])
        return out


_encoders: dict[str, Encoder] = {}


def encoder(folder: str) -> Encoder:
    """One for each worker process, which keeps its cache from task to task."""
    if folder not in _encoders:
        _encoders[folder] = Encoder(folder)
    return _encoders[folder]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    folder = folder or tokenizer_folder()
    small_batches(docs.sparkSession)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(folder).encode, TaskContext.get().partitionId()
        nth = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += END.to_bytes(4, "little")
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, v in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(nth[length])), strict=True):
                        column.append(v)
                    nth[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokenise, PIECES)


# A bin is a tuple of (length, count) with falling lengths; a packing maps bins to how many of them there are.


def filled(b: tuple) -> int:
    return sum(s * k for s, k in b)


def best_fit(counts: dict[int, int], bins: dict[tuple, int], capacity: int) -> dict[tuple, int]:
    """Put all pieces, longest first, each where it leaves the least room; equal bins are treated together."""
    room: dict[int, dict[tuple, int]] = {}
    for b, m in bins.items():
        room.setdefault(capacity - filled(b), {})[b] = m
    for size in sorted((s for s, c in counts.items() if c), reverse=True):
        left = counts[size]
        while left:
            fit = min((r for r in room if r >= size and room[r]), default=None)
            if fit is None:
                each = min(capacity // size, left)
                b, m = ((size, each),), left // each
                new = capacity - size * each
                room.setdefault(new, {})[b] = room.setdefault(new, {}).get(b, 0) + m
                left -= m * each
                continue
            b, m = next(iter(room[fit].items()))
            each = min(fit // size, max(1, left // m))
            n = min(m, left // each)
            room[fit][b] = m - n
            if m == n:
                del room[fit][b]
            grown = dict(b)
            grown[size] = grown.get(size, 0) + each
            key = tuple(sorted(grown.items(), reverse=True))
            new = room.setdefault(fit - size * each, {})
            new[key] = new.get(key, 0) + n
            left -= n * each
    out: dict[tuple, int] = {}
    for group in room.values():
        for b, m in group.items():
            if m:
                out[b] = out.get(b, 0) + m
    return out


def cost(packing: dict[tuple, int], capacity: int) -> tuple[int, float]:
    """Sequences, then less for packings whose bins are filled unevenly, which leaves larger gaps to use."""
    return sum(packing.values()), -sum(m * (filled(b) / capacity) ** 2 for b, m in packing.items())


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, count) of pieces that fill ``room`` as far as any choice of them can, found by reachable sums."""
    kinds = [(s, c) for s, c in sorted(counts.items(), reverse=True) if 0 < s <= room and c]
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for s, c in kinds:
        before, left, block = reach, min(c, room // s), 1
        while left:  # one, two, four ... pieces at a time
            k = min(block, left)
            reach |= (reach << (s * k)) & mask
            left, block = left - k, block * 2
        steps.append((s, min(c, room // s), before))
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for s, most, before in reversed(steps):
        k = next(k for k in range(most + 1) if at >= s * k and before >> (at - s * k) & 1)
        if k:
            out.append((s, k))
            at -= s * k
    return out


def swapped(bins: dict[tuple, int], free: dict[int, int], capacity: int) -> None:
    """Dominance: a free piece takes the place of one or two pieces of a bin where that fills it better, as far as it goes;
    ``bins`` and ``free`` change. The pieces set free are smaller together, so they are easier to place."""
    for bin_ in [b for b in sorted(bins, key=filled) if filled(b) < capacity][:DISPLACED]:
        m, room = bins[bin_], capacity - filled(bin_)
        sizes = dict(bin_)
        best = None
        pairs = [(a, b) for a in sizes for b in sizes if a > b or (a == b and sizes[a] > 1)]
        for out in [(a,) for a in sizes] + pairs:
            away = sum(out)
            into = next((f for f in range(away + room, away, -1) if free.get(f)), None)
            if into and (best is None or into - away > best[0]):
                best = (into - away, into, out)
        if best is None:
            continue
        _, into, out = best
        n = min(m, free[into])
        for x in out:
            sizes[x] -= 1
        sizes[into] = sizes.get(into, 0) + 1
        bins[bin_] = m - n
        if m == n:
            del bins[bin_]
        new = tuple(sorted(((x, k) for x, k in sizes.items() if k), reverse=True))
        bins[new] = bins.get(new, 0) + n
        free[into] -= n
        for x in out:
            free[x] = free.get(x, 0) + n


def replaced(free: dict[int, int], bins: dict[tuple, int], capacity: int) -> dict[tuple, int]:
    """Places displaced pieces: swaps, then new bins as full as can be, then best fit into what room is left."""
    swapped(bins, free, capacity)
    for _ in range(DISPLACED):
        left = [s for s, c in free.items() if c]
        if not left:
            break
        first = max(left)
        free[first] -= 1
        rest = fullest(free, capacity - first)
        free[first] += 1
        bin_: dict[int, int] = {first: 1}
        for s, k in rest:
            bin_[s] = bin_.get(s, 0) + k
        if sum(s * k for s, k in bin_.items()) < 0.98 * capacity:
            break
        n = min(free[s] // k for s, k in bin_.items())
        for s, k in bin_.items():
            free[s] -= n * k
        key = tuple(sorted(bin_.items(), reverse=True))
        bins[key] = bins.get(key, 0) + n
    return best_fit(free, bins, capacity)


def crossover(a: dict[tuple, int], b: dict[tuple, int], counts: dict[int, int], capacity: int, rnd: random.Random) -> dict[tuple, int]:
    """Inject well-filled bins of b, keep those of a that still have their pieces, place the displaced ones anew."""
    left, child = dict(counts), {}

    def take(bin_: tuple, m: int) -> None:
        m = min([m, *(left[s] // k for s, k in bin_)])
        if m > 0:
            child[bin_] = child.get(bin_, 0) + m
            for s, k in bin_:
                left[s] -= m * k

    for bin_, m in sorted(b.items(), key=lambda x: (-filled(x[0]), rnd.random())):
        if filled(bin_) >= 0.98 * capacity and rnd.random() < 0.5:
            take(bin_, rnd.randint(1, m))
    for bin_, m in sorted(a.items(), key=lambda x: (-filled(x[0]), rnd.random())):
        if filled(bin_) >= 0.9 * capacity or rnd.random() < 0.5:
            take(bin_, m)
    # Of the worst bins some are dissolved too, and one in ten of the others, so that there is something to recombine.
    for n, bin_ in enumerate(sorted(child, key=lambda x: (filled(x), rnd.random()))[:DISPLACED]):
        if n < 3 or rnd.random() < 0.1:
            m = min(child[bin_], 1 + int(child[bin_] * rnd.random() * 0.1))
            child[bin_] -= m
            if not child[bin_]:
                del child[bin_]
            for s, k in bin_:
                left[s] += m * k
    return replaced(left, child, capacity)


def evolve(counts: dict[int, int], capacity: int, seed: int, population: list[dict], generations: int = GENERATIONS) -> list[dict]:
    """The population after some generations, best first. The first member is best fit; the others start elsewhere."""
    rnd = random.Random(seed)
    least = -(-sum(s * c for s, c in counts.items()) // capacity)
    while len(population) < POPULATION:
        some = {s: rnd.randint(0, c) for s, c in counts.items()} if population else {s: 0 for s in counts}
        rest = {s: c - some[s] for s, c in counts.items()}
        population.append(replaced(rest, best_fit(some, {}, capacity), capacity) if population else best_fit(rest, {}, capacity))
        if cost(population[-1], capacity)[0] <= least:
            return sorted(population, key=lambda p: cost(p, capacity))
    population.sort(key=lambda p: cost(p, capacity))
    for _ in range(generations):
        if cost(population[0], capacity)[0] <= least:
            break
        a, b = (min(rnd.sample(range(len(population)), 2)) for _ in range(2))
        child = crossover(population[a], population[b], counts, capacity, rnd)
        if cost(child, capacity) < cost(population[-1], capacity) and child not in population:
            population[-1] = child
            population.sort(key=lambda p: cost(p, capacity))
    return population


def _dump(p: dict[tuple, int]) -> str:
    return json.dumps([[list(map(list, b)), m] for b, m in p.items()])


def _load(s: str) -> dict[tuple, int]:
    return {tuple(map(tuple, b)): m for b, m in json.loads(s)}


def plan(spark: SparkSession, counts: dict[int, int], capacity: int) -> dict[tuple, int]:
    """The best packing that the islands find. A packing has a few thousand kinds of bins at most, of any number."""
    least = -(-sum(s * c for s, c in counts.items()) // capacity)
    elites: list[str] = []
    for epoch in range(EPOCHS):
        def run(batches, epoch=epoch, elites=tuple(elites)):
            for batch in batches:
                for island in batch.column(0).to_pylist():
                    own = [_load(x) for x in (elites[island], elites[island - 1])] if elites else []
                    best = evolve(counts, capacity, 1000 * epoch + island, own)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([island], pa.int64()), pa.array([_dump(best)])], names=["island", "best"])

        islands = spark.range(0, ISLANDS, 1, ISLANDS).mapInArrow(run, "island long, best string").collect()
        elites = [r.best for r in sorted(islands, key=lambda r: r.island)]
        best = min(map(_load, elites), key=lambda p: cost(p, capacity))
        if cost(best, capacity)[0] <= least:
            break
    return best


def pack(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cutted = materialize(pieces(docs, capacity, folder), "pieces")
    per_part = cutted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    best = plan(spark, counts, capacity) if counts else {}
    # Ranges of ranks for each length: first rank, pieces in a bin, first sequence, first offset.
    rows, seen, sequence = [], dict.fromkeys(counts, 0), 0
    for bin_, m in sorted(best.items()):
        at = 0
        for s, k in bin_:
            rows.append((s, seen[s], k, sequence, at))
            seen[s] += m * k
            at += s * k
        sequence += m
    rows.sort()
    lengths, first, each, base, at = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
    key = (lengths << 48) + first
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cutted.join(per_part.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before")), ["length", "_part"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(key, (n << 48) + rank, "right") - 1
            r = rank - first[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base[k] + r // each[k]), pa.array(at[k] + (r % each[k]) * n)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, (F.col("_before") + F.col("_nth")).alias("rank")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
