"""Phrase collocations: depth-limited count tries, one per shard of texts, merged by ranges of their sorted nodes.

A shard (a chunk of texts) counts its words and phrases of two and three words in a trie of depth three. A node is known by
the 64-bit hash of its path, language first, so that a trie is a sorted array of nodes with counts; parts of a trie's nodes
are found by place: the node of the first words of a phrase is its parent, a step of the walk up, and that of its last words
its suffix link. Shards send their sorted nodes to as many buckets as there are ranges of path hashes; a bucket merges
the sorted runs, adds up the counts and answers each shard in its own order: how often a node occurs overall, nothing if that is under
MIN_COUNT, and which one shard is to report it. Two rounds: words and pairs, then only phrases of three words whose two
pairs are frequent, as no other can be. Since a shard that has a phrase also has its parts, the walks and links then find the overall
counts of all parts at home, and the shard that reports a candidate writes it with them. Ranges are of path hashes and a shard
sends each node once, so neither a frequent word nor a frequent pair makes a range hot, and no vocabulary is broadcast.
Scores, containment and ranks are DataFrame expressions over candidates.

Cases: a null text is empty; a null lang is ``und`` (as rows whose lang is that); texts of any length are read whole, a long one as a shard
of its own; repeated rows count again; ties follow the phrase in byte order; no texts give no rows; other columns, doc_id too, aren't used.
Results are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _chunks as C
from ._runtime import lean, materialize, table
from ._text import LOWER, U64, mix, word_hashes, words

MIN_COUNT = 10
#: A phrase goes if a longer candidate around it has so many percent of its occurrences.
CONTAINED = 50
TOP = 2000
PARTS = 64
#: Bytes that end a piece, and all that lie between words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
INSIDE = ~BREAK
INSIDE[[0x20, 9]] = False
#: Bytes of an entry in a bucket, for each byte of text: words and pairs, each once a shard.
PER_BYTE = 12 * 0.15
REPORTED = "lang string, phrase string, a long, l1 long, r1 long, l2 long, r2 long, within array<string>"


class Level(NamedTuple):
    """Nodes of one depth: sorted path hashes, counts in the shard, and a place in it where each begins."""

    path: np.ndarray
    count: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, path: np.ndarray, at: np.ndarray) -> Level:
        own, first, count = np.unique(path, return_index=True, return_counts=True)
        return cls(own, count, at[first])


class Trie:
    """The words of a shard in order, and the nodes of depth one and two."""

    def __init__(self, chunk: C.Chunk):
        texts = chunk.texts
        # Each text begins with its language in hexadecimal digits and a line end.
        head = texts.offsets[:-1]
        ends = np.flatnonzero(texts.data == 10)
        tail = ends[np.searchsorted(ends, head)]
        self.langs = [bytes.fromhex(texts.data[a:b].tobytes().decode()).decode() for a, b in zip(head, tail, strict=True)]
        data = LOWER[texts.data]
        for a, b in zip(head, tail, strict=True):
            data[a:b] = 10
        self.data = data
        self.ws, self.we, offsets = words(data, texts.offsets, INSIDE)
        self.text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        lang = word_hashes(texts.data, head, tail)
        self.word = mix(word_hashes(data, self.ws, self.we) + lang[self.text] * U64(3), 31)
        breaks = np.cumsum(BREAK[data])[self.ws]
        self.follows = (breaks[1:] == breaks[:-1]) & (self.text[1:] == self.text[:-1])
        self.pair = mix(self.word[:-1] * U64(3) + self.word[1:] * U64(5), 32)
        every = np.arange(len(self.word))
        self.ones = Level.of(self.word, every)
        self.twos = Level.of(self.pair[self.follows], every[:-1][self.follows])

    def threes(self, frequent: np.ndarray) -> Level:
        """Phrases of three words both of whose pairs are frequent."""
        at = np.flatnonzero(self.follows[1:] & self.follows[:-1])
        good = np.zeros(len(self.pair), bool)
        good[self.follows] = frequent[np.searchsorted(self.twos.path, self.pair[self.follows])]
        at = at[good[at] & good[at + 1]]
        return Level.of(mix(self.pair[at] * U64(7) + self.word[at + 2] * U64(11), 33), at)

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.data[self.ws[k] : self.we[k]].tobytes() for k in range(at, at + n)).decode()


def _ranges(path: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((path >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte of all numbers, which packs better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(raw: bytes, kind, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


def _ask(path: np.ndarray, count: np.ndarray, number: int, n_buckets: int) -> list[tuple[int, int, bytes]]:
    """The nodes of a trie, as a sorted run for each range."""
    order, own, border = C.deal(_ranges(path, n_buckets))
    rows = []
    for k, b in enumerate(own):
        x = order[border[k] : border[k + 1]]
        steps = np.diff(path[x], prepend=U64(0))
        rows.append((int(b), number, C.squeeze(_planes(steps) + _planes(count[x].astype(np.uint32)))))
    return rows


def _merge(blobs: list[bytes]) -> list[bytes]:
    """Counts of nodes over all runs: 0 where under MIN_COUNT, and negative in the one run that reports the node."""
    runs, counts = [], []
    for b in blobs:
        raw = C.unsqueeze(b)
        n = len(raw) // 12
        runs.append(np.cumsum(_numbers(raw[: 8 * n], U64, n)))
        counts.append(_numbers(raw[8 * n :], np.uint32, n))
    path = np.concatenate(runs)
    order = np.argsort(path, kind="stable")  # sorted runs one after the other: a merge
    p = path[order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), np.flatnonzero(new))
    total[total < MIN_COUNT] = 0
    out = np.empty(len(p), np.int64)
    out[order] = total[np.cumsum(new) - 1] * np.where(new, -1, 1)
    return [C.squeeze(x.tobytes()) for x in np.split(out, np.cumsum([len(r) for r in runs])[:-1])]


def _both(trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of depth one and two, each depth sorted."""
    return np.concatenate([trie.ones.path, trie.twos.path]), np.concatenate([trie.ones.count, trie.twos.count])


def _known(trie: Trie, answers: list[dict] | None, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    told = C.undeal(_ranges(_both(trie)[0], n_buckets), answers, np.int64)
    return np.split(told, [len(trie.ones.path)])


def _candidates(trie: Trie, ones: np.ndarray, twos: np.ndarray, threes: Level, told: np.ndarray) -> dict[str, list]:
    """REPORTED columns of the phrases that this shard reports; and, without a phrase, how many words of each lang it has."""
    words_of: dict[str, int] = {}
    for lang, many in zip(trie.langs, np.bincount(trie.text, minlength=len(trie.langs)).tolist(), strict=True):
        words_of[lang] = words_of.get(lang, 0) + many
    one = np.abs(ones)[np.searchsorted(trie.ones.path, trie.word)]  # of each word of the shard
    two = np.zeros(len(trie.pair), np.int64)
    two[trie.follows] = np.abs(twos)[np.searchsorted(trie.twos.path, trie.pair[trie.follows])]
    a2, at2 = -twos[twos < 0], trie.twos.first[twos < 0]
    a3, at3 = -told[told < 0], threes.first[told < 0]
    none = [None] * len(a2)
    names = [(trie.phrase(k, 2), trie.phrase(k + 1, 2)) for k in at3.tolist()]
    covered = [sorted({n for n, m in zip(pair, (x, y), strict=True) if 100 * a >= CONTAINED * m}) for pair, a, x, y in zip(names, a3.tolist(), two[at3].tolist(), two[at3 + 1].tolist(), strict=True)]
    told_of = {
        "lang": [trie.langs[trie.text[k]] for k in (*at2, *at3)],
        "phrase": [trie.phrase(k, 2) for k in at2.tolist()] + [trie.phrase(k, 3) for k in at3.tolist()],
        "a": [*a2.tolist(), *a3.tolist()],
        "l1": [*one[at2].tolist(), *one[at3].tolist()],
        "r1": [*one[at2 + 1].tolist(), *two[at3 + 1].tolist()],
        "l2": [*none, *two[at3].tolist()],
        "r2": [*none, *one[at3 + 2].tolist()],
        "within": [*none, *covered],
    }
    rest = [None] * len(words_of)
    totals = dict.fromkeys(told_of, rest) | {"lang": list(words_of), "a": list(words_of.values())}
    return {k: v + totals[k] for k, v in told_of.items()}


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored tables: every phrase of MIN_COUNT occurrences with the counts of its parts and the pairs it covers, and all words of each lang."""
    text = F.concat(F.hex(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary")), F.lit("\n"), F.coalesce("text", F.lit("")))
    chunks = C.build(docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")))
    n_buckets = C.buckets_for(chunks, PER_BYTE)
    longs = pa.int64()

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in C.unpack(batches):
            trie = Trie(chunk)
            if len(trie.word):
                yield C.asked(_ask(*_both(trie), chunk.number, n_buckets))

    def ask_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, r in C.unpack(batches):
            trie = Trie(chunk)
            threes = trie.threes(_known(trie, r["answers"], n_buckets)[1] != 0)
            if len(threes.path):
                yield C.asked(_ask(threes.path, threes.count, chunk.number, n_buckets))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, r in C.unpack(batches):
            trie = Trie(chunk)
            ones, twos = _known(trie, r["answers"], n_buckets)
            threes = trie.threes(twos != 0)
            told = C.undeal(_ranges(threes.path, n_buckets), r["threes"], np.int64)
            found = _candidates(trie, ones, twos, threes, told)
            kinds = (pa.string(), pa.string(), longs, longs, longs, longs, longs, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found.values(), kinds, strict=True)], names=list(found))

    known = materialize(C.exchange(chunks.mapInArrow(ask_first, C.ASK), _merge), "known")
    flagged = C.with_answers(chunks, known)
    three = C.exchange(flagged.mapInArrow(ask_second, C.ASK), _merge).withColumnRenamed("answers", "threes")
    found = materialize(flagged.join(three, "chunk", "left").mapInArrow(report, REPORTED), "reported")
    return found.where("phrase is not null"), found.where("phrase is null").groupBy("lang").agg(F.sum("a").alias("n"))


def _score(l: str, r: str) -> Column:  # noqa: E741
    return F.expr(f"(cast(a as decimal(38,0)) * a * 1000000) div (cast({l} as decimal(38,0)) * {r})")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Each lang's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found, totals = candidates(docs)
    gone = found.select("lang", F.explode("within").alias("phrase")).distinct()
    left = found.join(gone, ["lang", "phrase"], "left_anti").withColumns({"s1": _score("l1", "r1"), "s2": _score("l2", "r2")})
    first = F.col("l2").isNull() | (F.col("s1") <= F.col("s2"))
    scored = left.select("lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.when(first, F.col("s1")).otherwise(F.col("s2")).alias("score"))
    # The first of each part of a lang come first, so that no task ranks more than PARTS * top of one.
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", rank("_part")).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", rank()).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) as piece from documents),
lists as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces),
phrases as (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: list_aggregate(w[k:k + size - 1], 'string_agg', ' '))) as phrase from lists, range(1, 4) s(size)),
counted as (select lang, size, phrase, count(*) as f from phrases group by all),
totals as (select lang, sum(f)::bigint as n from counted where size = 1 group by lang),
long_ones as (select lang, phrase, size, f, string_split(phrase, ' ') as w from counted where size > 1 and f >= 10),
cuts as (select lang, phrase, size, f, k, array_to_string(w[1:k], ' ') as ahead, array_to_string(w[k + 1:], ' ') as behind from long_ones, range(1, 3) c(k) where k < size),
scored as (select c.lang, c.phrase, c.f as a, c.k, x.f as l, y.f as r, (1000000::hugeint * c.f * c.f // (x.f::hugeint * y.f))::bigint as score
  from cuts c join counted x on x.lang = c.lang and x.phrase = c.ahead join counted y on y.lang = c.lang and y.phrase = c.behind),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
gone as (select s.lang, s.phrase from long_ones s join (select lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from long_ones where size = 3) t
  on s.lang = t.lang and s.phrase = t.part where s.size = 2 and 100 * t.f >= 50 * s.f),
kept as (select * from lowest where not exists (select 1 from gone where gone.lang = lowest.lang and gone.phrase = lowest.phrase)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
