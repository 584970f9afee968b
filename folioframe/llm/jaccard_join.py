"""N-gram Jaccard join: groups of similar documents and a token-group matrix.

A document's set holds its distinct shingles of five words (A-Z lowered, words ``[^\\x20\\x09-\\x0D]+``); with fewer words
the whole sequence is its one shingle, without words the set is empty and links with nothing. Two documents link when
100 * intersection >= 75 * union.

1. Documents with equal sets collapse to the one with the least doc_id; only these go on.
2. Shingles are ordered by how many documents have them (to a quarter of a power of two, counted over all documents) and
   their hash. Of n shingles the rarest n - ceil(3n/4) + L(n) are a
   document's tokens, L(n) = 1 + n // 16: two sets that link share min(L, L') tokens at least, and from the places of the
   first shared one in both orders follows the most that they can share. Only tokens that occur in two documents
   or more go on (see ``_chunks``); a document with enough shingles of its own has none, so common passages matter only
   in documents that consist of them.
3. Partitioning into groups of similar documents: in two rounds every document is compared with one leader per token, not
   with all that share it, and links merge documents by distributed connected components. So a large group of near
   copies costs a number of comparisons that is linear in its size.
4. Token-group matrix: rows (token, group), the union of the tokens of each group's members, of tokens that still lie in
   several groups, by size classes. Sets of classes p and q share o = ceil(3 (|p| + |q|) / 7) shingles at least if they link,
   and so L of their first n - o + L each, L = 1 + |q| // 16; only these count. A group is opened to queries
   from another one where the overlap with its union reaches L, and then members that share a token with a query that can
   be their first common one are compared. No link between groups is lost.
5. Comparisons count whole sets of 64-bit hashes. Of a pair, only the lesser document's set travels, once to each chunk
   that holds partners; texts are stored in buckets of chunks and stay where they are.

Cases: null or empty texts have n_shingles 0 and their own doc_id; texts of any length are read whole; rows that share a
doc_id count as one node with the links of all their texts; rows without one are a node after all others and stay null;
other columns are not read. Where doc_ids are null or repeated, the join runs over row keys and classes are merged after.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _chunks as C
from ._components import components
from ._runtime import discard, keyed, materialize, shuffle_partitions, table
from ._text import LOWER, SPACE, U64, Texts, mix, word_hashes, words

SHINGLE = 5
#: Sizes of a class differ by this factor at most.
WIDTH = 1.04
#: Link where DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
_MULTIPLIERS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
#: A set travels to a chunk in parts of so many bytes at most (or one set).
SHIPPED = 8 << 20
ROWS = "doc_id long, n long, s1 long, s2 long, chunk long, nth int, toks array<long>, pos array<int>"


def sets(texts: Texts) -> list[np.ndarray]:
    """Each text's shingle hashes, distinct and sorted."""
    data = LOWER[texts.data]
    ws, we, offsets = words(data, texts.offsets, ~SPACE)
    h = word_hashes(data, ws, we)
    n = max(0, len(h) - SHINGLE + 1)
    s = np.zeros(n, U64)
    for j, m in enumerate(_MULTIPLIERS):
        s += h[j : j + n] * m
    s = mix(s, 9)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(s[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(x) * int(m) for x, m in zip(h[a:b], _MULTIPLIERS, strict=False)) % 2**64], U64), 20 + b - a))
        else:
            out.append(s[:0])
    return out


def _level(n):
    """L(n): of the tokens of two linked documents so many are shared, of the one that has fewer."""
    return 1 + n // 16


def _keys(every: np.ndarray, n_buckets: int):
    """The distinct shingles of a chunk: their buckets, fingerprints with a mark if several documents have them, and the
    place of each shingle among them."""
    own, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    return ((own >> U64(20)) % U64(n_buckets)).astype(np.int64), (own.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | (count > 1), inverse


def _frequent(blobs: list[bytes]) -> list[bytes]:
    """0 for shingles of one document, else four times the logarithm of how many have them."""
    key = np.frombuffer(b"".join(blobs), np.uint32)
    order = np.argsort(key >> np.uint32(1), kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] >> np.uint32(1)) != (k[:-1] >> np.uint32(1))
    start = np.flatnonzero(new)
    many = np.add.reduceat(1 + (k & np.uint32(1)).astype(np.int64), start)
    out = np.empty(len(key), np.uint8)
    out[order] = np.minimum(4 * np.log2(many), 255).astype(np.uint8)[np.cumsum(new) - 1]
    return [C.squeeze(x.tobytes()) for x in np.split(out, np.cumsum([len(b) // 4 for b in blobs])[:-1])]


def _joined(own: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(own) if own else np.zeros(0, U64)


def _rows(chunks: DataFrame) -> DataFrame:
    """ROWS of each document; toks and pos only where a token occurs in several documents."""
    n_buckets = C.buckets_for(chunks, 0.62)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in C.unpack(batches):
            bucket, key, _ = _keys(_joined(sets(chunk.texts)), n_buckets)
            if len(key):
                order, own, border = C.deal(bucket)
                yield C.asked([(int(b), chunk.number, key[order[border[k] : border[k + 1]]].tobytes()) for k, b in enumerate(own)])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, r in C.unpack(batches):
            own = sets(chunk.texts)
            bucket, _, inverse = _keys(_joined(own), n_buckets)
            often = C.undeal(bucket, r["answers"], np.uint8)[inverse] if len(bucket) else np.zeros(0, np.uint8)
            n, s1, s2, toks, pos, at = [], [], [], [], [], 0
            for s in own:
                many = len(s)
                f, at = often[at : at + many], at + many
                n.append(many)
                s1.append(int(mix(s, 10).sum(dtype=U64).view(np.int64)))
                s2.append(int(mix(s, 11).sum(dtype=U64).view(np.int64)))
                first = many - -(-NUM * many // DEN) + _level(many) if many else 0
                alone = int(np.count_nonzero(f == 0))
                if alone < first:  # s is in the order of hashes
                    shared = np.flatnonzero(f)
                    shared = shared[np.argsort(f[shared], kind="stable")[: first - alone]]
                    toks.append(s[shared].view(np.int64))
                    pos.append(np.arange(alone, alone + len(shared), dtype=np.int32))
                else:
                    toks.append(None)
                    pos.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids, pa.int64()), *[pa.array(x, pa.int64()) for x in (n, s1, s2)], pa.array([chunk.number] * len(n), pa.int64()), pa.array(range(len(n)), pa.int32()), pa.array(toks, pa.list_(pa.int64())), pa.array(pos, pa.list_(pa.int32()))], names=[x.split()[0] for x in ROWS.split(", ")])

    known = C.exchange(chunks.mapInArrow(ask, C.ASK), _frequent)
    return materialize(C.with_answers(chunks, known).mapInArrow(tell, ROWS), "rows")


def _verify(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Those of the pairs (a, b; structs of id, n, chunk, nth) that link, as ids; stored."""
    if pairs.isEmpty():
        return pairs.select("a.id", "b.id").toDF("a", "b")
    leads = pairs.select("b.*").distinct().groupBy("chunk").agg(F.collect_list(F.struct("nth", "id")).alias("wanted"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, r in C.unpack(batches):
            for w, s in zip(r["wanted"], sets(chunk.texts.take([w["nth"] for w in r["wanted"]])), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([w["id"]], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["lead", "body"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, r in C.unpack(batches):
            bodies = {x["lead"]: x["body"] for x in r["bodies"]}
            by_place: dict[tuple, list] = {}
            for x in r["sought"]:
                by_place.setdefault((x["nth"], x["id"]), []).append(x["lead"])
            a, b = [], []
            for ((_, own), partners), x in zip(by_place.items(), sets(chunk.texts.take([p for p, _ in by_place])), strict=True):
                for lead in partners:
                    y = np.frombuffer(bodies[lead], U64)
                    z = np.concatenate([x, y])
                    z.sort(kind="stable")
                    common = int(np.count_nonzero(z[1:] == z[:-1]))
                    if DEN * common >= NUM * (len(x) + len(y) - common):
                        a.append(own)
                        b.append(lead)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    bodies = materialize(chunks.join(leads, "chunk").mapInArrow(make, "lead long, body binary"), "bodies")
    to = pairs.select(F.col("a.chunk").alias("chunk"), F.col("b.id").alias("lead"), F.col("b.n").alias("n")).distinct()
    parts = to.groupBy("chunk").agg(F.ceil(F.sum(F.col("n") * 8) / SHIPPED).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("lead"), F.col("parts")).alias("part")
    # A lead with partners in very many chunks: the join's skew is split by the rows that ask, one for each chunk.
    sent = to.join(parts, "chunk").select("chunk", "lead", part).join(bodies, "lead")
    sent = sent.groupBy("chunk", "part").agg(F.collect_list(F.struct("lead", "body")).alias("bodies"))
    sought = pairs.select(F.col("a.chunk").alias("chunk"), F.col("a.nth").alias("nth"), F.col("a.id").alias("id"), F.col("b.id").alias("lead")).join(parts, "chunk")
    sought = sought.groupBy("chunk", part).agg(F.collect_list(F.struct("nth", "id", "lead")).alias("sought"))
    out = materialize(chunks.join(sent.join(sought, ["chunk", "part"]), "chunk").mapInArrow(links, "a long, b long"), "links")
    discard(bodies)
    return out


def _may_link(n: Column, pos: Column, m: Column, qos: Column) -> Column:
    """Sets of n and m shingles whose first common one is at pos and qos may link."""
    most = 1 + F.least(n - pos - 1, m - qos - 1)
    return (F.least(n, m) * DEN >= F.greatest(n, m) * NUM) & (most * (DEN + NUM) >= (n + m) * NUM)


_PLACE = ("id", "n", "chunk", "nth")


def _me(of: str = "") -> Column:
    return F.struct(*[F.col(of + c).alias(c) for c in _PLACE])


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of places; b is the lesser."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    return pairs.join(tested.select("a", "b"), (pairs["a.id"] == tested["a.id"]) & (pairs["b.id"] == tested["b.id"]), "left_anti")


def _led(rows: DataFrame, order: Column) -> DataFrame:
    """Candidate pairs of each row with its token's leader, the least in ``order``, in another group."""
    lead = rows.groupBy("tok").agg(F.min(F.struct(order.alias("o"), *_PLACE, "pos", "grp")).alias("l"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("tok", "l")
    near = rows.join(lead, "tok").where(F.col("grp") != F.col("l.grp")).where(_may_link(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos")))
    return _ordered(near.select(_me().alias("a"), _me("l.").alias("b")))


def _by_token(rows: DataFrame, tag: str) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    return materialize(rows.repartition(n, "tok"), tag, "tok", n)


def _open(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with each document's group as the links make it, only tokens that lie in several groups; stored by token."""
    group = materialize(components(links), "groups")
    rows = rows.drop("grp").join(group.select(F.col("node").alias("id"), F.col("component").alias("known")), "id", "left").withColumn("grp", F.coalesce("known", "id")).drop("known")
    several = rows.groupBy("tok").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("tok")
    out = _by_token(rows.join(several, "tok"), "open")
    discard(group)
    return out


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(WIDTH)) + 1e-9).cast("int")


def _least(c: Column) -> Column:
    """No set of the class is smaller."""
    return F.greatest(F.floor(F.pow(F.lit(WIDTH), c) * (1 - 1e-6)), F.lit(1)).cast("long")


def _shares(larger: Column, smaller: Column) -> Column:
    """How many of their first tokens two linked sets of these classes share, L."""
    return 1 + F.floor(_least(smaller) / 16)


def _by_class(rows: DataFrame, query: bool) -> DataFrame:
    """rows with each pair of classes (p, q), p the larger set's, in which their token counts; queries are the larger sets.
    ``first``: whether the token can be the first that two linked sets share."""
    own, other = ("p", "q") if query else ("q", "p")
    near = F.sequence(_class(F.greatest(F.floor(F.col("n") * NUM / DEN), F.lit(1))), _class(F.col("n"))) if query else F.sequence(_class(F.col("n")), _class(F.ceil(F.col("n") * DEN / NUM)))
    part = rows.withColumn(own, _class(F.col("n"))).withColumn(other, F.explode(near))
    common = F.ceil((_least(F.col("p")) + _least(F.col("q"))) * NUM / (DEN + NUM))
    return part.withColumn("first", F.col("pos") <= F.col("n") - common).where(F.col("pos") < F.col("n") - common + _shares(F.col("p"), F.col("q")))


def _opened(rows: DataFrame) -> DataFrame:
    """Candidate pairs between groups, by the token-group matrix."""
    queries, members = _by_class(rows, True), _by_class(rows, False)
    key = ["tok", "p", "q"]
    pairs = ["grp", "of", "p", "q"]
    between = (F.col("p") > F.col("q")) & (F.col("grp") != F.col("of")) | (F.col("grp") > F.col("of"))
    row = lambda x, name: x.select(*key, F.col("grp").alias(name)).distinct()
    # Groups meet at tokens that can be the first in common; then the overlap with the union is counted in full.
    met = row(queries.where("first"), "grp").join(row(members.where("first"), "of"), key).where(between).select(*pairs).distinct()
    overlap = met.join(row(queries, "grp"), ["grp", "p", "q"]).join(row(members, "of"), [*key, "of"]).groupBy(*pairs).agg(F.count(F.lit(1)).alias("overlap"))
    opened = overlap.where(F.col("overlap") >= _shares(F.col("p"), F.col("q"))).select(*pairs)
    asked = queries.where("first").select(*key, "grp", _me().alias("a"), F.col("pos").alias("s")).join(opened, ["grp", "p", "q"]).alias("x")
    told = members.where("first").select(*key, F.col("grp").alias("of"), _me().alias("b"), F.col("pos").alias("t")).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*key, "of")]
    pair = asked.join(told, functools.reduce(Column.__and__, same) & _may_link(F.col("a.n"), F.col("s"), F.col("b.n"), F.col("t")))
    return _ordered(pair.select("a", "b"))


def link_groups(cand: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (node, component) of the documents of ``cand`` (id, n, chunk, nth, toks, pos) that link with others."""
    rows = cand.select(*_PLACE, F.explode(F.arrays_zip("toks", "pos")).alias("t")).select(*_PLACE, F.col("t.toks").alias("tok"), F.col("t.pos").alias("pos"), F.col("id").alias("grp"))
    rows = _by_token(rows, "tokens")
    tested = links = None
    scratch = []
    for find in (lambda r: _led(r, F.col("id")), lambda r: _led(r, F.xxhash64("id", "tok")), _opened):
        pairs = find(rows)
        pairs = materialize(_untested(pairs, tested) if tested else pairs, "pairs")
        found = _verify(pairs, chunks)
        scratch += [pairs, found]
        tested, links = (tested.unionByName(pairs), links.unionByName(found)) if tested else (pairs, found)
        if find is _opened:
            break
        before, rows = rows, _open(rows, links)
        discard(before)
        if rows.isEmpty():
            break
    out = materialize(components(links), "components")
    discard(*scratch, rows)
    return out


def _hot(classes: DataFrame, total: int) -> DataFrame:
    """Those with over a thousandth of all rows: fewer than a thousand, whatever the input."""
    return classes.where(F.col("rows") * 1000 > total)


def _classes(docs: DataFrame) -> DataFrame:
    """As ``jaccard_classes``, of documents whose doc_ids are unique."""
    chunks = C.build(docs)
    rows = _rows(chunks)
    key = ["s1", "s2", "n"]
    rep = materialize(rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows")), "classes")
    cand = rows.where("toks is not null").join(rep.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "chunk", "nth", "toks", "pos")
    found = link_groups(cand, chunks)
    # Classes of one row need no join by their key; of the others, hot ones are told to all tasks.
    of = materialize(rep.join(found, rep["id"] == found["node"], "left").select(*key, "id", "rows", F.coalesce("component", "id").alias("component")).where("rows > 1 or component <> id"), "of")
    discard(rep, found, chunks)
    alone = of.where("rows = 1").select(F.col("id").alias("doc_id"), F.col("component").alias("c1"))
    several = of.where("rows > 1")
    hot = _hot(several, rows.count())
    out = rows.select("doc_id", *key).join(alone, "doc_id", "left")
    out = out.join(F.broadcast(hot.select(*key, F.col("component").alias("c2"))), key, "left")
    rest = several.join(hot.select(*key), key, "left_anti").select(*key, F.col("component").alias("c3"))
    none = F.when(F.col("c2").isNull(), F.col("s1"))  # rows of hot classes don't move to their class
    out = out.withColumn("k1", none).join(rest.withColumnRenamed("s1", "k1"), ["k1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c1", "c2", "c3", "doc_id").alias("component_id"))


def row_classes(rows: DataFrame) -> DataFrame:
    """One row per row of ``keyed``: _key, doc_id, n_shingles, component (a key; rows are nodes, whatever their doc_id)."""
    classes = _classes(rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")))
    of = classes.select(F.col("doc_id").alias("_key"), "n_shingles", F.col("component_id").alias("component"))
    return materialize(rows.select("_key", F.col("_row.doc_id").cast("long").alias("doc_id")).join(of, "_key"), "classes")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that it reaches by links)."""
    rows = keyed(docs.select("doc_id", "text"))
    if rows is None:
        return _classes(docs)
    out = row_classes(rows).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(C.NO_ID))))
    first = out.groupBy("doc_id").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last").select("doc_id", "first")
    same = out.join(first, "doc_id").select("component", "first").distinct()
    merged = materialize(components(same, "component", "first"), "merged").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    out = out.join(merged, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    out = out.join(out.groupBy("component").agg(F.min("doc_id").alias("least")), "component")
    real = lambda c: F.when(c != int(C.NO_ID), c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(F.col("least")).alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
