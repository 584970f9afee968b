"""Exact dedup by progressive refinement, in DataFrame functions only.

Two texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Documents are
grouped by the length of the normalised text; those that share theirs by the hash of its first characters; those that share
that too by its full SHA-256. A row that is alone at a level is settled there and goes no further. As a row of the result
has the SHA-256 of its text, one scan reads each text once and stores a signature row per document; levels
work on signatures, and texts are never shuffled.

Counts at each level are pre-aggregated sums, and rows find the counts of their key over SALTS partitions, so a key with
a third of all rows makes no hot task; the join back to the rows has one row per group on one side and is split where it
is skewed.

Of equal texts the row with the most code points in the original text stays, of those the one with the smallest
doc_id. Cases: null counts as empty, and all empty or blank texts are equal; rows that share doc_id and text are one
group, all with kept = true (``keep_first`` keeps one row of them); a null doc_id loses against any other and has kept
= true only where no other row of its group has one; extra columns of any name pass through ``keep_first`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import keyed, materialize, table

PREFIX = 64
SALTS = 32
_GONE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for x in _GONE:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, points (code points of the text), len, head (hash of the first characters) and sha of the normalised text."""
    n = docs.select(F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), normalised(F.col("text")).alias("norm"))
    return n.select("doc_id", "points", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head"), F.sha2("norm", 256).alias("sha"))


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key others have too."""
    several = rows.groupBy(*key).count().where("count > 1").select(*key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(several, [*key, "_salt"], "left_semi").drop("_salt")


def groups(sig: DataFrame) -> DataFrame:
    """Rows (len, head, sha, keep_id, group_size) of the groups of two or more."""
    left = _shared(_shared(sig, ["len"]), ["len", "head"])
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    full = left.groupBy("len", "head", "sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return full.select("len", "head", "sha", F.col("best.id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    sig = materialize(signatures(docs), "signatures")
    key = ["len", "head", "sha"]
    found = materialize(groups(sig), "groups")
    # Groups with over a thousandth of all rows are fewer than a thousand: told to all tasks, their rows don't move.
    hot = found.where(F.col("group_size") * 1000 > sig.count())
    rest = found.join(hot.select(*key), key, "left_anti")
    out = sig.join(F.broadcast(hot.select(*key, F.col("keep_id").alias("k1"), F.col("group_size").alias("g1"))), key, "left")
    out = out.withColumn("_len", F.when(F.col("g1").isNull(), F.col("len")))
    out = out.join(rest.select(F.col("len").alias("_len"), "head", "sha", F.col("keep_id").alias("k2"), F.col("group_size").alias("g2")), ["_len", "head", "sha"], "left")
    size = F.coalesce("g1", "g2")
    keep = F.when(F.col("g1").isNotNull(), F.col("k1")).when(F.col("g2").isNotNull(), F.col("k2")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce(size, F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of fully tied rows one. Rows are told apart by doc_id, and by a key of their
    own where doc_ids are null or repeated; a text is hashed once, and what goes is taken away by key."""
    rows = keyed(docs)
    if rows is None:
        gone = exact_dedup(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
    sig = materialize(signatures(rows.select(F.struct("_key", F.col("_row.doc_id").alias("own")).alias("doc_id"), F.col("_row.text").alias("text"))), "signatures")
    key = ["len", "head", "sha"]
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id.own").isNull().alias("none"), F.col("doc_id.own").alias("id"), F.col("doc_id._key").alias("k"))
    left = materialize(_shared(_shared(sig, ["len"]), ["len", "head"]).select(*key, order.alias("o")), "shared")
    # Of each group all go but the first; the greater ones are found by a join with one row a group, split where it is skewed.
    first = left.groupBy(*key).agg(F.min("o").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, "best")
    gone = left.join(first, key).where(F.col("o.k") != F.col("best.k")).select(F.col("o.k").alias("_key"))
    return rows.join(gone, "_key", "left_anti").select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, arg_min(doc_id, {'p': -points, 'i': doc_id}) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
