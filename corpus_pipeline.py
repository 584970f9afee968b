"""A training-corpus pipeline: STAGES run one after the other, each stored as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
``documents``, but for the last, which returns packed pieces. Clean documents pass all filters.

Cases, in every stage: a null text counts as empty; empty texts are clean, equal to each other, near copies of nothing, and
one piece each; texts of any length are read whole; of tied or repeated rows one stays; rows without a doc_id are rows like any
other and lose ties against those that have one; null lang or source change nothing; no documents give none; other
columns, whatever their names, stay with their rows up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from folioframe.llm._runtime import Scratch, discard, keyed, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of one half or more go; the model learns from labelled documents of ``docs``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the least doc_id stays, and one without a doc_id only if none has one;
    rows without words stay. Rows are told apart even where doc_ids are null or repeated."""
    rows = keyed(docs)
    if rows is None:
        gone = jaccard_join.jaccard_classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    kept = jaccard_join.row_classes(rows).groupBy("component").agg(F.min(order).alias("first")).select(F.col("first._key").alias("_key"))
    return rows.join(kept, "_key", "left_semi").select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Toxicity, near copies and packing have no SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has stored for itself, and its input, go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scratch() as own:
            kept = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        own.release(spark, kept)
        discard(docs)
        docs = kept
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
