"""Confidence: conditions raise flags and cap the score; documents roll up their units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (condition column, flag, cap) in order of emission; fixed values.
SHEET = [
    ("many_tables", "multiple-table-regions", 0.80),
    ("merged", "merged-cells", 0.75),
    ("ambiguous", "header-ambiguous", 0.70),
    ("formula", "formula-cells", 0.85),
    ("no_cache", "formula-no-cache", 0.65),
    ("empty", "empty-sheet", 0.50),
]
DOCX = [
    ("textbox", "textbox-content", 0.80),
    ("merged", "merged-cells", 0.80),
    ("nested", "nested-table", 0.75),
    ("images", "embedded-images-not-extracted", 0.85),
    ("vision", "needs-vision", 0.40),
    ("tracked", "tracked-changes-present", 0.65),
    ("comments", "comments-present", 0.85),
]
SLIDE = [
    ("merged", "table-merged-cells", 0.80),
    ("chart", "has-chart", 1.0),
    ("overlap", "overlapping-shapes-order-ambiguous", 0.70),
    ("grouped", "grouped-shapes", 0.85),
    ("image_only", "image-only-slide", 0.40),
    ("image_only", "needs-vision", 0.40),
    ("empty", "empty-slide", 0.50),
]
#: A unit is to be verified strictly below this.
VERIFY = 0.75


def judge(units: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Adds flags (array) and confidence."""
    flags: Column = F.array_compact(F.array(*[F.when(F.col(c), flag) for c, flag, _ in rules]))
    confidence = F.least(F.lit(1.0), *[F.when(F.col(c), F.lit(cap)).otherwise(1.0) for c, _, cap in rules])
    return units.withColumns({"flags": flags, "confidence": confidence})


def rollup(units: DataFrame) -> DataFrame:
    """Per document: units, the least confidence, and the units to verify in order."""
    low = F.array_sort(F.collect_list(F.when(F.col("confidence") < VERIFY, F.struct("unit_no", "unit"))))
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.min("confidence").alias("min_confidence"), F.transform(low, lambda x: x["unit"]).alias("verify"))
