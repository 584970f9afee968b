"""Page triage: signals of a page, its route, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["doc_id", "page"]


def route(pages: DataFrame) -> DataFrame:
    """Adds route, needs_vision and reason to pages with chars, blocks, images, image_ratio, lines and cols; first match wins."""
    chars, blocks, images, ratio, lines, cols = (F.col(x) for x in ("chars", "blocks", "images", "image_ratio", "lines", "cols"))
    scan = (chars < 30) & (ratio > 0.55)
    empty = (chars < 15) & (blocks == 0)
    table = (lines >= 8) & (chars < 4000)
    mixed = (ratio > 0.18) | (cols > 1) | ((images > 0) & (blocks > 0))
    figure = (ratio > 0.45) & (chars < 400)
    out = F.when(scan | empty, "scanned").when(table, "table").when(mixed, "mixed").otherwise("text")
    vision = F.when(scan | empty, True).when(table, False).when(mixed, figure).otherwise(False)
    # The reasons are output.
    said = F.concat(F.lit("text + "), images.cast("string"), F.lit(" image(s) ("), F.format_string("%.0f", ratio * 100), F.lit("% area)"), F.when(cols > 1, ", multi-column").otherwise(""), F.when(figure, " — sparse text over large figure, vision recommended").otherwise(""))
    reason = (
        F.when(scan, "almost no text layer but page is mostly a raster image — likely scanned/figure page")
        .when(empty, "empty text layer — needs OCR/vision")
        .when(table, F.concat(lines.cast("string"), F.lit(" ruled strokes detected — table-dominant page")))
        .when(mixed, said)
        .otherwise("clean text layer, simple layout")
    )
    return pages.withColumns({"route": out, "needs_vision": vision, "reason": reason})


def totals(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("needs_vision").cast("int")).alias("vision"))


def image_area(rects: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct placements (by rounded corners) and the share of the page that they cover, one at most."""
    corners = [F.bround(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")]
    one = rects.select("*", *corners).dropDuplicates([*KEYS, "rx0", "ry0", "rx1", "ry1"])
    size = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    found = one.groupBy(*KEYS).agg(size.alias("area"), F.count(F.lit(1)).alias("n"))
    whole = F.col("width") * F.col("height")
    return pages.join(found, KEYS, "left").select(*KEYS, F.coalesce("n", F.lit(0)).alias("images"), F.least(F.coalesce(F.col("area") / whole, F.lit(0.0)), F.lit(1.0)).alias("image_ratio"))


def line_score(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Strokes and cell-like boxes that hint at a ruled table."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    pw, ph = F.col("width"), F.col("height")
    line = ((h < 2) & (w >= 0.20 * pw)) | ((w < 2) & (h >= 0.10 * ph))
    box = ((w >= 0.20 * pw) & (h < 2)) | ((h >= 0.10 * ph) & (w < 2)) | ((w >= 0.06 * pw) & (h >= 4) & (h <= 0.25 * ph))
    hit: Column = F.when(F.col("kind") == "l", line).otherwise(box)
    return drawings.join(pages, KEYS).groupBy(*KEYS).agg(F.sum(hit.cast("long")).alias("score"))


def columns(blocks: DataFrame) -> DataFrame:
    """Two columns where text blocks stand left and right of the middle and few straddle it, else one."""
    mid = (F.min("x0") + F.max("x1")) / 2
    span = F.max("x1") - F.min("x0")
    page = blocks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), mid.alias("mid"), span.alias("span"))
    centre = (F.col("x0") + F.col("x1")) / 2
    left, right = centre < F.col("mid") - 0.02 * F.col("span"), centre > F.col("mid") + 0.02 * F.col("span")
    side = blocks.join(page, KEYS).groupBy(*KEYS, "n").agg(F.sum(left.cast("int")).alias("l"), F.sum(right.cast("int")).alias("r"), F.sum((~left & ~right).cast("int")).alias("s"))
    two = (F.col("n") >= 6) & (F.col("l") >= 3) & (F.col("r") >= 3) & (F.col("l") + F.col("r") >= 0.7 * F.col("n")) & (F.col("s") <= 0.3 * F.col("n"))
    return side.select(*KEYS, F.when(two, 2).otherwise(1).alias("cols"))
