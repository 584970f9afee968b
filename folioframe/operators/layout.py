"""Reading order, headings and geometry over text blocks of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strip

KEYS = ["doc_id", "page"]


def reading_order(blocks: DataFrame, cols: Column | int = 1) -> DataFrame:
    """Adds pos, from 0. One column: by line of three points, then x; two: the left by y, then the right."""
    cols = F.lit(cols) if isinstance(cols, int) else cols
    page = Window.partitionBy(*KEYS)
    mid = (F.min("x0").over(page) + F.max("x1").over(page)) / 2
    right = F.when(cols > 1, ((F.col("x0") + F.col("x1")) / 2 >= mid).cast("int")).otherwise(0)
    first = F.when(cols > 1, F.col("y0").cast("double")).otherwise(F.bround(F.col("y0") / 3))
    second = F.when(cols > 1, F.lit(0.0)).otherwise(F.col("x0").cast("double"))
    keyed = blocks.withColumns({"_side": right, "_a": first, "_b": second})
    return keyed.withColumn("pos", F.row_number().over(page.orderBy("_side", "_a", "_b", "block")) - 1).drop("_side", "_a", "_b")


def body_size(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The most frequent size (one decimal) of non-blank spans of each document (or ``keys``); of ties the one met first."""
    keys = keys or ["doc_id"]
    sized = spans.where(strip(F.col("text")) != "").select(*keys, F.round("size", 1).alias("size"), "span")
    count = sized.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("first"))
    most = count.withColumn("_n", F.max("n").over(Window.partitionBy(*keys))).where("n = _n")
    return most.groupBy(*keys).agg(F.min_by("size", "first").alias("body"))


def heading_level(size: Column, body: Column, bold: Column, text: Column) -> Column:
    """1 to 3, or 0 for a paragraph."""
    large = F.when(size >= 1.8 * body, 1).when(size >= 1.45 * body, 2).otherwise(3)
    short = bold & (size >= 1.1 * body) & (F.length(text) < 80) & ~F.contains(text, F.lit("\n"))
    return F.when((body > 0) & (size >= 1.35 * body), large).when((body > 0) & short, 3).otherwise(0)


def block_text(spans: DataFrame) -> DataFrame:
    """Spans joined to lines and lines to blocks; the largest size; bold if over 60 % of the characters are."""
    line = spans.groupBy(*KEYS, "block", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "").alias("text"),
        F.max("size").alias("size"),
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.when(F.col("bold"), F.length("text")).otherwise(0)).alias("strong"),
    )
    return line.groupBy(*KEYS, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"),
        F.max("size").alias("size"),
        (F.sum("strong") > 0.6 * F.sum("chars")).alias("bold"),
    )


def interleave(texts: DataFrame, objects: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Texts (pos, top) keep their order; each object (top, ord) goes before the first text at or below its top, or to the
    end; of several in one place the lower comes first. Adds nth, from 0. ``carry``: columns of both that stay."""
    carry, far = carry or [], F.lit(2**31 - 1)
    every = texts.select(*KEYS, F.lit("text").alias("kind"), F.col("pos").alias("ord"), "top", F.col("pos").alias("_pos"), *carry).unionByName(
        objects.select(*KEYS, F.lit("object").alias("kind"), "ord", "top", F.lit(None).cast("int").alias("_pos"), *carry)
    )
    # Both windows are dealt by page, so one exchange serves them; peers of a top are in its frame.
    below = F.min("_pos").over(Window.partitionBy(*KEYS).orderBy(F.col("top").desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    text = F.col("kind") == "text"
    slot = F.when(text, F.col("ord")).when(F.col("top").isNull(), far).otherwise(F.coalesce(below, far))
    every = every.withColumns({"_slot": slot, "_t": text.cast("int"), "_y": F.when(text, 0.0).otherwise(-F.col("top").cast("double"))})
    w = Window.partitionBy(*KEYS).orderBy("_slot", "_t", "_y", "ord")
    return every.withColumn("nth", F.row_number().over(w) - 1).select(*KEYS, "kind", "ord", "nth", *carry)


def drop_inside(texts: DataFrame, boxes: DataFrame, slack: float = 2.0) -> DataFrame:
    """Texts whose centre lies in no table box of their page."""
    t, b = texts.alias("t"), boxes.alias("b")
    cx, cy = (F.col("t.x0") + F.col("t.x1")) / 2, (F.col("t.y0") + F.col("t.y1")) / 2
    on = (F.col("t.doc_id") == F.col("b.doc_id")) & (F.col("t.page") == F.col("b.page")) & cx.between(F.col("b.x0") - slack, F.col("b.x1") + slack) & cy.between(F.col("b.y0") - slack, F.col("b.y1") + slack)
    return t.join(b, on, "left_anti")


def shape_order(shapes: DataFrame) -> DataFrame:
    """Adds pos: shapes of a slide from top to bottom, then from left; missing geometry counts as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return shapes.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "slide").orderBy(zero("top"), zero("left"), "z")) - 1)


def overlap(a: Column, b: Column) -> Column:
    """Whether two boxes (structs of top, left, height, width) share an area; a box without a size shares none."""
    met = lambda start, size: F.least(a[start] + a[size], b[start] + b[size]) > F.greatest(a[start], b[start])
    return met("left", "width") & met("top", "height")


def overlaps(shapes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a slide's shapes whose boxes share an area."""
    a, b = shapes.alias("a"), shapes.alias("b")
    box = lambda x: {c: F.col(f"{x}.{c}") for c in ("left", "width", "top", "height")}
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.slide") == F.col("b.slide")) & (F.col("a.z") < F.col("b.z")) & overlap(box("a"), box("b"))
    return a.join(b, on).select(F.col("a.doc_id").alias("doc_id"), F.col("a.slide").alias("slide"), F.col("a.z").alias("a"), F.col("b.z").alias("b"))
