"""Pages of a PDF as elements: triage, ruled tables, text in reading order, images, all over atom tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean, strip
from . import layout, triage

KEYS = ["doc_id", "page"]
#: Lines this near, in points, are one line.
SNAP = 3.0
#: Stretches of a text row that are farther apart, in points, may be cells.
WIDE = 10.0
#: A page's tables are looked for from this line score on; images cover this share of their page.
RULED, IMAGE_SHARE = 4, 0.03


def _bands(edges: DataFrame, number: str, low: str, high: str) -> DataFrame:
    """Neighbouring lines of a page: number of the first, both places, and the stretches that are drawn on each. Edges no
    farther than SNAP from the one before lie on one line."""
    w = Window.partitionBy(*KEYS).orderBy("at")
    new = (F.col("at") - F.lag("at").over(w) > SNAP).cast("int")
    numbered = edges.withColumn("k", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    line = numbered.groupBy(*KEYS, "k").agg(F.avg("at").alias("c"), F.collect_list(F.struct("a", "b")).alias("drawn"))
    order = Window.partitionBy(*KEYS).orderBy("k")
    both = line.select(*KEYS, F.col("k").cast("int").alias(number), F.col("c").alias(low), F.lead("c").over(order).alias(high), F.col("drawn").alias(f"{number}_first"), F.lead("drawn").over(order).alias(f"{number}_last"))
    return both.where(F.col(high).isNotNull())


def _units(drawings: DataFrame) -> DataFrame:
    """The places between neighbouring lines of a page (row, col and box), and which of their sides are drawn."""
    edge = "struct<horizontal:boolean,at:double,a:double,b:double>"
    x0, x1, y0, y1 = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    one = lambda horizontal, at, a, b: F.struct(F.lit(horizontal).alias("horizontal"), at.alias("at"), a.alias("a"), b.alias("b")).cast(edge)
    flat, upright = y1 - y0 < 2, x1 - x0 < 2
    box = F.array(one(True, y0, x0, x1), one(True, y1, x0, x1), one(False, x0, y0, y1), one(False, x1, y0, y1))
    found = F.when(flat, F.array(one(True, (y0 + y1) / 2, x0, x1))).when(upright, F.array(one(False, (x0 + x1) / 2, y0, y1))).when(F.col("kind") == "re", box)
    edges = drawings.select(*KEYS, F.explode(found).alias("e")).select(*KEYS, "e.*")
    cell = _bands(edges.where("horizontal"), "row", "y0", "y1").join(_bands(edges.where("not horizontal"), "col", "x0", "x1"), KEYS)
    covers = lambda drawn, a, b: F.exists(drawn, lambda e: (e["a"] <= F.col(a) + SNAP) & (e["b"] >= F.col(b) - SNAP))
    sides = {"top": ("row_first", "x0", "x1"), "bottom": ("row_last", "x0", "x1"), "left": ("col_first", "y0", "y1"), "right": ("col_last", "y0", "y1")}
    return cell.select(*KEYS, "row", "col", "x0", "y0", "x1", "y1", *[covers(*of).alias(side) for side, of in sides.items()])


def ruled_cells(drawings: DataFrame) -> DataFrame:
    """Cells (doc_id, page, grid, row, col, x0, y0, x1, y1) that drawn lines and boxes close on all four sides. Rows of
    cells that follow each other without a gap are one grid."""
    cell = _units(drawings).where(F.col("top") & F.col("bottom") & F.col("left") & F.col("right")).select(*KEYS, "row", "col", "x0", "y0", "x1", "y1")
    return cell.withColumn("grid", F.col("row") - F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("row")))


def ruled_spans(drawings: DataFrame) -> DataFrame:
    """Cells (doc_id, page, grid, row, col, rowspan, colspan, x0, y0, x1, y1) that drawn lines close, merged ones as well: places of a
    row without a line between them are a run, and runs of the same columns without a line between them are a cell, which counts
    if all of its border is drawn. What isn't a rectangle has no whole border, so none of it is a cell. Rows that follow each
    other, or that a cell reaches over, are one grid."""
    place = _units(drawings)
    run = F.sum(F.col("left").cast("int")).over(Window.partitionBy(*KEYS, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    runs = place.withColumn("_run", run).groupBy(*KEYS, "row", "_run").agg(
        F.min("col").alias("col"), F.count(F.lit(1)).cast("int").alias("colspan"), *box, F.bool_or("top").alias("cut"), F.bool_and("top").alias("top"),
        F.bool_and("bottom").alias("bottom"), F.min_by("left", "col").alias("left"), F.max_by("right", "col").alias("right"),
    )
    by = [*KEYS, "col", "colspan"]
    order = Window.partitionBy(*by).orderBy("row")
    apart = F.col("cut") | ~(F.lag("row").over(order).eqNullSafe(F.col("row") - 1))
    whole = runs.withColumn("_new", apart.cast("int")).withColumn("_cell", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cell = whole.groupBy(*by, "_cell").agg(
        F.min_by("top", "row").alias("top"), F.max_by("bottom", "row").alias("bottom"), F.bool_and("left").alias("left"), F.bool_and("right").alias("right"), F.min("row").alias("row"), F.count(F.lit(1)).cast("int").alias("rowspan"), *box,
    )
    cell = cell.where(F.col("top") & F.col("bottom") & F.col("left") & F.col("right"))
    page = Window.partitionBy(*KEYS).orderBy("row", "col")
    reached = F.max(F.col("row") + F.col("rowspan")).over(page.rowsBetween(Window.unboundedPreceding, -1))
    cell = cell.withColumn("_gap", F.coalesce((F.col("row") > reached).cast("int"), F.lit(0)))
    grid = F.sum("_gap").over(page.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    return cell.withColumn("grid", grid).select(*KEYS, "grid", "row", "col", "rowspan", "colspan", "x0", "y0", "x1", "y1")


def lattice_boxes(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes (doc_id, page, table, x0, y0, x1, y1) of tables whose cells are given from the bottom left of the media box,
    from its top left instead."""
    box = cells.groupBy(*KEYS, "table").agg(F.min("x0").alias("x0"), F.max("y1").alias("top"), F.max("x1").alias("x1"), F.min("y0").alias("bottom"))
    flip = lambda c: F.round(F.col("height") - F.col(c), 1)
    return box.join(pages.select(*KEYS, "height"), KEYS).select(*KEYS, "table", F.round("x0", 1).alias("x0"), flip("top").alias("y0"), F.round("x1", 1).alias("x1"), flip("bottom").alias("y1"))


def ruled_tables(drawings: DataFrame, spans: DataFrame) -> DataFrame:
    """At most one table a page (doc_id, page, rows, x0, y0, x1, y1): of the grids with two rows, two columns and a row with
    two filled cells the one with most filled cells, the upper one of ties; without empty rows. A merged cell's text is in its first
    place, the others are blank."""
    cells = ruled_spans(drawings).alias("c")
    s = spans.select(*KEYS, "block", "line", "span", "text", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy")).alias("s")
    inside = (F.col("s.doc_id") == F.col("c.doc_id")) & (F.col("s.page") == F.col("c.page")) & (F.col("cx") >= F.col("x0")) & (F.col("cx") < F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") < F.col("y1"))
    words = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("block", "line", "span", "text"))))
    filled = cells.join(s, inside, "left").groupBy("c.doc_id", "c.page", "grid", "row", "col", "x0", "y0", "x1", "y1").agg(clean(F.array_join(F.transform(words, lambda x: x["text"]), " ")).alias("text"))
    grid, row = Window.partitionBy(*KEYS, "grid"), Window.partitionBy(*KEYS, "grid", "row")
    full = (F.col("text") != "").cast("int")
    filled = filled.withColumns({"wide": F.count(F.lit(1)).over(row), "busy": F.sum(full).over(row), "score": F.sum(full).over(grid)})
    # Empty rows go; columns are those of the whole grid
    filled = filled.withColumns({"cols": F.array_sort(F.collect_set("col").over(grid)), **{f"t{n}": F.round(f(n).over(grid), 1) for f, n in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))}})
    corners = ["tx0", "ty0", "tx1", "ty1"]
    line = filled.where("busy > 0").groupBy(*KEYS, "grid", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), *[F.first(c).alias(c) for c in ("cols", "wide", "busy", "score", *corners)])
    line = line.withColumn("cells", F.transform("cols", lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))))
    table = line.groupBy(*KEYS, "grid").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"), F.max("wide").alias("wide"), F.max("busy").alias("busy"), F.first("score").alias("score"), *[F.first(c).alias(c[1:]) for c in corners])
    real = table.where((F.size("rows") >= 2) & (F.col("wide") >= 2) & (F.col("busy") >= 2))
    best = F.max_by(F.struct("rows", "x0", "y0", "x1", "y1"), F.struct("score", -F.col("y0"))).alias("t")
    return real.groupBy(*KEYS).agg(best).select(*KEYS, "t.*")


def aligned_cells(spans: DataFrame) -> DataFrame:
    """Cells (doc_id, page, table, row, col, text, x0, y0, x1, y1) of tables that only the place of their text makes: rows that follow each
    other, each of two stretches or more with WIDE points between, two rows at least; columns are what the gaps in the union of all stretches
    of a table part, two at least. Blank spans count for nothing.

    Sweeps by running maximum find rows, stretches and columns; all of them are dealt by page."""
    nth = ["block", "line", "span"]
    word = spans.where(strip(F.coalesce("text", F.lit(""))) != "").select(*KEYS, *nth, "text", "x0", "y0", "x1", "y1", ((F.col("y0") + F.col("y1")) / 2).alias("_cy"))

    def swept(rows: DataFrame, name: str, by: list[str], order: list[str], start: str, end: str, gap: float) -> DataFrame:
        """Numbers, from 0, of stretches that are more than ``gap`` apart."""
        w = Window.partitionBy(*KEYS, *by).orderBy(*order, *nth)
        apart = F.col(start) > F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)) + gap
        return rows.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(0))).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_new")

    row = swept(swept(word, "row", [], ["_cy", "x0"], "_cy", "y1", 0.0), "_part", ["row"], ["x0"], "x0", "x1", WIDE)
    row = row.withColumn("_parts", F.max("_part").over(Window.partitionBy(*KEYS, "row"))).where("_parts > 0")
    held = row.withColumn("_run", F.col("row") - F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("row")))
    run = Window.partitionBy(*KEYS, "_run")
    held = held.withColumns({"_first": F.min("row").over(run), "_last": F.max("row").over(run)}).where("_last > _first")
    held = swept(held, "col", ["_run"], ["x0"], "x0", "x1", SNAP)
    held = held.withColumn("_cols", F.max("col").over(run)).where("_cols > 0")
    held = held.withColumns({"table": F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("_run")) - 1, "row": F.col("row") - F.col("_first")})
    said = F.transform(F.array_sort(F.collect_list(F.struct("x0", *nth, "text"))), lambda x: x["text"])
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return held.groupBy(*KEYS, "table", "row", "col").agg(clean(F.array_join(said, " ")).alias("text"), *box)


def aligned_tables(spans: DataFrame) -> DataFrame:
    """At most one table a page (doc_id, page, rows, x0, y0, x1, y1) of ``aligned_cells``: of those that have a row with two filled cells
    the one with most filled cells, the upper one of ties."""
    cell = aligned_cells(spans)
    cell = cell.withColumn("_cols", F.max("col").over(Window.partitionBy(*KEYS, "table")))
    box = [(F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1")]
    line = cell.groupBy(*KEYS, "table", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.first("_cols").alias("_cols"), F.count(F.lit(1)).alias("n"), *[f(c).alias(c) for f, c in box])
    line = line.withColumn("cells", F.transform(F.sequence(F.lit(0), "_cols"), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))))
    table = line.groupBy(*KEYS, "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"), F.max("n").alias("busy"), F.sum("n").alias("score"), *[F.round(f(c), 1).alias(c) for f, c in box])
    best = F.max_by(F.struct("rows", "x0", "y0", "x1", "y1"), F.struct("score", -F.col("table"))).alias("t")
    return table.where("busy > 1").groupBy(*KEYS).agg(best).select(*KEYS, "t.*")


def _box() -> Column:
    return F.struct(*[F.round(F.col(c).cast("double"), 1).alias(c) for c in ("x0", "y0", "x1", "y1")])


def signals(pages: DataFrame, spans: DataFrame, drawings: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with chars, blocks, images, image_ratio, lines, cols, and their route."""
    block = spans.groupBy(*KEYS, "block").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "span", "text"))), lambda x: x["text"]), "").alias("text"))
    text = block.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("blocks"), F.length(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n"))).alias("chars"))
    out = pages.select(*KEYS, "width", "height").join(text, KEYS, "left").join(triage.image_area(images, pages), KEYS, "left")
    out = out.join(triage.line_score(drawings, pages).withColumnRenamed("score", "lines"), KEYS, "left").join(triage.columns(block), KEYS, "left")
    return triage.route(out.fillna({"blocks": 0, "chars": 0, "images": 0, "image_ratio": 0.0, "lines": 0, "cols": 1}))


def elements(pages: DataFrame, spans: DataFrame, drawings: DataFrame, images: DataFrame) -> DataFrame:
    """Unit and element rows (of ``schema.ELEMENTS``, those that a page can have) in document order."""
    routed = signals(pages, spans, drawings, images).persist()  # a row a page, read by several steps
    sizes = layout.body_size(spans.withColumn("span", F.struct("block", "line", "span")), KEYS)
    box = spans.groupBy(*KEYS, "block").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    block = layout.block_text(spans).withColumn("text", strip(F.col("text"))).where("text <> ''").join(box, [*KEYS, "block"]).join(routed.select(*KEYS, "cols"), KEYS).join(sizes, KEYS, "left")
    ordered = layout.reading_order(block, F.col("cols"))
    level = layout.heading_level(F.col("size"), F.coalesce("body", F.lit(0.0)), F.col("bold"), F.col("text"))
    texts = ordered.withColumn("level", level).select(*KEYS, "pos", F.when(F.col("level") > 0, "heading").otherwise("paragraph").alias("type"), F.when(F.col("level") > 0, clean(F.col("text"))).otherwise(F.col("text")).alias("text"), F.when(F.col("level") > 0, F.col("level")).alias("level"), "x0", "y0", "x1", "y1")
    asked = routed.where((F.col("route") == "table") | (F.col("lines") >= RULED)).select(*KEYS)
    # Aligned text is a table only where lines make none, and not where the page is set in columns.
    text = spans.join(asked, KEYS, "left_semi")
    ruled = ruled_tables(drawings.join(asked, KEYS, "left_semi"), text)
    aligned = aligned_tables(text.join(routed.where("cols = 1").select(*KEYS), KEYS, "left_semi"))
    either = ruled.withColumn("_n", F.lit(0)).unionByName(aligned.withColumn("_n", F.lit(1)))
    table = either.groupBy(*KEYS).agg(F.min_by(F.struct("rows", "x0", "y0", "x1", "y1"), "_n").alias("t")).select(*KEYS, "t.*").persist()
    kept = layout.drop_inside(texts, table).select("t.*")
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    first = F.min_by(F.struct("x0", "y0", "x1", "y1"), "ord")
    shown = images.withColumn("area", area).groupBy(*KEYS, "xref").agg(F.max("area").alias("area"), F.min("ord").alias("ord"), first.alias("at"))
    shown = shown.join(pages.select(*KEYS, (F.col("width") * F.col("height")).alias("whole")), KEYS).where(F.col("area") >= IMAGE_SHARE * F.col("whole"))
    nth = F.row_number().over(Window.partitionBy(*KEYS).orderBy("ord")) - 1
    pictures = shown.withColumn("nth", nth).select(*KEYS, F.concat(F.lit("p"), F.col("page"), F.lit("_img"), F.col("nth"), F.lit(".png")).alias("path"), "ord", "at.*")
    note, none = F.lit("auto-detected"), F.lit(None)
    others = table.select(*KEYS, F.lit("table").alias("type"), "rows", note.alias("note"), none.cast("string").alias("path"), F.lit(-1).alias("n"), "x0", "y0", "x1", "y1").unionByName(
        pictures.select(*KEYS, F.lit("image").alias("type"), none.cast("array<array<string>>").alias("rows"), none.cast("string").alias("note"), "path", F.col("ord").alias("n"), "x0", "y0", "x1", "y1")
    )
    others = others.withColumn("ord", F.row_number().over(Window.partitionBy(*KEYS).orderBy("n")) - 1)
    shown = ["type", "text", "level", "note", "path", "rows"]
    whole = lambda x: F.struct(*[(F.col(c) if c in x.columns else none.cast(t)).alias(c) for c, t in zip(shown, ("string", "string", "int", "string", "string", "array<array<string>>"), strict=True)], _box().alias("bbox")).alias("whole")
    placed = layout.interleave(kept.select(*KEYS, "pos", F.col("y0").alias("top"), whole(kept)), others.select(*KEYS, "ord", F.col("y0").alias("top"), whole(others)), ["whole"])
    body = placed.select(*KEYS, (F.col("nth") + 1).alias("elem_no"), "whole.*")
    props = F.create_map(*[x for k, c in (("route", F.col("route")), ("needs_vision", F.col("needs_vision").cast("string")), ("reason", F.col("reason")), ("width", F.col("width").cast("string")), ("height", F.col("height").cast("string"))) for x in (F.lit(k), c)])
    unit = routed.select(*KEYS, F.lit("unit").alias("type"), F.lit(0).alias("elem_no"), props.alias("props"))
    out = body.select(*KEYS, "elem_no", "type", "text", "level", "note", "path", "bbox", "rows").unionByName(unit, allowMissingColumns=True)
    return out.withColumnRenamed("page", "unit_no").withColumn("format", F.lit("pdf"))
