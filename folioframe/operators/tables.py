"""Tables: regions of a sheet, header rows, merged cells, dense grids, references and charts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1_ref, looks_numeric, strip


def region_of(cells: DataFrame) -> DataFrame:
    """Rows (sheet, region, min_row, min_col, max_row, max_col) of populated cells, cut until no region has an empty row or
    column; ``region`` counts a sheet's in reading order, from 0."""
    from . import sheets

    return sheets.numbered(sheets.boxes(sheets.in_regions(cells, ("sheet",)), ("sheet",)), ("sheet",)).drop("cells", "path")


def regions(cells: DataFrame) -> DataFrame:
    """Rectangles (sheet, min_row, min_col, max_row, max_col, ref, cells) that empty rows and columns separate."""
    from . import sheets

    box = sheets.boxes(sheets.in_regions(cells, ("sheet",)), ("sheet",)).drop("path")
    return box.withColumn("ref", a1_ref(F.col("min_row"), F.col("min_col"), F.col("max_row"), F.col("max_col")))


def region_merges(merges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Merged ranges (sheet, r0, c0, r1, c1) with the region that holds them as a whole, from 0 within it."""
    from . import sheets

    size = [(F.col("r0") - F.col("min_row")).alias("row"), (F.col("c0") - F.col("min_col")).alias("col"), (F.col("r1") - F.col("r0") + 1).alias("rowspan"), (F.col("c1") - F.col("c0") + 1).alias("colspan")]
    return sheets.merges_within(merges, boxes, ("sheet",)).select("sheet", "min_row", "min_col", "max_row", "max_col", *size)


def row_facts(filled: Column, number: Column) -> list[Column]:
    """What a row of cells tells about headers: filled cells, labels and numbers among them, its first and last column."""
    sums = [F.sum(c.cast("int")).alias(n) for c, n in ((filled, "n"), (filled & ~number, "labels"), (filled & number, "numbers"))]
    return [*sums, F.min("col").alias("a"), F.max("col").alias("b"), F.min_by(F.struct(filled.alias("is"), number.alias("num")), "col").alias("first")]


def with_header(rows: DataFrame, by: list[str], depth: int = 5) -> DataFrame:
    """Adds to the rows of each region (``row_facts``) its header row, and whether it is sure: labels over numbers within the
    first rows, or a full first row over a column of labels."""
    region, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("row")
    row = rows.withColumns({"_r0": F.min("row").over(region), "_r1": F.max("row").over(region), "_c0": F.min("a").over(region), "_c1": F.max("b").over(region)})
    below = (F.lead("row").over(order) == F.col("row") + 1) & (F.lead("n").over(order) > 0) & (F.lead("numbers").over(order) >= 0.4 * F.lead("n").over(order))
    lower = (F.col("row") > F.col("_r0")) & (F.col("a") == F.col("_c0")) & F.col("first")["is"]
    row = row.withColumns({"_below": F.coalesce(below, F.lit(False)), "_fn": F.sum(lower.cast("int")).over(region), "_fl": F.sum((lower & ~F.col("first")["num"]).cast("int")).over(region)})
    over_numbers = (F.col("labels") >= 0.6 * F.col("n")) & F.col("_below")
    full = (F.col("row") == F.col("_r0")) & (F.col("n") == F.col("_c1") - F.col("_c0") + 1) & (F.col("_r1") - F.col("_r0") >= 2) & (F.col("_fn") > 0) & (F.col("_fl") >= 0.6 * F.col("_fn"))
    hit = (F.col("n") > 0) & (F.col("row") < F.least(F.col("_r0") + depth, F.col("_r1"))) & (over_numbers | full)
    row = row.withColumn("_hit", F.min(F.when(hit, F.col("row"))).over(region))
    return row.withColumns({"header": F.coalesce("_hit", "_r0"), "sure": F.col("_hit").isNotNull()}).drop("_r0", "_r1", "_c0", "_c1", "_below", "_fn", "_fl", "_hit", "first", "n", "labels", "numbers", "a", "b")


def header_rows(cells: DataFrame, depth: int = 5) -> DataFrame:
    """The header row of each region of cells (region, row, col, text), and whether it is sure."""
    row = cells.groupBy("region", "row").agg(*row_facts(strip(F.col("text")) != "", looks_numeric(F.col("text"))))
    return with_header(row, ["region"], depth).groupBy("region").agg(F.min("header").alias("header_row"), F.max("sure").alias("confident"))


def column_starts(cells: DataFrame) -> DataFrame:
    """Adds col: where a cell begins, after the grid spans of those before it in its row."""
    w = Window.partitionBy("table_id", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("col", F.sum("gridspan").over(w) - F.col("gridspan"))


def vertical_spans(cells: DataFrame) -> DataFrame:
    """Spans (table_id, row, col, rowspan) of restart cells and the continue cells that follow the latest of them in a
    column; a restart alone is a span of one, a continue without any is none."""
    w = Window.partitionBy("table_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anchored = cells.withColumn("anchor", F.last(F.when(F.col("vmerge") == "restart", F.col("row")), ignorenulls=True).over(w))
    kept = anchored.where(F.col("vmerge").isNotNull() & F.col("anchor").isNotNull())
    return kept.groupBy("table_id", "col", "anchor").agg(F.count(F.lit(1)).alias("rowspan")).select("table_id", F.col("anchor").alias("row"), "col", "rowspan")


def filled(items: Column, at: str, size: Column, blank: Column, value: str) -> Column:
    """``value`` of sorted structs at their places among ``size`` many, and blanks between."""
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(items, i - 1)[at])
    held = F.flatten(F.transform(items, lambda x, i: F.concat(F.array_repeat(blank, x[at] - before(i) - 1), F.array(x[value]))))
    return F.concat(held, F.array_repeat(blank, size - F.element_at(items, -1)[at] - 1))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, wherever lambdas look into it: as the one element of a list."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gathered(cells: DataFrame, *sizes: Column) -> DataFrame:
    """One row for each table: its cells as a list, and ``sizes``, aggregates over them."""
    kept = F.struct("row", "col", "rowspan", "colspan", "text", F.col("cell").cast("int").alias("cell"))
    return cells.groupBy("table_id").agg(F.collect_list(kept).alias("cells"), *sizes)


def grids(whole: DataFrame, expand: str = "blank") -> DataFrame:
    """(table_id, rows) of tables (table_id, nrows, ncols, cells): all places with their texts; covered places are blank or repeat it
    (``duplicate``). Of cells in one place the later stays.

    A table is filled within its row, by one sort of the places that its cells cover; no place becomes a row of its own."""
    nrows, ncols, none = F.col("nrows"), F.col("ncols"), F.array().cast("array<int>")
    upto = lambda first, end: F.when(end > first, F.sequence(first.cast("int"), (end - 1).cast("int"))).otherwise(none)

    def covered(x: Column) -> Column:
        text = lambda r, c: x["text"] if expand == "duplicate" else F.when((r == x["row"]) & (c == x["col"]), x["text"]).otherwise("")
        across = upto(F.greatest(x["col"], F.lit(0)), F.least(x["col"] + x["colspan"], ncols))
        down = upto(F.greatest(x["row"], F.lit(0)), F.least(x["row"] + x["rowspan"], nrows))
        place = lambda r, c: F.struct((r * ncols + c).cast("int").alias("at"), x["cell"].alias("cell"), text(r, c).alias("text"))
        return F.flatten(F.transform(down, lambda r: F.transform(across, lambda c: place(r, c))))

    # Bound one after the other: lambdas, and filters that are pushed below, would make named columns anew for each element.
    last = lambda every: F.filter(every, lambda x, i: F.coalesce(F.get(every, i + 1)["at"] != x["at"], F.lit(True)))
    n = (nrows * ncols).cast("int")
    texts = lambda own: F.when(F.size(own) > 0, filled(own, "at", n, F.lit(""), "text")).otherwise(F.array_repeat(F.lit(""), n))
    cut = lambda texts: F.transform(upto(F.lit(0), nrows), lambda r: F.slice(texts, (r * ncols + 1).cast("int"), ncols.cast("int")))
    every = F.sort_array(F.flatten(F.transform("cells", covered)))
    rows = once(every, lambda e: once(last(e), lambda own: once(texts(own), cut)))
    return whole.where("nrows > 0 and ncols > 0").select("table_id", rows.alias("rows"))


def places(whole: DataFrame) -> DataFrame:
    """(table_id, row, col, text) of tables (table_id, rows)."""
    line = whole.select("table_id", F.posexplode_outer("rows").alias("row", "_line"))
    return line.select("table_id", "row", F.posexplode_outer("_line").alias("col", "text"))


def dense_grid(cells: DataFrame, tables: DataFrame, expand: str = "blank") -> DataFrame:
    """Every (table_id, row, col) of nrows x ncols with its text; covered places are blank or repeat it (``duplicate``)."""
    return places(grids(tables.select("table_id", "nrows", "ncols").join(gathered(cells), "table_id", "left"), expand))


def best_table(cells: DataFrame) -> DataFrame:
    """Of each page's candidate tables (page, table, row, col, text) the one with most filled cells, the first of ties;
    a candidate needs two rows, two columns and a row with two filled cells."""
    filled = (strip(F.coalesce("text", F.lit(""))) != "").cast("int")
    row = cells.groupBy("page", "table", "row").agg(F.count(F.lit(1)).alias("w"), F.sum(filled).alias("f"))
    table = row.groupBy("page", "table").agg(F.count(F.lit(1)).alias("nrows"), F.max("w").alias("ncols"), F.max("f").alias("full"), F.sum("f").alias("filled"))
    real = table.where("nrows >= 2 and ncols >= 2 and full >= 2")
    best = F.max_by(F.struct("table", "nrows", "ncols", "filled"), F.struct("filled", (-F.col("table")).alias("t"))).alias("b")
    return real.groupBy("page").agg(best).select("page", "b.*")


#: Rows of cells that share a join key where references meet them, and the most rows that a sheet can have.
BAND, MOST_ROWS = 1024, 1 << 20


def resolved(refs: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """The values that A1 references ('Sheet'!$A$1:$B$2) of ``refs`` (by, ref) find in ``cells`` (by, sheet, row, col, text), row
    by row: by, ref, values; a reference that finds nothing has no row.

    References meet cells by bands of rows, of which a sheet has MOST_ROWS / BAND at most."""
    pattern = r"^(?:'((?:[^']|'')+)'|([^'!]+))!\$?([A-Z]{1,3})\$?(\d+)(?::\$?([A-Z]{1,3})\$?(\d+))?$"

    found = refs.where(F.col("ref").rlike(pattern))
    part = lambda k: F.regexp_extract("ref", pattern, k)
    or_ = lambda a, b: F.when(a == "", b).otherwise(a)
    parts = found.select(*by, "ref", F.replace(or_(part(1), part(2)), F.lit("''"), F.lit("'")).alias("sheet"), F.lpad(part(3), 3, "@").alias("la"), part(4).alias("na"), F.lpad(or_(part(5), part(3)), 3, "@").alias("lb"), or_(part(6), part(4)).alias("nb"))
    letter = lambda c, k: F.ascii(F.substring(c, k, 1)) - 64  # noqa: E731; @ comes before A
    col = lambda c: letter(c, 1) * 676 + letter(c, 2) * 26 + letter(c, 3)
    row = lambda c: F.least(c.cast("decimal(38,0)"), F.lit(MOST_ROWS)).cast("int")
    ca, cb, ra, rb = col("la"), col("lb"), row(F.col("na")), row(F.col("nb"))
    # As one generated row: filters that the join brings about then stay above the parsing, which would run again in each.
    bounds = F.struct("sheet", F.least(ca, cb).alias("c0"), F.greatest(ca, cb).alias("c1"), F.least(ra, rb).alias("r0"), F.greatest(ra, rb).alias("r1"))
    parsed = parts.select(*by, "ref", F.inline(F.array(bounds)))
    asked = parsed.select("*", F.explode(F.sequence(F.floor(F.col("r0") / BAND), F.floor(F.col("r1") / BAND))).alias("_band"))
    there = cells.select(*by, "sheet", "row", "col", "text").withColumn("_band", F.floor(F.col("row") / BAND))
    hit = asked.join(there, [*by, "sheet", "_band"]).where("row between r0 and r1 and col between c0 and c1")
    listed = hit.groupBy(*by, "ref").agg(F.array_sort(F.collect_list(F.struct("row", "col", "text"))).alias("v"))
    return listed.select(*by, "ref", F.transform("v", lambda x: x["text"]).alias("values"))


def resolve_refs(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """Values of the references (ref_id, ref) as one text, joined by ``|``; null where nothing is found."""
    hit = resolved(refs.select("ref").distinct(), cells, [])
    return refs.join(hit, "ref", "left").select("ref_id", "ref", F.array_join("values", "|").alias("values"))


def chart_series(points: DataFrame) -> DataFrame:
    """One row per series (chart, series) with its categories and values in order; points without a value are left out,
    so later values move up."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "category", "value")))
    s = points.groupBy("chart", "series").agg(ordered.alias("p"))
    return s.select("chart", "series", F.array_join(F.transform("p", lambda x: x["category"]), ",").alias("categories"), F.array_join(F.transform(F.filter("p", lambda x: x["value"].isNotNull()), lambda x: x["value"].cast("string")), ",").alias("values"))
