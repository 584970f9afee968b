"""Sheets as ordered elements: cells, merged ranges and chart points in, notes, tables and charts out.

Everything is dealt by sheet: cutting into regions, headers, rows and notes are windows and groups within sheets. Keys ``by``
name a sheet; what one sheet holds is what one file's sheet held. ``parts`` is the number of partitions of every exchange, for
cells and ranges that are dealt by sheet into as many already; without it they are dealt here, and Spark sets the number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import a1_ref, looks_numeric, strip
from . import tables

BY = ("doc_id", "sheet_no")
#: Rows of cells that share a join key where rectangles meet cells.
BAND = 64
#: Times that rows and columns are cut by windows; deeper nests are cut by a kernel, which is exact at any depth.
ROUNDS = 3
#: Notes of tables are output.
NO_CACHE = "contains-formula(no cached values — formulas shown literally; recalc in Excel/LibreOffice)"
CACHED = "contains-formula(cached values shown)"
SPAN = "struct<row:int,col:int,rowspan:int,colspan:int>"


def dealt(rows: DataFrame, keys: tuple[str, ...], parts: int | None) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows.repartition(*keys)


def bands(first: Column, last: Column) -> Column:
    """One row for each band of rows that [first, last] touches."""
    return F.explode(F.sequence(F.floor(first / BAND), F.floor(last / BAND)))


def cut_places(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """A number for each cell, equal within regions: cut at all empty rows, then at all empty columns, and each part again."""
    out, todo, n = np.zeros(len(rows), np.int32), [np.arange(len(rows))], 0
    while todo:
        part = todo.pop()
        for axis in (rows, cols):
            part = part[np.argsort(axis[part], kind="stable")]
            gaps = np.flatnonzero(np.diff(axis[part]) > 1) + 1
            if len(gaps):
                todo += np.split(part, gaps)
                break
        else:
            out[part] = n
            n += 1
    return out


def in_regions(cells: DataFrame, by: tuple[str, ...] = BY, parts: int | None = None) -> DataFrame:
    """Adds ``path``, equal for the cells of one region: no region has an empty row or column. Where cuts are made first doesn't change
    what regions there are, so all empty rows, then all empty columns are cut at once."""
    cells = cells.withColumn("path", F.lit(""))
    cells = cells if parts else dealt(cells, by, None)

    def numbered(axis: str) -> Column:
        return F.col(axis) - F.dense_rank().over(Window.partitionBy(*by, "path").orderBy(axis))

    for axis in ("row", "col") * ROUNDS:
        cells = cells.withColumn("path", F.concat_ws(".", "path", numbered(axis).cast("string")))
    # Columns have been cut last; a region that has no empty row now is whole.
    whole = Window.partitionBy(*by, "path")
    cells = cells.withColumn("_next", numbered("row"))
    cells = cells.withColumn("_open", F.min("_next").over(whole) < F.max("_next").over(whole)).drop("_next")

    def cut(t: pa.Table) -> pa.Table:
        n = cut_places(t.column("row").to_numpy(), t.column("col").to_numpy())
        path = [f"{p}.{k}" for p, k in zip(t.column("path").to_pylist(), n.tolist(), strict=True)]
        return t.set_column(t.schema.get_field_index("path"), "path", pa.array(path, pa.string()))

    deep = cells.where("_open").drop("_open")
    return dealt(cells.where("not _open").drop("_open").unionByName(deep.groupBy(*by, "path").applyInArrow(cut, deep.schema)), by, parts)


def boxes(cells: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """The corners of each region, and how many cells it has."""
    corner = [f(c).cast("int").alias(n) for f, c, n in ((F.min, "row", "min_row"), (F.min, "col", "min_col"), (F.max, "row", "max_row"), (F.max, "col", "max_col"))]
    return cells.groupBy(*by, "path").agg(*corner, F.count(F.lit(1)).alias("cells"))


def reading_order(corners: np.ndarray) -> np.ndarray:
    """The place of each box (first row, first column, last row, last column): a part is cut at its empty rows, else only at its
    first empty column, what lies right of it being a part of its own."""

    def groups(part: np.ndarray, axis: int) -> list[np.ndarray]:
        part = part[np.argsort(corners[part, axis], kind="stable")]
        ends = np.maximum.accumulate(corners[part, axis + 2])
        return np.split(part, np.flatnonzero(corners[part[1:], axis] > ends[:-1] + 1) + 1)

    out, todo, n = np.empty(len(corners), np.int32), [np.arange(len(corners))], 0
    while todo:
        part = todo.pop()
        parts = groups(part, 0) if len(part) > 1 else [part]
        if len(parts) == 1 and len(part) > 1:
            first, *rest = groups(part, 1)
            parts = [first, np.concatenate(rest)] if rest else [first]
        if len(parts) > 1:
            todo += parts[::-1]
        else:
            out[part] = n + np.arange(len(part))
            n += len(part)
    return out


def numbered(found: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Adds ``region``, from 0 in the reading order of a sheet; only corners of regions pass through Python, a sheet at a time."""
    corners = ["min_row", "min_col", "max_row", "max_col"]

    def order(t: pa.Table) -> pa.Table:
        return t.append_column("region", pa.array(reading_order(np.column_stack([t.column(c).to_numpy() for c in corners])), pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return found.groupBy(*by).applyInArrow(order, f"{schema}, region int")


def merges_within(merges: DataFrame, found: DataFrame, by: tuple[str, ...] = BY, parts: int | None = None) -> DataFrame:
    """Merged ranges (r0, c0, r1, c1) with the one region that holds each as a whole; both meet by bands of rows."""
    near = found.select("*", bands(F.col("min_row"), F.col("max_row")).alias("_band"))
    own = merges.withColumn("_band", F.floor(F.col("r0") / BAND))
    whole = (F.col("r0") >= F.col("min_row")) & (F.col("r1") <= F.col("max_row")) & (F.col("c0") >= F.col("min_col")) & (F.col("c1") <= F.col("max_col"))
    if parts:
        own, near = dealt(own, (*by, "_band"), parts), dealt(near, (*by, "_band"), parts)
    return own.join(near, [*by, "_band"]).where(whole).drop("_band")


def uncovered(cells: DataFrame, merges: DataFrame, by: tuple[str, ...] = BY, parts: int | None = None) -> DataFrame:
    """Cells but those that a merged range covers without beginning there. Ranges and cells are read along each row, with
    the furthest end of a range so far."""
    used = cells.groupBy(*by).agg(F.max("row").alias("_last"))
    spread = merges.join(used, [*by]).where("r0 <= _last").select(*by, "r0", "c0", "c1", F.explode(F.sequence("r0", F.least("r1", "_last"))).alias("row"))
    begins = spread.select(*by, "row", (F.col("c0") + (F.col("row") == F.col("r0")).cast("int")).alias("col"), F.col("c1").alias("_to")).where("col <= _to")
    w = Window.partitionBy(*by, "row").orderBy("col", F.col("_to").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = cells.unionByName(begins, allowMissingColumns=True)
    both = (both if parts else dealt(both, by, None)).withColumn("_covered", F.coalesce(F.max("_to").over(w) >= F.col("col"), F.lit(False)))
    return both.where("_to is null and not _covered").drop("_to", "_covered")


def _lines(first: Column, last: Column) -> Column:
    """The texts of a row's cells in order, with empty ones where there is no cell."""
    before = lambda i: F.when(i == 0, first - 1).otherwise(F.get("_cells", i - 1)["col"])
    filled = F.flatten(F.transform("_cells", lambda x, i: F.concat(F.array_repeat(F.lit(""), (x["col"] - before(i) - 1).cast("int")), F.array(x["text"]))))
    return F.concat(filled, F.array_repeat(F.lit(""), (last - F.element_at("_cells", -1)["col"]).cast("int")))


def region_rows(cells: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """One row for each row of a region: its texts, what ``tables.header_rows`` counts, and what formulas it has."""
    value = (F.col("kind") != "f") & (strip(F.col("text")) != "")
    number = F.col("kind").isin("n", "b") | looks_numeric(F.col("text"))
    facts = tables.row_facts(value, number)
    box = Window.partitionBy(*by, "path")
    rows = cells.groupBy(*by, "path", "row").agg(
        *facts, F.array_sort(F.collect_list(F.struct("col", "text"))).alias("_cells"),
        F.max(F.col("formula").isNotNull()).alias("computed"), F.max(F.col("kind") == "f").alias("uncached"),
    )
    rows = rows.withColumns({"c0": F.min("a").over(box), "c1": F.max("b").over(box)})
    return rows.withColumn("line", _lines(F.col("c0"), F.col("c1"))).drop("_cells")


def notes_and_tables(cells: DataFrame, merges: DataFrame, by: tuple[str, ...] = BY, parts: int | None = None) -> DataFrame:
    """(by, region, part, type, text, ref, note, rows, spans) of each sheet, in the order of region and part.

    cells: by, row, col, kind, text, formula; kind ``f`` is a formula without a stored value, which shows its formula and
    counts for regions but not for headers. merges: by, r0, c0, r1, c1. A region of one row or column is a note; where a sure header has
    rows with one text at most above it, these become a note before the table."""
    placed = in_regions(uncovered(cells, merges, by, parts).where("text <> ''"), by, parts)
    rows = tables.with_header(region_rows(placed, by), [*by, "path"])
    whole = rows.groupBy(*by, "path").agg(
        F.array_sort(F.collect_list(F.struct("row", "line"))).alias("_rows"), F.min("header").alias("header"), F.max("sure").alias("sure"),
        F.max("computed").alias("computed"), F.max("uncached").alias("uncached"),
        *[f(x).cast("int").alias(n) for f, x, n in ((F.min, "row", "min_row"), (F.min, "c0", "min_col"), (F.max, "row", "max_row"), (F.max, "c1", "max_col"))],
    )
    span = F.struct((F.col("r0") - F.col("min_row")).cast("int").alias("row"), (F.col("c0") - F.col("min_col")).cast("int").alias("col"), (F.col("r1") - F.col("r0") + 1).cast("int").alias("rowspan"), (F.col("c1") - F.col("c0") + 1).cast("int").alias("colspan"))
    large = merges.where("r0 <> r1 or c0 <> c1").dropDuplicates([*by, "r0", "c0", "r1", "c1"])
    region = (*by, "path")
    corners = numbered(boxes(placed, by), by)
    corners = dealt(corners, region, parts) if parts else corners
    held = merges_within(large, corners, by, parts)
    spans = (dealt(held, region, parts) if parts else held).groupBy(*region).agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    whole = (dealt(whole, region, parts) if parts else whole).join(corners.select(*by, "path", "region"), [*by, "path"]).join(spans, [*by, "path"], "left").withColumn("_spans", F.coalesce("_spans", F.array().cast(f"array<{SPAN}>")))
    whole = whole.withColumn("_lines", F.transform("_rows", lambda x: x["line"]))
    texts = lambda lines: F.filter(F.flatten(lines), lambda x: x != "")
    above = (F.col("header") - F.col("min_row")).cast("int")
    head = F.slice("_lines", F.lit(1), above)
    strips = F.col("sure") & (above > 0) & F.forall(head, lambda line: F.size(F.filter(line, lambda x: x != "")) <= 1)
    cut = F.when(strips, above).otherwise(0)
    single = (F.col("min_row") == F.col("max_row")) | (F.col("min_col") == F.col("max_col"))
    ref = lambda a, b: a1_ref(a, F.col("min_col"), b, F.col("max_col"))
    told = F.concat_ws("; ", F.when(F.col("computed"), F.when(F.col("uncached"), NO_CACHE).otherwise(CACHED)), F.when(~F.col("sure"), "header-ambiguous"))
    own = F.transform(F.filter("_spans", lambda s: s["row"] >= F.col("_cut")), lambda s: F.struct((s["row"] - F.col("_cut")).cast("int").alias("row"), s["col"].alias("col"), s["rowspan"].alias("rowspan"), s["colspan"].alias("colspan")))
    null = lambda kind: F.lit(None).cast(kind)

    def part(no: int, kind: str, text: Column, ref: Column, note: Column, rows: Column, spans: Column) -> Column:
        return F.struct(F.lit(no).alias("part"), F.lit(kind).alias("type"), text.alias("text"), ref.alias("ref"), note.alias("note"), rows.alias("rows"), spans.alias("spans"))

    grid, many = "array<array<string>>", f"array<{SPAN}>"
    note = lambda lines, ref: part(0, "note", F.array_join(texts(lines), " "), ref, null("string"), null(grid), null(many))
    table = part(1, "table", null("string"), ref(F.col("min_row") + F.col("_cut"), F.col("max_row")), F.when(told != "", told), F.slice("_lines", F.col("_cut") + 1, F.size("_lines")), F.when(F.size(own) > 0, own))
    title = F.when(strips, note(head, ref(F.col("min_row"), F.col("header") - 1)))
    parts = F.when(single, F.array(note(F.col("_lines"), ref(F.col("min_row"), F.col("max_row"))))).otherwise(F.array(title, table))
    out = whole.withColumn("_cut", cut).select(*by, "region", F.explode(parts).alias("x")).where("x is not null")
    return out.select(*by, "region", "x.*").where("type = 'table' or text <> ''")


def charts(points: DataFrame, cells: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, sheet_no, chart_no, type, text, chart) of chart points.

    points: by, sheet_no, chart_no, plot, title, series, role (plot, name, cat or val), ref, literal, idx, value; one row for
    each stored point, and one without idx for a part that has none. Where a part stores no points its reference is looked up in ``cells``
    (by, sheet, row, col, text); names are looked up first. Categories are those of the first series that has any."""
    keys = [by, "sheet_no", "chart_no"]
    stored = F.array_sort(F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "value"))))
    part = points.groupBy(*keys, "plot", "title", "series", "role").agg(F.max("ref").alias("ref"), F.max("literal").alias("literal"), F.transform(stored, lambda x: x["value"]).alias("own"))
    asked = part.where((F.col("ref") != "") & ((F.size("own") == 0) | (F.col("role") == "name")))
    asked = asked.select(by, "ref").distinct()
    seen = tables.resolved(asked, cells, [by]).select(by, "ref", F.col("values").alias("seen"))
    part = part.join(seen, [by, "ref"], "left")
    none = F.array().cast("array<string>")
    held = F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("seen", none))
    name = F.coalesce(F.get("seen", F.lit(0)), F.get("own", F.lit(0)), "literal")
    of = lambda role, c: F.max(F.when(F.col("role") == role, c))
    series = part.where("series is not null").groupBy(*keys, "series").agg(of("name", name).alias("name"), of("val", F.col("ref")).alias("ref"), F.coalesce(of("val", held), none).alias("values"), of("cat", held).alias("cats"))
    listed = F.array_sort(F.collect_list(F.struct("series", F.struct("name", "ref", "values").alias("s"), F.coalesce("cats", none).alias("cats"))))
    whole = series.groupBy(*keys).agg(listed.alias("all"))
    plots = points.where("role = 'plot'").select(*keys, "plot", "title").distinct().join(whole, keys, "left")
    all_ = F.coalesce("all", F.array().cast("array<struct<series:int,s:struct<name:string,ref:string,values:array<string>>,cats:array<string>>>"))
    told = F.exists(all_, lambda x: F.size(x["s"]["values"]) > 0)
    chart = F.struct(
        F.col("plot").alias("kind"), F.col("title").alias("title"),
        F.filter(F.transform(all_, lambda x: x["s"]["ref"]), lambda r: r.isNotNull()).alias("series_refs"),
        F.get(F.filter(F.transform(all_, lambda x: x["cats"]), lambda c: F.size(c) > 0), F.lit(0)).alias("categories"),
        F.when(told, F.transform(all_, lambda x: x["s"])).alias("series"),
    )
    return plots.select(*keys, F.lit("chart").alias("type"), F.coalesce("title", "plot").alias("text"), chart.alias("chart"))


def elements(sheets: DataFrame, cells: DataFrame, merges: DataFrame, points: DataFrame) -> DataFrame:
    """Units and elements of workbooks (doc_id, unit_no, elem_no, type, text, ref, note, rows, spans, chart, signals): each
    sheet's notes and tables in reading order, then its charts."""
    found = notes_and_tables(cells, merges)
    named = cells.where("kind <> 'f'").join(sheets.select(*BY, F.col("name").alias("sheet")), [*BY]).select("doc_id", "sheet", "row", "col", "text")
    drawn = charts(points, named).withColumns({"region": F.lit(2**31 - 1), "part": F.col("chart_no")}).drop("chart_no")
    every = found.unionByName(drawn, allowMissingColumns=True)
    every = every.withColumn("elem_no", F.row_number().over(Window.partitionBy(*BY).orderBy("region", "part")))
    has = lambda c: F.max(F.coalesce(c & (F.col("type") == "table"), F.lit(False)))
    held = every.groupBy(*BY).agg(
        (F.count_if(F.col("type") == "table") > 1).alias("many_tables"), has(F.size("spans") > 0).alias("merged"), has(F.contains("note", F.lit("header-ambiguous"))).alias("ambiguous"),
        has(F.contains("note", F.lit("contains-formula"))).alias("formula"), has(F.contains("note", F.lit("no cached values"))).alias("no_cache"), F.lit(False).alias("empty"),
    )
    units = sheets.select(*BY, "name").join(held, [*BY], "left").withColumn("empty", F.col("empty").isNull())
    signals = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("many_tables", "merged", "ambiguous", "formula", "no_cache", "empty")]))
    units = units.select(*BY, F.lit(0).alias("elem_no"), F.lit("unit").alias("type"), F.col("name").alias("text"), signals.alias("signals"))
    out = units.unionByName(every.drop("region", "part"), allowMissingColumns=True)
    return out.withColumn("unit_no", F.col("sheet_no") + 1).drop("sheet_no")
