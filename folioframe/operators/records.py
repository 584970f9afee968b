"""Ordered records: text under headers, blank headers, section texts, running-capped replacement, first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import control_strip, strip
from .tables import filled


def under_header(records: DataFrame) -> DataFrame:
    """Text records with the ordinal of the last header before them in their section (section, rec, tag, text)."""
    w = Window.partitionBy("section").orderBy("rec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return records.withColumn("header", F.last(F.when(F.col("tag") == "header", F.col("rec")), ignorenulls=True).over(w)).where(F.col("tag") == "text")


def blank_headers(records: DataFrame) -> DataFrame:
    """Headers that no text record follows before the next header."""
    texts = under_header(records).select("section", F.col("header").alias("rec")).where(F.col("rec").isNotNull())
    return records.where(F.col("tag") == "header").join(texts, ["section", "rec"], "left_anti")


def section_text(records: DataFrame, document: str | None = None) -> DataFrame:
    """Texts of each section in order, one line each, under a ``=== name ===`` line; with ``document``, a column, only
    where a document has several sections."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec", "text"))), lambda x: x["text"]), "\n")
    head = F.concat(F.lit("=== "), F.col("section").cast("string"), F.lit(" ===\n"))
    keys = [document, "section"] if document else ["section"]
    texts = records.where("tag = 'text'").groupBy(*keys).agg(lines.alias("text"))
    if not document:
        return texts.select("section", F.concat(head, "text").alias("text"))
    several = F.count(F.lit(1)).over(Window.partitionBy(document)) > 1
    return texts.select(document, "section", F.when(several, F.concat(head, "text")).otherwise(F.col("text")).alias("text"))


def _quoted(old: str) -> str:
    """A pattern that matches the text itself."""
    return "\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _before(counted: DataFrame, lead: str, most: int) -> DataFrame:
    """(lead, before): matches in all records of lesser ``lead``, below ``most``. Sums run within ranges of ``lead``, then
    over one row for each range, so no task sees all records."""
    spark = counted.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    part = counted.groupBy(lead).agg(F.sum("_n").alias("_t")).where("_t > 0").repartitionByRange(n, lead).withColumn("_range", F.spark_partition_id()).persist()
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = part.groupBy("_range").agg(F.sum("_t").alias("_s")).withColumn("_r", F.coalesce(F.sum("_s").over(upto.orderBy("_range")), F.lit(0))).select("_range", "_r")
    own = F.coalesce(F.sum("_t").over(upto.partitionBy("_range").orderBy(lead)), F.lit(0))
    return part.withColumn("_own", own).join(ranges, "_range").select(lead, (F.col("_own") + F.col("_r")).alias("_before")).where(F.col("_before") < most)


def replace_capped(records: DataFrame, old: str, new: str, most: int | None, order: list[str], regex: bool = False) -> DataFrame:
    """``text`` with the first ``most`` matches of ``old``, counted over all records in order, replaced; adds replaced.

    ``old`` is a text, or a regular expression whose groups ``new`` may use as $1, $2 ...; an empty one matches nothing."""
    if not old:
        return records.withColumn("replaced", F.lit(0))
    pattern = old if regex else _quoted(old)
    counted = records.withColumn("_n", F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long"))
    if most is None:
        k = F.col("_n")
        own = counted
    else:
        lead, *rest = order
        w = Window.partitionBy(lead).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
        own = counted.join(_before(counted, lead, most), lead, "left").withColumn("_p", F.coalesce("_before", F.lit(most)) + F.coalesce(F.sum("_n").over(w), F.lit(0)))
        k = F.least(F.col("_n"), F.greatest(F.lit(most) - F.col("_p"), F.lit(0)))
    own = own.withColumn("replaced", k.cast("int"))
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    changed = F.transform(matches, lambda m, i: F.when(i < F.col("replaced"), F.regexp_replace(m, F.lit(pattern), F.lit(new)) if regex else F.lit(new)).otherwise(m))
    done = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(F.split("text", pattern, -1), F.lit(1), F.size(matches)), changed, lambda a, b: F.array(a, b))), ""), F.element_at(F.split("text", pattern, -1), -1))
    return own.withColumn("text", F.when(F.col("replaced") > 0, done).otherwise(F.col("text"))).drop("_n", "_before", "_p")


def replace_rules(records: DataFrame, rules: list, order: list[str]) -> DataFrame:
    """Ordered rules ((old, new), or old, new and perhaps max and regex); each sees what those before it made of the texts.
    Adds replaced, over all rules."""
    total = F.lit(0)
    for k, r in enumerate(rules):
        r = r if isinstance(r, dict) else {"old": r[0], "new": r[1]}
        records = replace_capped(records, r["old"], r["new"], r.get("max"), order, bool(r.get("regex"))).withColumnRenamed("replaced", f"_k{k}")
        total = total + F.col(f"_k{k}")
    return records.withColumn("replaced", total).drop(*[f"_k{k}" for k in range(len(rules))])


def first_of_equal(notes: DataFrame, order: str = "doc_id") -> DataFrame:
    """Of equal texts the first by ``order``, which is unique; texts meet by their SHA-256, in a pre-aggregated minimum, so
    neither a long nor a frequent text makes a hot task."""
    first = notes.where(strip(F.col("text")) != "").groupBy(F.sha2("text", 256).alias("_h")).agg(F.min(order).alias(order)).select(order)
    return notes.join(first, order, "left_semi")


#: Record tags, and the bytes of a list header that is a cell; fixed values.
PARA_HEADER, PARA_TEXT, LIST_HEADER, TABLE, CELL_BYTES = 66, 67, 72, 77, 14
KEYS = ["doc_id", "section"]


def _short(payload: Column, at: int) -> Column:
    """Two bytes, the lower one first; 0 where there are none."""
    both = F.concat(F.hex(F.substring(payload, at + 2, 1)), F.hex(F.substring(payload, at + 1, 1)))
    return F.when(F.length(payload) >= at + 2, F.conv(both, 16, 10).cast("int")).otherwise(0)


def scopes(records: DataFrame) -> DataFrame:
    """Adds ``within``: the tables in whose scopes each record lies, from the outer one on, as structs of level, table (its record),
    number (in its section, from 0), nrows and ncols as stated, and cell (the record of the cell, if any).

    A scope is the stretch of records that follow without one of lesser level. For each level at which there are tables the last
    record of lesser level, the last table and the last cell header of it are kept along a section: a fixed number of running values
    in one pass over sorted records, which spills and holds no stack. Levels have ten bits, so there are 1,024 of them at most."""
    levels = sorted(r.level for r in records.where(F.col("tag") == TABLE).select("level").distinct().collect())
    w = Window.partitionBy(*KEYS).orderBy("rec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda hit, value: F.last(F.when(hit, value), ignorenulls=True).over(w)
    rec, tag, level = F.col("rec"), F.col("tag"), F.col("level")
    is_table, is_cell = tag == TABLE, (tag == LIST_HEADER) & (F.length("payload") >= CELL_BYTES)
    if not levels:
        return records.withColumn("within", F.array().cast("array<struct<level:int,table:int,number:int,nrows:int,ncols:int,cell:int>>"))
    size = [F.when(is_table, _short(F.col("payload"), at)).alias(name) for at, name in ((4, "nrows"), (6, "ncols"))]
    found = records.withColumn("_n", (F.sum(is_table.cast("int")).over(w) - 1).cast("int"))
    # Of each level: the last record that is a table of it or lies above it, then the last that is of it or lies above.
    running = {}
    for n in levels:
        own = F.struct((level == n).alias("open"), rec.cast("int").alias("table"), F.col("_n").alias("number"), *size)
        running[f"_t{n}"] = last((level < n) | ((level == n) & is_table), own)
        running[f"_c{n}"] = last(level <= n, F.struct(((level == n) & is_cell).alias("open"), rec.cast("int").alias("cell")))
    scope = lambda n: F.when(F.col(f"_t{n}.open"), F.struct(F.lit(n).alias("level"), *[F.col(f"_t{n}.{c}") for c in ("table", "number", "nrows", "ncols")], F.when(F.col(f"_c{n}.open"), F.col(f"_c{n}.cell")).alias("cell")))
    return found.withColumns(running).withColumn("within", F.array_compact(F.array(*map(scope, levels)))).drop("_n", *running)


def _cells(scoped: DataFrame) -> DataFrame:
    """Cells of all tables: doc_id, section, rec (of the table), table, nrows, ncols, cell, row, col, rowspan, colspan, text.

    A cell's texts are its own paragraphs, which lie one level below its first paragraph header; those of tables in it lie deeper.
    Where a table's size isn't stated it reaches as far as its cells do. All groups and windows are parts of sections."""
    kinds = F.col("tag").isin(PARA_HEADER, PARA_TEXT, LIST_HEADER)
    content = scoped.where(kinds & (F.size("within") > 0)).select(*KEYS, "rec", "tag", "level", "text", "payload", F.explode("within").alias("_s"))
    is_head = F.col("rec") == F.col("_s.cell")
    content = content.where(is_head | ((F.col("level") > F.col("_s.level")) & (F.col("tag") != LIST_HEADER)))
    of_head = lambda c: F.max(F.when(is_head, c))
    at = {"col": 6, "row": 8, "colspan": 10, "rowspan": 12}
    head = of_head(F.struct(F.col("_s.table").alias("rec"), F.col("_s.number").alias("table"), "_s.nrows", "_s.ncols", *[_short(F.col("payload"), k).alias(c) for c, k in at.items()]))
    is_paragraph = F.col("tag") == PARA_HEADER
    first = F.min_by(F.when(is_paragraph, F.col("level")), F.when(is_paragraph, F.col("rec")))
    texts = F.array_sort(F.collect_list(F.when(F.col("tag") == PARA_TEXT, F.struct("rec", "level", control_strip(F.col("text")).alias("text")))))
    whole = content.groupBy(*KEYS, F.col("_s.cell").alias("_at")).agg(head.alias("_h"), first.alias("_first"), texts.alias("_texts"))
    own = F.transform(F.filter("_texts", lambda x: x["level"] == F.col("_first") + 1), lambda x: x["text"])
    cells = whole.select(*KEYS, "_at", "_h.rec", "_h.table", "_h.nrows", "_h.ncols", "_h.row", "_h.col", *[F.greatest(F.lit(1), F.col(f"_h.{c}")).alias(c) for c in ("rowspan", "colspan")], F.array_join(own, "\n").alias("text"))
    table = Window.partitionBy(*KEYS, "rec")
    stated = (F.col("nrows") > 0) & (F.col("ncols") > 0)
    size = lambda n, a, b: F.when(stated, F.col(n)).otherwise(F.max(F.col(a) + F.col(b)).over(table))
    sized = cells.withColumns({"_r": size("nrows", "row", "rowspan"), "_c": size("ncols", "col", "colspan"), "cell": F.row_number().over(table.orderBy("_at")) - 1})
    return sized.select(*KEYS, "rec", "table", F.col("_r").alias("nrows"), F.col("_c").alias("ncols"), "cell", "row", "col", "rowspan", "colspan", "text")


def tables(records: DataFrame) -> DataFrame:
    """Cells (doc_id, section, table, nrows, ncols, cell, row, col, rowspan, colspan, text) of the tables in record atoms (doc_id,
    section, rec, tag, level, text, payload), nested ones too; ``table`` counts a section's from 0. Where two tables follow each
    other in one scope a cell belongs to the later one."""
    return _cells(scopes(records)).drop("rec")


def _grids(cells: DataFrame) -> DataFrame:
    """Tables (doc_id, section, rec) with rows and spans; places that a cell covers are blank, and of cells in one place the later stays."""
    keys = [*KEYS, "rec", "nrows", "ncols"]
    place = cells.where("row < nrows and col < ncols").groupBy(*keys, "row", "col").agg(F.max_by("text", "cell").alias("text"))
    line = place.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("_c"))
    line = line.select(*keys, "row", filled(F.col("_c"), "col", F.col("ncols"), F.lit(""), "text").alias("line"))
    whole = line.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("_l"))
    whole = whole.select(*KEYS, "rec", filled(F.col("_l"), "row", F.col("nrows"), F.array_repeat(F.lit(""), F.col("ncols")), "line").alias("rows"))
    span = F.struct("cell", F.struct("row", "col", "rowspan", "colspan").alias("s"))
    spans = cells.where("rowspan > 1 or colspan > 1").groupBy(*KEYS, "rec").agg(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"]).alias("spans"))
    return whole.join(spans, [*KEYS, "rec"], "full")


def elements(records: DataFrame) -> DataFrame:
    """(doc_id, section, rec, type, text, rows, spans): paragraphs outside of tables, and tables, nested ones too, at the
    places of their records."""
    scoped = scopes(records)
    texts = scoped.where((F.col("tag") == PARA_TEXT) & (F.size("within") == 0)).select(*KEYS, "rec", F.lit("paragraph").alias("type"), control_strip(F.col("text")).alias("text")).where("text <> ''")
    heads = records.where(F.col("tag") == TABLE).select(*KEYS, "rec", F.lit("table").alias("type"), _short(F.col("payload"), 4).alias("_r"), _short(F.col("payload"), 6).alias("_c"))
    blank = F.when((F.col("_r") > 0) & (F.col("_c") > 0), F.array_repeat(F.array_repeat(F.lit(""), F.col("_c")), F.col("_r"))).otherwise(F.array().cast("array<array<string>>"))
    found = heads.join(_grids(_cells(scoped)), [*KEYS, "rec"], "left").select(*KEYS, "rec", "type", F.coalesce("rows", blank).alias("rows"), "spans")
    return texts.unionByName(found, allowMissingColumns=True)
