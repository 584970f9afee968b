"""Renderers of whole tables (table_id, rows) and of cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import esc_html, gfm_cell, hwp_cell


def _rows(grid: DataFrame, cell: Column, sep: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("x")))), lambda c: c["x"]), sep)
    return grid.groupBy("table_id", "row").agg(joined.alias("line"), F.count(F.lit(1)).alias("width"))


def _markdown(tables: DataFrame, cell: Callable[[Column], Column]) -> DataFrame:
    piped = lambda row, of: F.concat(F.lit("| "), F.array_join(F.transform(row, of), " | "), F.lit(" |"))
    rule = lambda row: F.concat(F.lit("\n"), piped(row, lambda _: F.lit("---")))
    lines = F.transform("rows", lambda row, i: F.concat(piped(row, cell), F.when(i == 0, rule(row)).otherwise("")))
    return tables.select("table_id", F.array_join(lines, "\n").alias("markdown"))


def gfm_table(tables: DataFrame) -> DataFrame:
    return _markdown(tables, gfm_cell)


def hwp_table(tables: DataFrame) -> DataFrame:
    return _markdown(tables, hwp_cell)


def html_table(cells: DataFrame) -> DataFrame:
    """Anchors (table_id, row, col, rowspan, colspan, text) as an HTML table; places that a span covers are left out."""
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    attrs = F.concat(F.when(F.col("rowspan") > 1, F.concat(F.lit(' rowspan="'), F.col("rowspan").cast("string"), F.lit('"'))).otherwise(""), F.when(F.col("colspan") > 1, F.concat(F.lit(' colspan="'), F.col("colspan").cast("string"), F.lit('"'))).otherwise(""))
    cell = F.concat(F.lit("<"), tag, attrs, F.lit(">"), F.replace(esc_html(F.col("text")), F.lit("\n"), F.lit(" ")), F.lit("</"), tag, F.lit(">"))
    rows = _rows(cells, cell, "").withColumn("line", F.concat(F.lit("  <tr>"), "line", F.lit("</tr>")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table>\n"), body, F.lit("\n</table>")).alias("html"))


def csv_table(tables: DataFrame) -> DataFrame:
    """Minimal quoting and CRLF line ends."""
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    lines = F.transform("rows", lambda row: F.concat(F.array_join(F.transform(row, quoted), ","), F.lit("\r\n")))
    return tables.select("table_id", F.array_join(lines, "").alias("csv"))
