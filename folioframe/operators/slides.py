"""Slides as ordered elements: shapes and the placeholders of layouts and masters in, titles, texts, tables, charts and notes out.

A deck is dealt by file once; places that shapes inherit, their order and the slide's elements are windows and groups within it,
so sorts are all that follows that exchange. What one slide holds is gathered in one row; one part of a file held it before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHART, SPAN
from . import layout

#: ``layer`` is slide (one row for each, with ``grouped`` where it has a group), shape, layout or master; ``part`` names the file's part
#: and ``up`` the part that it inherits from. Layouts and masters give their placeholders only. A place that isn't stated is null.
ATOMS = (
    "doc_id string, layer string, part string, up string, slide int, z int, kind string, ph string, idx int, name string, grouped boolean, "
    "top long, left long, height long, width long, text string, paragraphs array<struct<level:int,bullet:string,text:string>>, "
    f"cells array<array<struct<text:string,rowspan:int,colspan:int,covered:boolean>>>, chart {CHART}, error string"
)
#: Placeholder types whose text is a body.
BODY = ("body", "obj", "subTitle")
#: The master's placeholder that a layout's takes its place from, where it isn't the body.
MASTERS = {"title": "title", "ctrTitle": "title", "dt": "dt", "ftr": "ftr", "sldNum": "sldNum"}
PLACE = ("top", "left", "height", "width")
#: Notes of elements and the order of a slide's signals.
PICTURE, NOTES = "picture present; not extracted in this pass", "speaker-notes"
SIGNALS = ("merged", "chart", "overlap", "grouped", "image_only", "empty")


def placed(atoms: DataFrame) -> DataFrame:
    """Shapes of ``atoms`` (ATOMS) and their slides, where each part of a place that a placeholder doesn't state comes from the
    layout's placeholder of its index, and where that doesn't either, from the master's of the type it stands for; else it stays null.

    Of several placeholders with one index (or type) the first counts; what is no placeholder inherits nothing."""
    stated = F.struct(*PLACE)
    alone = F.concat(F.lit("="), "layer", F.lit(" "), "part", F.lit(" "), F.col("z").cast("string"))
    key = lambda part, name: F.concat(F.lit("@"), part, F.lit(" "), name.cast("string"))
    is_ = lambda layer: (F.col("layer") == layer) & F.col("ph").isNotNull()

    def first(layer: str, what: Column, by: Column) -> Column:
        return F.min_by(F.when(is_(layer), what), F.when(is_(layer), F.col("z"))).over(Window.partitionBy("doc_id", by))

    by_index = F.coalesce(F.when(is_("shape"), key(F.col("up"), F.col("idx"))).when(is_("layout"), key(F.col("part"), F.col("idx"))), alone)
    out = atoms.repartition("doc_id").withColumn("_by", by_index)
    out = out.withColumn("_layout", first("layout", F.struct("ph", "up", stated.alias("at")), F.col("_by")))
    stands = F.create_map(*[F.lit(x) for pair in MASTERS.items() for x in pair])
    of_type = F.coalesce(F.try_element_at(stands, F.col("_layout.ph")), F.lit("body"))
    by_type = F.coalesce(F.when(is_("shape"), key(F.col("_layout.up"), of_type)).when(is_("master"), key(F.col("part"), F.col("ph"))), alone)
    out = out.withColumn("_by", by_type)
    out = out.withColumn("_master", first("master", stated, F.col("_by")))
    inherited = {c: F.coalesce(c, F.col(f"_layout.at.{c}"), F.col(f"_master.{c}")) for c in PLACE}
    return out.where("layer is null or layer in ('slide', 'shape')").withColumns(inherited).drop("_by", "_layout", "_master")


def _element(kind: str, text: Column | None = None, level: Column | None = None, note: str | None = None, rows: Column | None = None, spans: Column | None = None, chart: Column | None = None) -> Column:
    none = F.lit(None)
    parts = ((F.lit(kind), "type", "string"), (text, "text", "string"), (level, "level", "int"), (F.lit(note), "note", "string"), (rows, "rows", "array<array<string>>"), (spans, "spans", f"array<{SPAN}>"), (chart, "chart", CHART))
    return F.struct(*[(none if c is None else c).cast(t).alias(n) for c, n, t in parts])


def _spans(cells: Column) -> Column:
    """Spans of a table's cells that others don't cover, null without any."""
    span = lambda c, r, k: F.struct(r.cast("int").alias("row"), k.cast("int").alias("col"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), (~c["covered"] & ((c["rowspan"] > 1) | (c["colspan"] > 1))).alias("is"))
    every = F.filter(F.flatten(F.transform(cells, lambda row, r: F.transform(row, lambda c, k: span(c, r, k)))), lambda s: s["is"])
    return F.when(F.size(every) > 0, F.transform(every, lambda s: F.struct(*[s[k].alias(k) for k in ("row", "col", "rowspan", "colspan")])))


def _own(shape: Column, title: Column) -> Column:
    """The elements of one shape, in order; the slide's title gives none."""
    body = F.coalesce(shape["ph"].isin(*BODY), F.lit(False))

    def paragraph(p: Column) -> Column:
        listed = (p["bullet"] == "bullet") | ((p["bullet"] == "inherit") & (body | (p["level"] > 0)))
        return F.when(listed, _element("list_item", p["text"], p["level"])).otherwise(_element("paragraph", p["text"]))

    rows = F.transform(shape["cells"], lambda row: F.transform(row, lambda c: F.when(c["covered"], "").otherwise(c["text"])))
    filled = F.exists(rows, lambda row: F.exists(row, lambda c: c != ""))
    none = F.array().cast("array<" + f"struct<type:string,text:string,level:int,note:string,rows:array<array<string>>,spans:array<{SPAN}>,chart:{CHART}>" + ">")
    told = (
        F.when((shape["kind"] == "table") & filled, F.array(_element("table", rows=rows, spans=_spans(shape["cells"]))))
        .when((shape["kind"] == "chart") & shape["chart"].isNotNull(), F.array(_element("chart", F.coalesce(shape["chart"]["title"], shape["chart"]["kind"]), chart=shape["chart"])))
        .when(shape["kind"] == "picture", F.array(_element("image", F.when(shape["name"] != "", shape["name"]).otherwise("image"), note=PICTURE)))
        .when(shape["kind"] == "notes", F.array(_element("note", shape["text"], note=NOTES)))
        .when((shape["kind"] == "text") & ~title, F.transform(F.filter(shape["paragraphs"], lambda p: p["text"] != ""), paragraph))
    )
    return F.coalesce(told, none)


def elements(atoms: DataFrame) -> DataFrame:
    """Units and elements of decks (doc_id, unit_no, elem_no, type, text, level, note, rows, spans, chart, signals, error) from ``ATOMS``.
    An atom with ``error`` (and no layer) stands for a deck that can't be read, and becomes a row of type error.

    A unit is a slide, whether it has shapes or not. Shapes come from top to bottom, then from left, then as in the file, and notes last;
    a place that is stated nowhere counts as 0. The title is the text of the first placeholder of index 0 that is in no group. Null texts are empty."""
    shape = ["kind", "ph", "idx", "name", "grouped", "text", "paragraphs", "cells", "chart", "pos", "z"]
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in PLACE}
    ordered = layout.shape_order(placed(atoms).withColumns({"text": F.coalesce("text", F.lit("")), **zero}))
    one = F.struct(F.col("kind").eqNullSafe("notes").alias("last"), *[F.col(c) for c in ("pos", *shape[:-2], "z", *PLACE)])
    held = ordered.groupBy("doc_id", "slide").agg(
        F.array_sort(F.collect_list(F.when(F.col("layer") == "shape", one))).alias("shapes"),
        F.coalesce(F.max(F.when(F.col("layer") == "slide", F.col("grouped"))), F.lit(False)).alias("grouped"), F.max("error").alias("error"),
    )
    holders = F.filter("shapes", lambda s: (s["kind"] == "text") & s["ph"].isNotNull() & (s["idx"] == 0) & ~s["grouped"])
    held = held.withColumn("title", F.array_min(F.transform(holders, lambda s: F.struct(s["z"].alias("z"), s["text"].alias("text")))))
    own = F.flatten(F.transform("shapes", lambda s: _own(s, s["z"].eqNullSafe(F.col("title.z")))))
    held = held.withColumn("own", own)
    texts = F.filter("shapes", lambda s: (s["kind"] == "text") & (s["text"] != ""))
    crossing = F.exists(texts, lambda a: F.exists(texts, lambda b: (a["z"] < b["z"]) & layout.overlap(a, b)))
    kinds = lambda k: F.exists("own", lambda e: e["type"] == k)
    conditions = (F.exists("own", lambda e: e["spans"].isNotNull()), kinds("chart"), crossing, F.col("grouped"), (F.size(texts) == 0) & kinds("image"), F.size("own") == 0)
    signals = F.array_compact(F.array(*[F.when(c, n) for c, n in zip(conditions, SIGNALS, strict=True)]))
    unit = F.array(F.when(F.col("error").isNotNull(), _element("error")).otherwise(_element("unit", F.coalesce("title.text", F.lit("")))))
    every = held.withColumn("signals", signals).select("doc_id", F.col("slide").alias("unit_no"), "signals", "error", F.posexplode(F.concat(unit, "own")).alias("elem_no", "e"))
    number = F.when(F.col("error").isNull(), F.col("elem_no")).alias("elem_no")
    return every.select("doc_id", "unit_no", number, "e.*", F.when(F.col("e.type") == "unit", F.col("signals")).alias("signals"), "error")
