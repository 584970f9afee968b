"""Whole documents from element rows: confidence and flags of units, Markdown, JSON, and files of both."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import comment_safe, esc_html, esc_inline, esc_md, gfm_cell, strip
from .operators import pages as page_operators
from .operators import quality
from .operators.tables import once
from .schema import SPAN, shaped

RULES = {"xlsx": quality.SHEET, "docx": quality.DOCX, "pptx": quality.SLIDE}


def from_pdf(files: DataFrame, strict: bool = False) -> DataFrame:
    """Elements of PDF files: decoded atoms, then ``operators.pages``; a file that can't be read has one row with ``error``."""
    from .sources import office

    atoms = [office.decode(files, f"pdf_{x}", strict) for x in ("pages", "spans", "drawings", "images")]
    good = [a.where("error is null").drop("error").persist() for a in atoms]  # decoded once, read by many steps
    found = page_operators.elements(*good)
    bad = atoms[0].where("error is not null").select("doc_id", F.lit("pdf").alias("format"), F.lit("error").alias("type"), "error")
    return shaped(found.unionByName(bad, allowMissingColumns=True))


def units(elements: DataFrame) -> DataFrame:
    """(doc_id, format, unit_no, title, flags, confidence, needs_vision, elements) of every unit, by the quality model."""
    flags, caps = {}, {}
    for kind, rules in RULES.items():
        for condition, flag, cap in rules:
            flags.setdefault(f"{kind}.{condition}", []).append(flag)
            caps[f"{kind}.{condition}"] = min(cap, caps.get(f"{kind}.{condition}", 1.0))
    flag_of = F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    cap_of = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])
    keys = F.transform("signals", lambda s: F.concat(F.col("format"), F.lit("."), s))
    none = F.array().cast("array<string>")
    unit = elements.where("type = 'unit'").select(
        "doc_id", "format", "unit_no", F.col("text").alias("title"),
        F.coalesce(F.flatten(F.transform(keys, lambda k: F.coalesce(F.try_element_at(flag_of, k), none))), none).alias("flags"),
        F.coalesce(F.aggregate(keys, F.lit(1.0), lambda a, k: F.least(a, F.coalesce(F.try_element_at(cap_of, k), F.lit(1.0)))), F.lit(1.0)).alias("confidence"),
        "props",
    )
    seen = F.coalesce(F.array_contains("flags", "needs-vision"), F.lit(False)) | F.coalesce(F.try_element_at("props", F.lit("needs_vision")) == "true", F.lit(False))
    count = elements.where("type <> 'unit'").groupBy("doc_id", "unit_no").agg(F.count(F.lit(1)).alias("elements"), F.sum((F.col("type") == "table").cast("int")).alias("tables"))
    out = unit.withColumn("needs_vision", seen).join(count, ["doc_id", "unit_no"], "left")
    return out.fillna(0, ["elements", "tables"])


def rollup(units: DataFrame) -> DataFrame:
    """Per document: units, the least confidence, the units to verify and those that need vision, in order."""
    listed = lambda hit: F.array_sort(F.collect_list(F.when(hit, F.col("unit_no"))))
    return units.groupBy("doc_id", "format").agg(F.count(F.lit(1)).alias("units"), F.min("confidence").alias("min_confidence"), listed(F.col("confidence") < quality.VERIFY).alias("verify"), listed(F.col("needs_vision")).alias("vision"))


# Tables


def _padded(rows: Column) -> Column:
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def _pipes(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def pipe_table(rows: Column, cell=gfm_cell) -> Column:
    """A Markdown table; the first row is the head, short rows are filled up."""
    lines = F.transform(_padded(rows), lambda r: _pipes(F.transform(r, cell)))
    rule = _pipes(F.array_repeat(F.lit("---"), F.array_max(F.transform(rows, F.size))))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")).otherwise("")


def html_table(rows: Column, spans: Column, inner: Column | None = None) -> Column:
    """An HTML table; cells that a span covers are left out. ``inner``: structs (row, col, html) of what follows a cell's text, in order."""

    def cell(value: Column, r: Column, c: Column) -> Column:
        within = lambda s: (r >= s["row"]) & (r < s["row"] + s["rowspan"]) & (c >= s["col"]) & (c < s["col"] + s["colspan"])
        anchor = lambda s: (r == s["row"]) & (c == s["col"])
        own = F.get(F.filter(spans, anchor), F.lit(0))
        size = F.concat(*[F.when(own[k] > 1, F.concat(F.lit(f' {k}="'), own[k].cast("string"), F.lit('"'))).otherwise("") for k in ("rowspan", "colspan")])
        tag = F.when(r == 0, "th").otherwise("td")
        text = F.replace(esc_html(value), F.lit("\n"), F.lit(" "))
        if inner is not None:
            text = F.concat(text, F.coalesce(F.array_join(F.transform(F.filter(inner, anchor), lambda x: x["html"]), ""), F.lit("")))
        shown = F.concat(F.lit("<"), tag, F.coalesce(size, F.lit("")), F.lit(">"), text, F.lit("</"), tag, F.lit(">"))
        return F.when(F.exists(spans, lambda s: within(s) & ~anchor(s)), "").otherwise(shown)

    lines = F.transform(rows, lambda row, r: F.concat(F.lit("  <tr>"), F.array_join(F.transform(row, lambda v, c: cell(v, r, c)), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>\n"), F.array_join(lines, "\n"), F.lit("\n</table>"))


def _depth(nested: DataFrame) -> int:
    """How deep the tables of a column ``v`` of variant lists lie at most, found in one pass where it's 8 or less."""
    most, found = 4, 4
    while found == most:
        most *= 2
        level = nested.select(F.lit(0).alias("n"), F.variant_get("v", "$", "array<variant>").alias("l"))
        for _ in range(most):
            below = F.flatten(F.filter(F.transform("l", lambda x: F.variant_get(x, "$.nested", "array<variant>")), lambda x: x.isNotNull()))
            level = level.select((F.col("n") + (F.size("l") > 0).cast("int")).alias("n"), below.alias("l"))
        found = level.agg(F.max("n")).first()[0] or 0
    return found


def nested_html(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html) of tables (keys, rows, spans, nested) with tables in their cells at any depth; ``nested`` is a JSON list of
    {row, col, rows, spans, nested}.

    A table is rendered with all that is in it within its row, by as many transforms in each other as tables are deep; nothing is
    exchanged. How deep they are is asked once."""
    none, variants = F.array().cast(f"array<{SPAN}>"), "array<variant>"
    level = tables.select(*keys, "rows", F.coalesce("spans", none).alias("spans"), F.parse_json("nested").alias("v"))

    def drawn(rows: Column, spans: Column, nested: Column, depth: int) -> Column:
        if not depth:
            return html_table(rows, spans)
        of = lambda x, name, kind: F.variant_get(x, f"$.{name}", kind)
        below = lambda x: drawn(of(x, "rows", "array<array<string>>"), F.coalesce(of(x, "spans", f"array<{SPAN}>"), none), of(x, "nested", "variant"), depth - 1)
        inner = F.transform(F.variant_get(nested, "$", variants), lambda x: F.struct(of(x, "row", "int").alias("row"), of(x, "col", "int").alias("col"), below(x).alias("html")))
        return once(F.struct(rows.alias("rows"), spans.alias("spans"), inner.alias("inner")), lambda t: html_table(t["rows"], t["spans"], t["inner"]))

    depth = _depth(level.select("v"))
    return level.select(*keys, drawn(F.col("rows"), F.col("spans"), F.col("v"), depth).alias("html"))


# Markdown. Marks, comments and notices are output.


def _pair(a: Column, sep: str, b: Column) -> Column:
    return F.concat(a, F.lit(sep), b)


def _chart(e, text: Column) -> Column:
    chart = F.col("chart")
    head = F.concat(F.lit("**[chart]** "), text, F.lit(" _(kind: "), esc_html(F.coalesce(chart["kind"], F.lit("?"))), F.lit(")_"))
    cats, series = F.coalesce(chart["categories"], F.array().cast("array<string>")), chart["series"]

    def sheet_row(s: Column) -> Column:
        values = F.concat(F.transform(s["values"], gfm_cell), F.array_repeat(F.lit(""), F.size(cats)))
        return _pipes(F.concat(F.array(gfm_cell(F.coalesce(s["name"], F.lit("series")))), F.slice(values, F.lit(1), F.size(cats))))

    def plain_row(s: Column) -> Column:
        values = F.array_join(F.transform(s["values"], esc_html), ", ")
        return F.concat(F.lit("- "), esc_html(F.coalesce(s["name"], F.lit("series"))), F.lit(": "), F.when(values == "", "n/a").otherwise(values))

    table = F.concat(F.array(_pipes(F.concat(F.array(F.lit("series")), F.transform(cats, gfm_cell))), _pipes(F.array_repeat(F.lit("---"), F.size(cats) + 1))), F.transform(series, sheet_row))
    lines = F.when(F.size(cats) > 0, table).otherwise(F.transform(series, plain_row))
    refs = F.array_join(F.transform(F.coalesce(chart["series_refs"], F.array().cast("array<string>")), esc_html), ", ")
    sheet = F.when(F.size(series) > 0, F.concat_ws("\n", head, F.array_join(lines, "\n"))).otherwise(F.concat(head, F.lit(" data refs: "), F.when(refs == "", "n/a").otherwise(refs)))

    def deck_row(s: Column) -> Column:
        n = F.least(F.size(cats), F.size(s["values"]))
        pairs = F.zip_with(F.slice(cats, F.lit(1), n), F.slice(s["values"], F.lit(1), n), lambda c, v: _pair(esc_html(c), "=", esc_html(v)))
        return F.concat(F.lit("- "), esc_html(F.coalesce(s["name"], F.lit("None"))), F.lit(": "), F.array_join(pairs, ", "))

    deck = F.concat_ws("\n", head, F.when(F.size(series) > 0, F.array_join(F.transform(series, deck_row), "\n")))
    return F.when(F.col("format") == "pptx", deck).otherwise(sheet)


def element_markdown(assets: str | None = None, nested: Column | None = None) -> Column:
    """The Markdown of an element row, by its format and type; ``nested``: the HTML of tables with others in them, else null."""
    kind, fmt, raw = F.col("type"), F.col("format"), strip(F.coalesce("text", F.lit("")))
    text, level, note = esc_html(raw), F.col("level"), F.col("note")
    html = html_table(F.col("rows"), F.col("spans"))
    whole = F.lit(None).cast("string") if nested is None else nested
    table = F.when(whole.isNotNull(), whole).when(F.size("spans") > 0, html).otherwise(pipe_table(F.col("rows")))
    told = lambda start: F.concat(F.lit(start), F.when(note.isNotNull(), F.concat(F.lit(" · "), note)).otherwise(""), F.lit(" -->\n"))
    marks = F.repeat(F.lit("#"), F.coalesce(level, F.lit(2)))
    path = F.concat(F.lit(assets.rstrip("/") + "/"), F.regexp_extract("path", r"([^/\\]*)$", 1)) if assets else F.col("path")
    pdf = (
        F.when(kind == "heading", F.concat(marks, F.lit(" "), esc_md(raw)))
        .when(kind == "table", pipe_table(F.col("rows"), lambda c: F.replace(esc_inline(c), F.lit("\n"), F.lit(" "))))
        .when(kind == "image", F.concat(F.lit("!["), esc_inline(F.coalesce("text", "note", F.lit("image"))), F.lit("]("), F.coalesce(path, F.lit("")), F.lit(")")))
        .otherwise(esc_md(raw))
    )
    image = F.concat(F.lit("<!-- 🖼 "), F.when(fmt == "pptx", text).otherwise(F.coalesce("text", F.lit(""))), F.lit(": "), F.when(fmt == "pptx", esc_html(F.coalesce(note, F.lit("")))).otherwise(F.coalesce(note, F.lit(""))), F.lit(" -->"))
    named = (
        F.when(fmt == "docx", F.concat(F.lit("<!-- "), F.coalesce(note, F.lit("note")), F.lit(" --> "), text))
        .when(fmt == "pptx", F.concat(F.lit("> 🗒 **[notes]** "), text))
        .otherwise(text)
    )
    other = (
        F.when(kind == "heading", F.concat(F.when(fmt == "docx", marks).otherwise("##"), F.lit(" "), text))
        .when(kind == "list_item", F.concat(F.when(fmt == "pptx", F.repeat(F.lit("  "), F.coalesce(level, F.lit(0)))).otherwise(""), F.lit("- "), text))
        .when(kind == "textbox", F.concat(F.lit("> 📦 **[text box]** "), text))
        .when(kind == "note", named)
        .when(kind == "image", image)
        .when(kind == "chart", _chart(F.col("chart"), text))
        .when(kind == "table", F.when(fmt == "xlsx", F.concat(F.concat(F.lit("<!-- table "), F.coalesce("ref", F.lit(""))), told(""), table)).when(fmt == "docx", F.concat(told("<!-- table"), table)).otherwise(table))
        .otherwise(text)
    )
    return F.when(fmt == "pdf", pdf).otherwise(other)


def _unit_head(renders: str | None = None) -> Column:
    """Title line and notice of a unit; ``renders``: where pages that need vision are shown as images."""
    fmt, no = F.col("format"), F.col("unit_no").cast("string")
    low = F.col("confidence") < quality.VERIFY
    flags = F.when(F.size("flags") > 0, F.array_join("flags", ", ")).otherwise("none")
    told = F.concat(F.lit("("), F.col("confidence").cast("string"), F.lit("); verify. flags: "), flags)
    name = esc_html(F.coalesce("title", F.lit("")))
    head = (
        F.when(fmt == "xlsx", F.concat(F.lit("# Sheet: "), name))
        .when(fmt == "pptx", F.concat(F.lit("# Slide "), no, F.lit(": "), F.when(name == "", F.concat(F.lit("Slide "), no)).otherwise(name)))
        .when(fmt == "pdf", F.concat(F.lit("<!-- page "), no, F.lit(" · route="), F.try_element_at("props", F.lit("route")), F.lit(" -->")))
        .when(fmt.isin("hwp", "hwpx"), F.concat(F.lit("<!-- section "), comment_safe(F.coalesce("title", F.lit(""))), F.lit(" -->")))
    )
    ask: Column = F.lit("). Render with pdf-parse --render and replace this block with the transcription.")
    if renders:
        image = F.concat(F.lit(f"]({renders.rstrip('/')}/page_"), F.lpad(no, 3, "0"), F.lit(".png)"))
        ask = F.concat(F.lit("). Read the rendered image below and replace this block with the transcription.\n\n![page "), no, F.lit(" (rendered for vision)"), image)
    notice = (
        F.when((fmt == "xlsx") & low, F.concat(F.lit("> 🔎 Sheet '"), name, F.lit("' low parse confidence "), told))
        .when((fmt == "pptx") & low, F.concat(F.lit("> 🔎 Slide "), no, F.lit(" low parse confidence "), told))
        .when((fmt == "docx") & low, F.concat(F.lit("> 🔎 Low parse confidence "), told))
        .when((fmt == "pdf") & F.col("needs_vision"), F.concat(F.lit("> ⚠️ Page "), no, F.lit(" needs vision transcription ("), F.try_element_at("props", F.lit("reason")), ask))
    )
    # Units but the first are set apart by an empty piece.
    return F.concat_ws("\n\n", F.when((F.col("unit_no") > 1) & head.isNotNull(), ""), head, notice)


def covers_page(bbox: Column, area: Column, share: float = 0.9) -> Column:
    """Whether a box covers most of its page."""
    return F.coalesce(F.abs((bbox["x1"] - bbox["x0"]) * (bbox["y1"] - bbox["y0"])) >= share * area, F.lit(False)) & (area > 0)


def _once(elements: DataFrame) -> DataFrame:
    """Without images that cover a page which is shown as a whole anyway."""
    size = lambda k: F.try_element_at("props", F.lit(k)).cast("double")
    shown = elements.where("type = 'unit'").where(F.try_element_at("props", F.lit("needs_vision")) == "true").select("doc_id", "unit_no", (size("width") * size("height")).alias("_area"))
    return elements.join(shown, ["doc_id", "unit_no"], "left").where(~((F.col("type") == "image") & covers_page(F.col("bbox"), F.coalesce("_area", F.lit(0.0))))).drop("_area")


def to_markdown(elements: DataFrame, assets: str | None = None, nested: bool = True, renders: str | None = None) -> DataFrame:
    """(doc_id, markdown) of every document. ``nested``: whether tables in cells may occur; without them no rounds are made for them.
    ``assets`` and ``renders`` are the folders that images of pages and rendered pages are linked from."""
    source = F.regexp_extract("doc_id", r"([^/]*)$", 1)
    elements = _once(elements) if renders else elements
    heads = units(elements).select("doc_id", "unit_no", F.lit(0).alias("n"), F.lit(0).alias("elem_no"), _unit_head(renders).alias("piece"))
    body = elements.where("type not in ('unit', 'error')")
    if nested:
        keys = ["doc_id", "unit_no", "elem_no"]
        body = body.join(nested_html(body.where("type = 'table' and nested is not null").select(*keys, "rows", "spans", "nested"), keys).withColumnRenamed("html", "_html"), keys, "left")
    body = body.select("doc_id", "unit_no", F.lit(1).alias("n"), "elem_no", element_markdown(assets, F.col("_html") if nested else None).alias("piece"))
    pieces = heads.unionByName(body).where("piece <> ''")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "n", "elem_no", "piece"))), lambda x: x["piece"])
    top = F.concat(F.lit("<!-- parsed from "), esc_html(source), F.lit(" -->\n"))
    return pieces.groupBy("doc_id").agg(listed.alias("p")).select("doc_id", F.concat(strip(F.array_join(F.concat(F.array(top), F.col("p")), "\n\n")), F.lit("\n")).alias("markdown"))


# JSON


def _pruned(e: dict) -> dict:
    """An element as it is written: without what is null or empty, but nested nulls stay."""
    keep = {k: e[k] for k in ("type", "text", "level", "ref", "note", "path", "rows", "spans") if e.get(k) not in (None, "", [])}
    if e["format"] == "pptx":
        keep.pop("level", None)
        keep |= {"level": e["level"] or 0} if e["type"] == "list_item" else {}
    if e.get("bbox"):
        keep["bbox"] = [e["bbox"][k] for k in ("x0", "y0", "x1", "y1")]
    if e.get("nested"):
        keep["nested"] = json.loads(e["nested"])
    if c := e.get("chart"):
        deck = e["format"] == "pptx"
        keep["chart"] = {k: c[k] for k in ("kind", "title")} | {k: c[k] for k in ("series_refs", "categories", "series") if c[k] is not None}
        if deck:
            keep["chart"]["series"] = [{"name": s["name"], "values": [None if v == "None" else float(v) for v in s["values"]]} for s in c["series"] or []]
    return keep


def as_document(name: str, fmt: str, units: list[dict], elements: list[dict]) -> dict:
    """The JSON document of one file."""
    by_unit: dict[int, list] = {}
    for e in elements:
        by_unit.setdefault(e["unit_no"], []).append(_pruned(e))
    low = [u for u in units if u["confidence"] < quality.VERIFY]
    least = min((u["confidence"] for u in units), default=1.0)
    told = lambda u: {"confidence": u["confidence"], "flags": list(u["flags"])}
    if fmt == "docx":
        u = units[0]
        return {"source": name, "element_count": len(elements), **told(u), "needs_review": u["confidence"] < quality.VERIFY, "needs_vision": u["needs_vision"], "elements": by_unit.get(u["unit_no"], [])}
    if fmt == "xlsx":
        sheets = [{"name": u["title"], "table_count": u["tables"], **told(u), "elements": by_unit.get(u["unit_no"], [])} for u in units]
        return {"source": name, "sheet_count": len(units), "min_confidence": least, "verify_sheets": [u["title"] for u in low], "sheets": sheets}
    if fmt == "pptx":
        slides = [{"index": u["unit_no"], "title": u["title"] or "", "confidence": u["confidence"], "needs_vision": u["needs_vision"], "flags": list(u["flags"]), "elements": by_unit.get(u["unit_no"], [])} for u in units]
        return {"source": name, "slide_count": len(units), "min_confidence": least, "verify_slides": [u["unit_no"] for u in low], "vision_slides": [u["unit_no"] for u in units if u["needs_vision"]], "slides": slides}
    if fmt == "pdf":
        p = lambda u: dict(u["props"] or {})
        pages = [{"page": u["unit_no"], "route": p(u).get("route"), "width": float(p(u).get("width", 0)), "height": float(p(u).get("height", 0)), "needs_vision": u["needs_vision"], "reason": p(u).get("reason"), "elements": by_unit.get(u["unit_no"], [])} for u in units]
        return {"source": name, "page_count": len(units), "pages": pages}
    return {"source": name, "section_count": len(units), "sections": [{"name": u["title"], "elements": by_unit.get(u["unit_no"], [])} for u in units]}


def to_json(elements: DataFrame) -> DataFrame:
    """(doc_id, json) of every document."""

    def one(key, t: pd.DataFrame) -> pd.DataFrame:
        rows = [json.loads(x) for x in t.sort_values(["unit_no", "n", "elem_no"])["row"]]
        own = [r for r in rows if r["type"] == "unit"]
        rest = [r for r in rows if r["type"] != "unit"]
        made = as_document(os.path.basename(key[0]), key[1], own, rest)
        return pd.DataFrame({"doc_id": [key[0]], "json": [json.dumps(made, ensure_ascii=False, indent=2)]})

    keep = {"ignoreNullFields": "false"}
    heads = units(elements).withColumn("type", F.lit("unit"))
    heads = heads.select("doc_id", "format", "unit_no", F.lit(0).alias("n"), F.lit(0).alias("elem_no"), F.to_json(F.struct("type", "unit_no", "title", "flags", "confidence", "needs_vision", "tables", "props"), keep).alias("row"))
    body = elements.where("type not in ('unit', 'error')").select("doc_id", "format", "unit_no", F.lit(1).alias("n"), "elem_no", F.to_json(F.struct(*[c for c in elements.columns if c not in ("doc_id", "signals", "props", "error")]), keep).alias("row"))
    return heads.unionByName(body).groupBy("doc_id", "format").applyInPandas(one, "doc_id string, json string")


def stems(ids: DataFrame) -> DataFrame:
    """(doc_id, stem) of distinct doc_ids: the base name without its ending; where others have that too, in any case of
    letters, the base name with the ending and sixteen digits of the doc_id's SHA-256, so that documents never share a file."""
    base = F.regexp_extract("doc_id", r"([^/\\]*)[/\\]*$", 1)
    short = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    named = ids.select("doc_id", base.alias("_base"), F.when(short == "", "document").otherwise(short).alias("_short")).withColumn("_key", F.lower("_short"))
    count = named.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    digest = F.substring(F.sha2(F.col("doc_id"), 256), 1, 16)
    return named.join(count, "_key", "left").select("doc_id", F.when(F.col("_n").isNull(), F.col("_short")).otherwise(F.concat_ws("-", "_base", digest)).alias("stem"))


def write(elements: DataFrame, folder: str, assets: str | None = None, renders: str | None = None) -> DataFrame:
    """Write <stem>.md and <stem>.json (``stems``) of every document into a folder, from executors; ``assets`` and ``renders`` as
    in ``to_markdown``. Returns (doc_id, stem)."""
    from .sources import sink

    sink.register(elements.sparkSession)
    named = stems(elements.select("doc_id").distinct())
    both = to_markdown(elements, assets, renders=renders).join(to_json(elements), "doc_id").join(named, "doc_id")
    file = lambda end, body: F.struct(F.concat("stem", F.lit(end)).alias("name"), F.col(body).alias("body"))
    both.select(F.inline(F.array(file(".md", "markdown"), file(".json", "json")))).write.format("text_files").mode("append").save(folder)
    return named


def save(elements: DataFrame, folder: str, assets: str | None = None, renders: str | None = None) -> Iterator[tuple[str, str]]:
    """``write``, then the paths of each document's two files."""
    for r in write(elements, folder, assets, renders).toLocalIterator():
        yield tuple(os.path.join(folder, r.stem + end) for end in (".md", ".json"))


def crosscheck(path: str) -> str | None:
    """A second opinion by an optional converter; None where it isn't installed."""
    try:
        from markitdown import MarkItDown
    except ImportError:
        return None
    return MarkItDown().convert(path).text_content
