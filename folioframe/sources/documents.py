"""Files as ordered elements and units, one schema for all families (``schema.ELEMENTS``)."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..operators import records
from ..operators import slides as slide_operators
from ..schema import ELEMENTS, shaped
from . import hangul, office, sheets, slides
from .office import attr, child, local

# Word


def heading_level(style: str) -> int | None:
    m = re.match(r"Heading (\d+)", style or "")
    return min(int(m[1]), 6) if m else 1 if style == "Title" else None


def word_table(tbl: ET.Element) -> dict:
    """rows, spans and nested tables of a table; places that a merge covers are blank."""
    rows, spans, nested, open_ = [], [], [], {}
    for r, tr in enumerate(x for x in tbl if local(x.tag) == "tr"):
        row: list[str] = []
        for tc in (x for x in tr if local(x.tag) == "tc"):
            width, merge = child(tc, "tcPr", "gridSpan"), child(tc, "tcPr", "vMerge")
            width = int(attr(width, "val") or 1) if width is not None else 1
            col = len(row)
            for inner in (x for x in tc if local(x.tag) == "tbl"):
                t = word_table(inner)
                if any(map(any, t["rows"])):
                    nested.append({"row": r, "col": col, **t})
            text = " / ".join(t for p in tc if local(p.tag) == "p" and (t := office._run_text(p).strip()))
            if merge is not None and (attr(merge, "val") or "continue") == "continue":
                text = ""
                if col in open_:
                    open_[col]["rowspan"] += 1
            elif merge is not None or width > 1:
                spans.append({"row": r, "col": col, "rowspan": 1, "colspan": width})
                if merge is not None:
                    open_[col] = spans[-1]
            row += [text] + [""] * (width - 1)
        rows.append(row)
    return {"rows": rows, "spans": spans, "nested": nested}


def _margins(z: zipfile.ZipFile, body: ET.Element) -> Iterator[tuple[str, str]]:
    """(kind, text) of the headers and footers of all sections, each text once."""
    targets = {}
    try:
        for r in ET.fromstring(z.read("word/_rels/document.xml.rels")):
            targets[attr(r, "Id")] = attr(r, "Target")
    except KeyError:
        pass
    seen: set[str] = set()
    for section in (x for x in body.iter() if local(x.tag) == "sectPr"):
        for kind in ("header", "footer"):
            for ref in (x for x in section if local(x.tag) == f"{kind}Reference" and (attr(x, "type") or "default") == "default"):
                key = next((v for n, v in ref.attrib.items() if n.endswith("}id")), None)
                if key in targets:
                    part = ET.fromstring(z.read(posixpath.normpath(f"word/{targets[key]}")))
                    text = "\n".join(t for p in part if local(p.tag) == "p" and (t := office._run_text(p)).strip()).strip()
                    if text and text not in seen:
                        seen.add(text)
                        yield kind, text


def word(data: bytes) -> Iterator[dict]:
    """A document is one unit: body in order, text boxes before their paragraph, then headers and footers, then images."""
    out: list[dict] = []
    signals: dict[str, None] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
        body = child(root, "body")
        tables = iter([x for x in body if local(x.tag) == "tbl"])
        for _, kind, style, listed, text, _ in office.docx_blocks(data):
            if kind == "textbox":
                out.append({"type": "textbox", "text": text, "note": "text recovered from a text box"})
                signals["textbox"] = None
            elif kind == "table":
                t = word_table(next(tables))
                if not any(any(r) for r in t["rows"]):
                    continue
                signals |= {k: None for k, v in (("merged", t["spans"]), ("nested", t["nested"])) if v}
                out.append({"type": "table", "rows": t["rows"], "spans": t["spans"] or None, "nested": json.dumps(t["nested"], ensure_ascii=False) if t["nested"] else None, "note": "nested-table" if t["nested"] else None})
            elif text:
                level = heading_level(style)
                out.append({"type": "heading", "text": text, "level": level} if level else {"type": "list_item" if listed or (style or "").startswith("List") else "paragraph", "text": text})
        bearing = len(out)
        out += [{"type": "note", "text": text, "note": kind} for kind, text in _margins(z, body)]
        images = sum(local(x.tag) == "blip" for x in body.iter())
        if images:
            blind = not bearing
            signals |= {"images": None} | ({"vision": None} if blind else {})
            out.append({"type": "image", "text": f"{images} embedded image(s)", "note": "image-only document — render and transcribe with a vision model" if blind else "images are referenced but not extracted in this pass"})
        if any(local(x.tag) in ("ins", "del") for x in body.iter()):
            signals["tracked"] = None
        try:
            if any("comments" in attr(r, "Type") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))):
                signals["comments"] = None
        except KeyError:
            pass
    yield {"type": "unit", "unit_no": 1, "signals": list(signals)}
    yield from ({"unit_no": 1} | e for e in out)


# Hangul, zipped


def hwpx(data: bytes) -> Iterator[dict]:
    """Units are sections; paragraphs in order, and tables at the places of their grids."""
    for no, (name, found) in enumerate(hangul.sections(data), 1):
        yield {"type": "unit", "unit_no": no, "text": name, "signals": []}
        for e in found:
            yield {"unit_no": no} | e


READERS = {"docx": word, "hwp": hwpx, "hwpx": hwpx}
WORKBOOKS, DECKS = ("xlsx", "xlsm"), ("pptx",)


def elements(files: DataFrame, strict: bool = False, store: str | None = None) -> DataFrame:
    """Rows of ``schema.ELEMENTS`` of files (path, content), by the file's ending. A file that can't be read gives one row
    with ``error``; ``strict`` raises instead. ``store`` as in ``sheets.elements``."""
    book, deck = _ending().isin(*WORKBOOKS), _ending().isin(*DECKS)
    return _all(files.where(~book & ~deck), files.where(deck), files.where(book), strict, store)


def _all(others: DataFrame, decks: DataFrame, books: DataFrame, strict: bool, store: str | None) -> DataFrame:
    return _others(others, strict).unionByName(from_decks(decks, strict)).unionByName(shaped(sheets.elements(books, strict, store)))


def _ending() -> Column:
    return F.lower(F.regexp_extract("path", r"([^./\\]*)$", 1))


def _others(files: DataFrame, strict: bool) -> DataFrame:
    """Binary hwp files, whatever their ending says, by their records; the rest by readers of whole files."""
    binary = _ending().isin("hwp", "hwpx") & (F.substring("content", 1, len(hangul.MAGIC)) == F.lit(hangul.MAGIC))
    return _read(files.where(~binary), strict).unionByName(from_records(files.where(binary), strict))


def from_decks(files: DataFrame, strict: bool = False) -> DataFrame:
    """Elements of pptx files, each decoded once; units are slides in order."""
    found = slide_operators.elements(_decoded(files, lambda _, data: slides.atoms(data), slide_operators.ATOMS, strict))
    return shaped(found.withColumn("format", F.lit("pptx")))


def from_records(files: DataFrame, strict: bool = False) -> DataFrame:
    """Elements of binary hwp files; units are sections that have records."""
    atoms = office.decode(files, "hwp_records", strict).withColumn("format", F.lower(F.regexp_extract("doc_id", r"([^./\\]*)$", 1)))
    good = atoms.where("error is null")
    sections = good.select("doc_id", "format", "section", "section_no").distinct().withColumn("unit_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no")))
    found = records.elements(good.select("doc_id", "section", "rec", "tag", "level", "text", "payload"))
    found = found.withColumn("elem_no", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("rec"))).join(sections, ["doc_id", "section"])
    units = sections.select("doc_id", "format", "unit_no", F.lit(0).alias("elem_no"), F.lit("unit").alias("type"), F.col("section").alias("text"), F.array().cast("array<string>").alias("signals"))
    bad = atoms.where("error is not null").select("doc_id", "format", F.lit("error").alias("type"), "error")
    return shaped(found.drop("section", "section_no", "rec").unionByName(units, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True))


def _decoded(files: DataFrame, read: Callable[[str, bytes], Iterator[dict]], schema: str, strict: bool) -> DataFrame:
    """What ``read`` finds in files (path, content), as rows of ``schema``, which has doc_id and error; what it leaves out is null.
    A file that can't be read gives one row with ``error``; ``strict`` raises instead."""
    shape = to_arrow_schema(_parse_datatype_string(schema))
    blank = dict.fromkeys(f.name for f in shape)

    def rows(path: str, data: bytes) -> list[dict]:
        try:
            return [blank | {"doc_id": path} | e for e in read(path, data)]
        except Exception as e:  # a damaged file is reported in its row
            if strict:
                raise
            return [blank | {"doc_id": path, "error": f"{type(e).__name__}: {e}"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if found := rows(path, data):
                    yield pa.RecordBatch.from_pylist(found, shape)

    return files.select("path", F.col("content")).mapInArrow(run, schema)


def _read(files: DataFrame, strict: bool) -> DataFrame:
    """Elements of files by readers of whole files, by the file's ending."""
    kind = lambda path: path.rsplit(".", 1)[-1].lower()
    found = _decoded(files, lambda path, data: _numbered(READERS[kind(path)](data)), ELEMENTS, strict)
    return found.withColumns({"format": F.lower(F.regexp_extract("doc_id", r"([^./\\]*)$", 1)), "type": F.when(F.col("error").isNotNull(), "error").otherwise(F.col("type"))})


def _numbered(elements: Iterator[dict]) -> Iterator[dict]:
    """With their place within their unit."""
    last, nth = None, 0
    for e in elements:
        nth = 0 if e["unit_no"] != last else nth + 1
        last = e["unit_no"]
        yield {"elem_no": nth} | e


def read_documents(spark: SparkSession, path: str, strict: bool = False, store: str | None = None) -> DataFrame:
    """``elements`` of a folder; workbooks, decks and other files are listed apart, so that no scan reads another's."""
    endings = lambda kinds: ",".join(x for k in kinds for x in (k, k.upper()))
    scan = lambda kinds: spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + endings(kinds) + "}").load(path)
    return _all(scan(READERS), scan(DECKS), scan(WORKBOOKS), strict, store)
