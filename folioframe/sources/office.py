"""Decoders of zipped office files (docx, xlsx, hwpx) into atom rows, with the standard library only.

``binaryFile`` gives one row per file; a decoder turns it into rows of one atom table. A file that can't be decoded
gives one row with ``error`` set and never fails the task; ``strict`` raises instead.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "doc_id string, ord int, kind string, style string, listed boolean, text string, table_id int, error string"
TABLE_CELLS = "doc_id string, table_id int, parent int, row int, cell int, gridspan int, vmerge string, text string, error string"
CELLS = "doc_id string, sheet string, sheet_no int, row int, col int, kind string, text string, formula string, error string"
MERGES = "doc_id string, sheet string, min_row int, min_col int, max_row int, max_col int, error string"
PARAGRAPHS = "doc_id string, section string, ord int, text string, error string"


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def child(e: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        e = next((x for x in e if local(x.tag) == name), None) if e is not None else None
    return e


def _part(data: bytes, name: str) -> ET.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ET.fromstring(z.read(name))


# Word


def _run_text(p: ET.Element) -> str:
    """Text of a paragraph's own runs, not of text boxes in it."""
    out = []

    def walk(e: ET.Element) -> None:
        for x in e:
            name = local(x.tag)
            if name == "t":
                out.append(x.text or "")
            elif name == "tab":
                out.append("\t")
            elif name in ("br", "cr"):
                out.append("\n")
            elif name in ("r", "hyperlink", "ins", "smartTag", "sdt", "sdtContent"):
                walk(x)

    walk(p)
    return "".join(out)


def _style(p: ET.Element, names: dict[str, str]) -> str:
    s = child(p, "pPr", "pStyle")
    key = attr(s, "val") if s is not None else None
    return names.get(key, key) or "Normal"


def docx_blocks(data: bytes) -> Iterator[tuple]:
    """(ord, kind, style, listed, text, table_id) of the body's own paragraphs and tables, text boxes before their paragraph."""
    body, names = child(_part(data, "word/document.xml"), "body"), {}
    try:
        for s in _part(data, "word/styles.xml"):
            if local(s.tag) == "style" and (n := child(s, "name")) is not None:
                names[attr(s, "styleId")] = attr(n, "val")
    except KeyError:
        pass
    at = tables = 0
    for e in body:
        if local(e.tag) == "p":
            for box in (x for x in e.iter() if local(x.tag) == "txbxContent"):
                text = " ".join("".join(t.text or "" for t in box.iter() if local(t.tag) == "t").split())
                if text:
                    yield at, "textbox", None, False, text, None
                    at += 1
            yield at, "paragraph", _style(e, names), child(e, "pPr", "numPr") is not None, _run_text(e).strip(), None
            at += 1
        elif local(e.tag) == "tbl":
            yield at, "table", None, False, None, tables
            at, tables = at + 1, tables + 1 + sum(1 for x in e.iter() if local(x.tag) == "tbl" and x is not e)


def docx_cells(data: bytes) -> Iterator[tuple]:
    """(table_id, parent table, row, cell, gridspan, vmerge, text) of all tables, nested ones numbered after their host."""
    number = -1

    def walk(tbl: ET.Element, parent: int | None) -> Iterator[tuple]:
        nonlocal number
        number += 1
        own, row = number, -1
        for tr in (x for x in tbl if local(x.tag) == "tr"):
            row += 1
            for cell, tc in enumerate(x for x in tr if local(x.tag) == "tc"):
                span, merge = child(tc, "tcPr", "gridSpan"), child(tc, "tcPr", "vMerge")
                texts = [t for p in tc if local(p.tag) == "p" and (t := _run_text(p).strip())]
                yield own, parent, row, cell, int(attr(span, "val") or 1) if span is not None else 1, (attr(merge, "val") or "continue") if merge is not None else None, " / ".join(texts)
                for inner in (x for x in tc if local(x.tag) == "tbl"):
                    yield from walk(inner, own)

    for tbl in (x for x in child(_part(data, "word/document.xml"), "body") if local(x.tag) == "tbl"):
        yield from walk(tbl, None)


# Excel


def _number(text: str) -> str:
    """A number as its text: whole numbers without a fraction."""
    v = float(text)
    return str(int(v)) if v.is_integer() else repr(v)


def _a1(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(row), col


_PLACE = re.compile(r"(?<![A-Za-z0-9_.$!'])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(.])|((?:'(?:[^']|'')+'|[A-Za-z_][\w.]*)!)(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(.])")


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def moved(formula: str, rows: int, cols: int) -> str:
    """A formula as it reads some rows and columns further on: places without a dollar move, texts in quotes don't."""

    def place(m: re.Match) -> str:
        sheet, k = (m[5], 6) if m[5] else ("", 1)
        fixed_col, col, fixed_row, row = m[k], m[k + 1], m[k + 2], int(m[k + 3])
        if not fixed_col:
            _, number = _a1(f"{col}1")
            col = _letters(number + cols)
        return f"{sheet}{fixed_col}{col}{fixed_row}{row if fixed_row else row + rows}"

    return "".join(x if x.startswith('"') else _PLACE.sub(place, x) for x in re.split(r'("(?:[^"]|"")*")', formula))


#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or a time."""
    try:
        root = ET.fromstring(z.read("xl/styles.xml"))
    except KeyError:
        return set()
    own = {int(attr(f, "numFmtId")): attr(f, "formatCode") or "" for f in root.iter() if local(f.tag) == "numFmt"}
    shows = lambda code: re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|General', "", code), re.I) is not None
    dates = DATE_FORMATS | {k for k, code in own.items() if shows(code)}
    dates -= {k for k, code in own.items() if not shows(code)}
    formats = child(root, "cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if int(attr(x, "numFmtId") or 0) in dates}


def _date(serial: float, from_1904: bool) -> str:
    """A serial number as its date, or its time where it is less than a day; rounded to microseconds."""
    if 0 <= serial < 1 and not from_1904:
        return str((datetime.datetime(1900, 1, 1) + datetime.timedelta(days=serial)).time())
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31) if serial < 60 else datetime.datetime(1899, 12, 30)
    return str(start + datetime.timedelta(microseconds=round(serial * 86_400_000_000)))


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[int, str, ET.Element]]:
    targets = {attr(r, "Id"): attr(r, "Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for k, s in enumerate(child(ET.fromstring(z.read("xl/workbook.xml")), "sheets")):
        target = targets[attr(s, "id")]
        yield k, attr(s, "name"), ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))


def xlsx_cells(data: bytes) -> Iterator[tuple]:
    """(sheet, sheet_no, row, col, kind, text, formula): kind n, d (a date), s, b, e, or f for a formula without a stored value."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        dates = _date_styles(z)
        old = any(local(x.tag) == "workbookPr" and attr(x, "date1904") in ("1", "true") for x in ET.fromstring(z.read("xl/workbook.xml")))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        for no, name, root in _sheets(z):
            masters: dict[str, tuple[int, int, str]] = {}
            for c in (x for x in root.iter() if local(x.tag) == "c"):
                row, col = _a1(attr(c, "r"))
                v, f, kind = child(c, "v"), child(c, "f"), attr(c, "t") or "n"
                raw = v.text if v is not None else None
                if kind == "inlineStr":
                    kind, raw = "s", "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")
                elif kind == "s":
                    raw = shared[int(raw)] if raw is not None else None
                elif kind == "b":
                    raw = str(raw == "1")
                elif kind == "n" and raw is not None and int(attr(c, "s") or 0) in dates:
                    kind, raw = "d", _date(float(raw), old)
                elif kind == "d" and raw is not None:
                    raw = raw.replace("T", " ").removesuffix("Z")
                elif kind == "n" and raw is not None:
                    raw = _number(raw)
                formula = "=" + (f.text or "") if f is not None else None
                if f is not None and attr(f, "t") == "shared":
                    if f.text:
                        masters[attr(f, "si")] = (row, col, f.text)
                    elif attr(f, "si") in masters:
                        r0, c0, body = masters[attr(f, "si")]
                        formula = "=" + moved(body, row - r0, col - c0)
                if raw is None and formula is None:
                    continue
                yield name, no, row, col, "f" if raw is None else "s" if kind == "str" else kind, " ".join((formula if raw is None else raw).split()), formula


def xlsx_merges(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for _, name, root in _sheets(z):
            for m in (x for x in root.iter() if local(x.tag) == "mergeCell"):
                a, _, b = attr(m, "ref").partition(":")
                (r0, c0), (r1, c1) = _a1(a), _a1(b or a)
                yield name, r0, c0, r1, c1


# Hangul


def is_hwpx(data: bytes) -> bool:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            return any(n.startswith("Contents/section") for n in names) or ("mimetype" in names and z.read("mimetype").strip() == b"application/hwp+zip")
    except zipfile.BadZipFile:
        return False


def hwpx_paragraphs(data: bytes) -> Iterator[tuple]:
    """(section, ord, text) of all paragraphs with their own runs; sections in numeric order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n)))
        for _, name in found:
            for k, p in enumerate(x for x in ET.fromstring(z.read(name)).iter() if local(x.tag) == "p"):
                out = []
                for t in (t for r in p if local(r.tag) == "run" for t in r if local(t.tag) == "t"):
                    out.append(t.text or "")
                    for x in t.iter():
                        if x is not t:
                            out.append({"lineBreak": "\n", "tab": "\t"}.get(local(x.tag), x.text or ""))
                            out.append(x.tail or "")
                yield name, k, "".join(out)


DECODERS = {
    "docx_blocks": (docx_blocks, BLOCKS),
    "docx_cells": (docx_cells, TABLE_CELLS),
    "xlsx_cells": (xlsx_cells, CELLS),
    "xlsx_merges": (xlsx_merges, MERGES),
    "hwpx_paragraphs": (hwpx_paragraphs, PARAGRAPHS),
}


def decode(files: DataFrame, decoder: str, strict: bool = False) -> DataFrame:
    """Atom rows of files with columns path and content."""
    read, schema = DECODERS[decoder]
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(path: str, data: bytes) -> list[tuple]:
        try:
            return [(path, *r, None) for r in read(data)]
        except Exception as e:  # a damaged file is reported in its row
            if strict:
                raise
            return [(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(rows(path, bytes(data)), columns=names, dtype=object)

    return files.select("path", F.col("content")).mapInPandas(run, schema)


def read_office(spark: SparkSession, path: str, decoder: str, strict: bool = False) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path), decoder, strict)
