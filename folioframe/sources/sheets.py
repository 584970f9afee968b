"""Workbooks as atoms: sheets, cells, merged ranges and chart points in one table; ``operators.sheets`` makes elements of them."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sheets
from . import office
from .office import attr, child, local

#: ``atom`` says what a row is: a sheet, a cell, a merge (from row, col to row1, col1) or a point of a chart; other columns are null.
ATOMS = (
    "doc_id string, atom string, sheet_no int, name string, row int, col int, row1 int, col1 int, kind string, text string, formula string, "
    "chart_no int, plot string, title string, series int, role string, ref string, literal string, idx int, value string, error string"
)
_NAMES = [x.split()[0] for x in ATOMS.split(", ")][1:-1]


def chart_kind(element: str) -> str:
    """Class names of charts: barChart is BarChart, bar3DChart BarChart3D."""
    name = element.removesuffix("Chart")
    deep = name.endswith("3D")
    name = {"ofPie": "projectedPie"}.get(name.removesuffix("3D"), name.removesuffix("3D"))
    return name[0].upper() + name[1:] + "Chart" + ("3D" if deep else "")


def _plain(v: str) -> str:
    """A stored value as a cell would show it."""
    return office._number(v) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", v) else " ".join(v.split())


def _points(root: ET.Element, first: int) -> Iterator[dict]:
    """The points of a chart part, whose plots are numbered from ``first``."""
    chart = child(root, "chart")
    head, area = child(chart, "title"), child(chart, "plotArea")
    title = "".join(t.text or "" for t in head.iter() if local(t.tag) == "t").strip() or None if head is not None else None
    for no, plot in enumerate((x for x in area if local(x.tag).endswith("Chart")) if area is not None else (), first):
        own = {"atom": "point", "chart_no": no, "plot": chart_kind(local(plot.tag)), "title": title}
        yield own | {"role": "plot"}
        for k, s in enumerate(x for x in plot if local(x.tag) == "ser"):
            for role, tags in (("name", ("tx",)), ("cat", ("cat", "xVal")), ("val", ("val", "yVal"))):
                part = next((p for t in tags if (p := child(s, t)) is not None), None)
                ref = literal = None
                stored: list = []
                if part is not None:
                    ref = next((x.text for x in part.iter() if local(x.tag) == "f"), None)
                    stored = [(int(attr(p, "idx")), v.text or "") for p in part.iter() if local(p.tag) == "pt" and (v := child(p, "v")) is not None]
                    literal = child(part, "v").text if role == "name" and child(part, "v") is not None else None
                told = own | {"series": k, "role": role, "ref": ref, "literal": literal}
                yield from [told | {"idx": i, "value": _plain(v)} for i, v in stored] or [told]


def _related(z: zipfile.ZipFile, name: str) -> list[tuple[str, str]]:
    folder, base = posixpath.split(name)
    try:
        rels = ET.fromstring(z.read(f"{folder}/_rels/{base}.rels"))
    except KeyError:
        return []
    return [(attr(r, "Type").rsplit("/", 1)[-1], t.lstrip("/") if (t := attr(r, "Target")).startswith("/") else posixpath.normpath(f"{folder}/{t}")) for r in rels]


def xlsx_atoms(data: bytes) -> Iterator[tuple]:
    def row(**values) -> tuple:
        return tuple(values.get(n) for n in _NAMES)

    numbers: dict[str, int] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {attr(r, "Id"): attr(r, "Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, s in enumerate(child(ET.fromstring(z.read("xl/workbook.xml")), "sheets")):
            target = targets[attr(s, "id")]
            numbers[attr(s, "name")] = k
            yield row(atom="sheet", sheet_no=k, name=attr(s, "name"))
            n = 0
            for kind, drawing in _related(z, target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")):
                for what, part in _related(z, drawing) if kind == "drawing" else ():
                    if what == "chart":
                        points = list(_points(ET.fromstring(z.read(part)), n))
                        n = max((p["chart_no"] + 1 for p in points), default=n)
                        yield from (row(sheet_no=k, **p) for p in points)
    for _, no, r, c, kind, text, formula in office.xlsx_cells(data):
        yield row(atom="cell", sheet_no=no, row=r, col=c, kind=kind, text=text, formula=formula)
    for name, r0, c0, r1, c1 in office.xlsx_merges(data):
        yield row(atom="merge", sheet_no=numbers[name], row=r0, col=c0, row1=r1, col1=c1)


DECODERS = {"xlsx_atoms": (xlsx_atoms, ATOMS)}


def elements(files: DataFrame, strict: bool = False, store: str | None = None) -> DataFrame:
    """Units and elements of workbooks (path, content), without those that are null for all of them. ``store``: a folder that all
    executors see, into which the atoms are written, so that each file is decoded once; without it each kind of atom decodes its
    files anew."""
    atoms = office.decode(files, "xlsx_atoms", strict).withColumn("atom", F.coalesce("atom", F.lit("error")))
    if store:
        path = f"{store.rstrip('/')}/atoms-{uuid.uuid4().hex}"
        atoms.write.partitionBy("atom").parquet(path)
        atoms = files.sparkSession.read.schema(atoms.schema).parquet(path)
    of = lambda kind, *columns: atoms.where(F.col("atom") == kind).select("doc_id", "sheet_no", *columns)
    merges = of("merge", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("row1").alias("r1"), F.col("col1").alias("c1"))
    points = of("point", "chart_no", "plot", "title", "series", "role", "ref", "literal", "idx", "value")
    found = sheets.elements(of("sheet", "name"), of("cell", "row", "col", "kind", "text", "formula"), merges, points)
    bad = atoms.where("atom = 'error'").select("doc_id", F.lit("error").alias("type"), "error")
    return found.unionByName(bad, allowMissingColumns=True).withColumn("format", F.lit("xlsx"))
