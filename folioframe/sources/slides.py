"""Decoder of pptx files into atoms (``operators.slides.ATOMS``), with the standard library only.

Slides come in presentation order. Groups are flattened, child positions stay as they are stored, and a place that a shape
doesn't state is null. Inherited places, reading order, titles, flags and confidence are for the operators, over these atoms.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from .office import attr, child, local

PLACE = ("top", "left", "height", "width")


class Deck:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))

    def part(self, name: str) -> ET.Element:
        return ET.fromstring(self.zip.read(name))

    def related(self, name: str) -> dict[str, tuple[str, str]]:
        """Relation id -> (kind, part) of a part."""
        folder, base = posixpath.split(name)
        try:
            rels = self.part(f"{folder}/_rels/{base}.rels")
        except KeyError:
            return {}
        whole = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{folder}/{t}")
        return {attr(r, "Id"): (attr(r, "Type").rsplit("/", 1)[-1], whole(attr(r, "Target"))) for r in rels}

    def slides(self) -> Iterator[tuple[int, str, ET.Element]]:
        """(number from 1, part, root) in presentation order."""
        name = "ppt/presentation.xml"
        related, listed = self.related(name), child(self.part(name), "sldIdLst")
        for k, s in enumerate(listed if listed is not None else (), 1):
            key = next(v for n, v in s.attrib.items() if n.endswith("}id"))
            yield k, related[key][1], self.part(related[key][1])


def _leaves(tree: ET.Element, grouped: bool = False) -> Iterator[tuple[ET.Element, bool]]:
    for e in tree:
        if local(e.tag) == "grpSp":
            yield from _leaves(e, True)
        elif local(e.tag) in ("sp", "pic", "graphicFrame", "cxnSp"):
            yield e, grouped


def _shapes(root: ET.Element) -> Iterator[tuple[int, ET.Element, bool]]:
    tree = child(root, "cSld", "spTree")
    for k, (e, grouped) in enumerate(_leaves(tree) if tree is not None else ()):
        yield k, e, grouped


def _placeholder(e: ET.Element) -> tuple[str | None, int | None]:
    """Type and index."""
    ph = next((x for part in e if local(part.tag).startswith("nv") for x in part.iter() if local(x.tag) == "ph"), None)
    return (attr(ph, "type") or "obj", int(attr(ph, "idx") or 0)) if ph is not None else (None, None)


def _graphic(e: ET.Element, name: str) -> ET.Element | None:
    data = child(e, "graphic", "graphicData")
    return child(data, name) if data is not None else None


def _kind(e: ET.Element) -> str:
    name = local(e.tag)
    if name == "graphicFrame":
        return "table" if _graphic(e, "tbl") is not None else "chart" if _graphic(e, "chart") is not None else "other"
    return {"sp": "text", "pic": "picture"}.get(name, "other")


def _box(e: ET.Element) -> list[int | None]:
    """Top, left, height and width as the shape itself states them."""
    frame = child(e, "xfrm")
    frame = frame if frame is not None else child(e, "spPr", "xfrm")
    off, ext = (child(frame, n) if frame is not None else None for n in ("off", "ext"))
    number = lambda x, n: int(attr(x, n) or 0) if x is not None else None
    return [number(off, "y"), number(off, "x"), number(ext, "cy"), number(ext, "cx")]


def _text(p: ET.Element) -> str:
    """A paragraph's runs and fields; a line break is a vertical tab, as in the file's own model."""
    out = []
    for x in p:
        if local(x.tag) in ("r", "fld"):
            t = child(x, "t")
            out.append(t.text or "" if t is not None else "")
        elif local(x.tag) == "br":
            out.append("\v")
    return "".join(out)


def _paragraphs(body: ET.Element | None) -> list[ET.Element]:
    return [p for p in body if local(p.tag) == "p"] if body is not None else []


def _bullet(p: ET.Element) -> str:
    own = child(p, "pPr")
    names = {local(x.tag) for x in own} if own is not None else set()
    return "none" if "buNone" in names else "bullet" if names & {"buChar", "buAutoNum", "buBlip"} else "inherit"


def _cells(tbl: ET.Element) -> list[list[dict]]:
    cell = lambda tc, hidden: {"text": "" if hidden else " ".join(_lines(tc).split()), "rowspan": int(attr(tc, "rowSpan") or 1), "colspan": int(attr(tc, "gridSpan") or 1), "covered": hidden}
    covered = lambda tc: any(attr(tc, n) in ("1", "true") for n in ("hMerge", "vMerge"))
    return [[cell(tc, covered(tc)) for tc in tr if local(tc.tag) == "tc"] for tr in tbl if local(tr.tag) == "tr"]


def _lines(e: ET.Element) -> str:
    return "\n".join(_text(p) for p in _paragraphs(child(e, "txBody")))


def _points(e: ET.Element | None) -> dict[int, str]:
    return {int(attr(x, "idx")): v.text or "" for x in e.iter() if local(x.tag) == "pt" and (v := child(x, "v")) is not None} if e is not None else {}


#: Names and numbers of chart types, by plot, direction or style, and grouping.
CHART_TYPES = {
    "bar col clustered": "COLUMN_CLUSTERED (51)", "bar col stacked": "COLUMN_STACKED (52)", "bar col percentStacked": "COLUMN_STACKED_100 (53)",
    "bar bar clustered": "BAR_CLUSTERED (57)", "bar bar stacked": "BAR_STACKED (58)", "bar bar percentStacked": "BAR_STACKED_100 (59)",
    "line plain standard": "LINE (4)", "line plain stacked": "LINE_STACKED (63)", "line plain percentStacked": "LINE_STACKED_100 (64)",
    "line markers standard": "LINE_MARKERS (65)", "line markers stacked": "LINE_MARKERS_STACKED (66)", "line markers percentStacked": "LINE_MARKERS_STACKED_100 (67)",
    "area standard": "AREA (1)", "area stacked": "AREA_STACKED (76)", "area percentStacked": "AREA_STACKED_100 (77)",
    "pie": "PIE (5)", "pie exploded": "PIE_EXPLODED (69)", "doughnut": "DOUGHNUT (-4120)", "doughnut exploded": "DOUGHNUT_EXPLODED (80)",
    "radar standard": "RADAR (-4151)", "radar marker": "RADAR_MARKERS (81)", "radar filled": "RADAR_FILLED (82)", "bubble": "BUBBLE (15)",
    "scatter lineMarker": "XY_SCATTER_LINES (74)", "scatter plain": "XY_SCATTER (-4169)", "scatter smoothMarker": "XY_SCATTER_SMOOTH (72)",
}


def chart_type(plot: ET.Element) -> str:
    """The name of a plot's chart type, or its element where there is none."""
    kind = local(plot.tag).removesuffix("Chart")
    of = lambda name, default: (attr(x, "val") or default) if (x := child(plot, name)) is not None else default
    exploded = any(local(x.tag) == "explosion" for x in plot.iter())
    plain = all(attr(x, "val") == "none" for x in plot.iter() if local(x.tag) == "symbol") and any(local(x.tag) == "symbol" for x in plot.iter())
    key = {
        "bar": f"bar {of('barDir', 'col')} {of('grouping', 'clustered')}",
        "line": f"line {'plain' if plain else 'markers'} {of('grouping', 'standard')}",
        "area": f"area {of('grouping', 'standard')}",
        "pie": "pie exploded" if exploded else "pie",
        "doughnut": "doughnut exploded" if exploded else "doughnut",
        "radar": f"radar {of('radarStyle', 'standard')}",
        "scatter": f"scatter {of('scatterStyle', 'lineMarker')}",
    }.get(kind, kind)
    return CHART_TYPES.get(key, local(plot.tag))


def _chart(root: ET.Element) -> dict:
    chart = child(root, "chart")
    head = child(chart, "title")
    title = "".join(t.text or "" for t in head.iter() if local(t.tag) == "t").strip() or None if head is not None else None
    plots = [x for x in child(chart, "plotArea") if local(x.tag).endswith("Chart")]
    series = [s for p in plots for s in p if local(s.tag) == "ser"]
    first = _points(child(series[0], "cat")) if series else {}

    def values(s: ET.Element) -> list[str]:
        part = child(s, "val") if child(s, "val") is not None else child(s, "yVal")
        points = _points(part)
        count = next((int(attr(x, "val")) for x in part.iter() if local(x.tag) == "ptCount"), len(points)) if part is not None else 0
        return [repr(float(points[i])) if i in points else "None" for i in range(max(count, max(points, default=-1) + 1))]

    named = [{"name": _points(child(s, "tx")).get(0), "ref": None, "values": values(s)} for s in series]
    return {"kind": chart_type(plots[0]) if plots else "?", "title": title, "series_refs": None, "categories": [first[k] for k in sorted(first)], "series": named}


def _shape(e: ET.Element, deck: Deck, related: dict[str, tuple[str, str]]) -> dict:
    """What a shape holds by its kind; a chart whose part isn't there holds nothing."""
    kind = _kind(e)
    if kind == "table":
        return {"cells": _cells(_graphic(e, "tbl"))}
    if kind == "chart":
        key = next((v for n, v in _graphic(e, "chart").attrib.items() if n.endswith("}id")), None)
        return {"chart": _chart(deck.part(related[key][1]))} if key in related else {}
    if kind == "text":
        level = lambda p: int(attr(pr, "lvl") or 0) if (pr := child(p, "pPr")) is not None else 0
        return {"text": _lines(e).strip(), "paragraphs": [{"level": level(p), "bullet": _bullet(p), "text": _text(p).strip()} for p in _paragraphs(child(e, "txBody"))]}
    return {}


def atoms(data: bytes) -> Iterator[dict]:
    """Slides, their shapes and notes, and the placeholders of the layouts and masters that they use, each part once."""
    deck, met = Deck(data), set()
    bases = {"slideLayout": ("layout", "slideMaster"), "slideMaster": ("master", None)}

    def inherited(kind: str, part: str) -> Iterator[dict]:
        if part in met:
            return
        met.add(part)
        layer, above = bases[kind]
        up = next((target for k, target in deck.related(part).values() if k == above), None)
        for k, e, _ in _shapes(deck.part(part)):
            ph, idx = _placeholder(e)
            if ph is not None:
                yield {"layer": layer, "part": part, "up": up, "z": k, "ph": ph, "idx": idx} | dict(zip(PLACE, _box(e), strict=True))
        if up:
            yield from inherited(above, up)

    for slide, part, root in deck.slides():
        related = deck.related(part)
        up = next((target for kind, target in related.values() if kind == "slideLayout"), None)
        tree = child(root, "cSld", "spTree")
        yield {"layer": "slide", "part": part, "slide": slide, "grouped": any(local(x.tag) == "grpSp" for x in (tree if tree is not None else ()))}
        n = 0
        for k, e, grouped in _shapes(root):
            n, (ph, idx) = k + 1, _placeholder(e)
            name = next((attr(x, "name") for x in e.iter() if local(x.tag) == "cNvPr"), None)
            head = {"layer": "shape", "part": part, "up": up, "slide": slide, "z": k, "kind": _kind(e), "ph": ph, "idx": idx, "name": name, "grouped": grouped}
            yield head | dict(zip(PLACE, _box(e), strict=True)) | _shape(e, deck, related)
        for kind, target in related.values():
            if kind == "notesSlide":
                for _, e, _ in _shapes(deck.part(target)):
                    if _placeholder(e)[0] == "body" and (text := _lines(e).strip()):
                        yield {"layer": "shape", "part": part, "slide": slide, "z": n, "kind": "notes", "grouped": False, "text": text}
                        n += 1
        if up:
            yield from inherited("slideLayout", up)
