"""A small deck built in memory, decoded to atoms."""

import io
import zipfile

from folioframe.operators import slides as operators
from folioframe.sources import documents, slides

NS = 'xmlns:p="p" xmlns:a="a" xmlns:r="http://x/relationships" xmlns:c="c"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*items):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="http://t/{kind}" Target="{to}"/>' for i, kind, to in items) + "</Relationships>"


def shape(name, text, ph="", box=""):
    ps = "".join(f"<a:p>{pr}<a:r><a:t>{t}</a:t></a:r></a:p>" for pr, t in text)
    return f'<p:sp><p:nvSpPr><p:cNvPr name="{name}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{box}</p:spPr><p:txBody>{ps}</p:txBody></p:sp>'


def slide(body):
    return f"<p:sld {NS}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"


def deck():
    box = '<a:xfrm><a:off x="5" y="7"/><a:ext cx="20" cy="10"/></a:xfrm>'
    cell = lambda t, a="": f"<a:tc {a}><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    frame = lambda x: f"<p:graphicFrame><p:xfrm><a:off x='1' y='2'/></p:xfrm><a:graphic><a:graphicData>{x}</a:graphicData></a:graphic></p:graphicFrame>"
    table = frame(f"<a:tbl><a:tr>{cell('a  b', 'gridSpan=\"2\"')}{cell('x', 'hMerge=\"1\"')}</a:tr><a:tr>{cell('c')}{cell('d')}</a:tr></a:tbl>")
    one = slide(shape("T", [("", "Title")], '<p:ph type="title"/>') + f"<p:grpSp>{shape('B', [('<a:pPr lvl=\"1\"><a:buChar/></a:pPr>', 'item'), ('<a:pPr><a:buNone/></a:pPr>', 'plain')], '<p:ph/>', box)}</p:grpSp>" + table)
    two = slide(frame('<c:chart r:id="c1"/>'))
    pts = lambda *v: "".join(f'<c:pt idx="{i}"><c:v>{x}</c:v></c:pt>' for i, x in enumerate(v))
    chart = f"<c:chartSpace {NS}><c:chart><c:title><a:t>Sales</a:t></c:title><c:plotArea><c:barChart><c:ser><c:tx>{pts('Q')}</c:tx><c:cat>{pts('A', 'B')}</c:cat><c:val>{pts(260, 295)}</c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>"
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/><p:sldId id="3" r:id="r3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide9.xml"), ("r2", "slide", "slides/slide1.xml"), ("r3", "slide", "/ppt/slides/slide3.xml")),
        "ppt/slides/slide1.xml": one,
        "ppt/slides/_rels/slide1.xml.rels": rels(("n", "notesSlide", "../notesSlides/n.xml")),
        "ppt/notesSlides/n.xml": slide(shape("N", [("", "say this")], '<p:ph type="body"/>')),
        "ppt/slides/slide9.xml": two,
        "ppt/slides/_rels/slide9.xml.rels": rels(("c1", "chart", "../charts/chart1.xml")),
        "ppt/charts/chart1.xml": chart,
        "ppt/slides/slide3.xml": slide(""),
    })


def read(spark, **named):
    files = spark.createDataFrame([(f"{k}.pptx", bytearray(v)) for k, v in named.items()], "path string, content binary")
    return documents.from_decks(files)


def test_atoms():
    found = list(slides.atoms(deck()))
    shapes = [(a["slide"], a["z"], a["kind"], a.get("ph"), a.get("idx"), a["grouped"], a.get("top"), a.get("left"), a.get("height"), a.get("width"), a.get("text")) for a in found if a["layer"] == "shape"]
    assert shapes == [
        (1, 0, "text", "title", 0, False, None, None, None, None, "Title"),
        (1, 1, "text", "obj", 0, True, 7, 5, 10, 20, "item\nplain"),
        (1, 2, "table", None, None, False, 2, 1, None, None, None),
        (1, 3, "notes", None, None, False, None, None, None, None, "say this"),
        (2, 0, "chart", None, None, False, 2, 1, None, None, None),
    ]
    assert [(a["slide"], a["grouped"]) for a in found if a["layer"] == "slide"] == [(1, True), (2, False), (3, False)]
    assert found[2]["paragraphs"] == [{"level": 1, "bullet": "bullet", "text": "item"}, {"level": 0, "bullet": "none", "text": "plain"}]
    cell = lambda text, colspan=1, covered=False: {"text": text, "rowspan": 1, "colspan": colspan, "covered": covered}
    assert found[3]["cells"] == [[cell("a b", 2), cell("", covered=True)], [cell("c"), cell("d")]]
    chart = found[6]["chart"]
    assert (chart["title"], chart["categories"], chart["series"]) == ("Sales", ["A", "B"], [{"name": "Q", "ref": None, "values": ["260.0", "295.0"]}])


def place(top, left, height=10, width=100):
    return f'<a:xfrm><a:off x="{left}" y="{top}"/><a:ext cx="{width}" cy="{height}"/></a:xfrm>'


def inherited_deck():
    """Four text placeholders without places of their own, in reverse of the order that layout and master give them, and a box."""
    ph = lambda kind, idx: f'<p:ph type="{kind}" idx="{idx}"/>'
    body = shape("foot", [("", "foot")], ph("ftr", 11)) + shape("low", [("", "low")], ph("body", 2)) + shape("high", [("", "high")], ph("body", 1)) + shape("T", [("", "Title")], '<p:ph type="ctrTitle"/>')
    body += shape("free", [("", "free")], box=place(35, 0)) + shape("lost", [("", "lost")], ph("body", 77))
    tops = shape("", [], ph("body", 1), place(30, 0)) + shape("", [], ph("body", 1), place(900, 0)) + shape("", [], ph("obj", 2)) + shape("", [], '<p:ph type="title"/>') + shape("", [], ph("ftr", 11))
    master = shape("", [], '<p:ph type="title"/>', place(5, 0)) + shape("", [], ph("body", 1), place(60, 0)) + shape("", [], ph("ftr", 4), place(90, 0))
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": slide(body),
        "ppt/slides/_rels/slide1.xml.rels": rels(("l", "slideLayout", "../slideLayouts/l.xml")),
        "ppt/slideLayouts/l.xml": slide(tops),
        "ppt/slideLayouts/_rels/l.xml.rels": rels(("m", "slideMaster", "../slideMasters/m.xml")),
        "ppt/slideMasters/m.xml": slide(master),
    })


def test_inherited_places(spark):
    """A layout's placeholder of the index gives the place (the first of two), else the master's of its type; without either it is 0."""
    got = read(spark, a=inherited_deck(), bad=b"x").collect()
    own = sorted((r for r in got if r.error is None), key=lambda r: r.elem_no)
    assert [(r.type, r.text) for r in own] == [("unit", "Title"), ("list_item", "lost"), ("list_item", "high"), ("paragraph", "free"), ("list_item", "low"), ("paragraph", "foot")]
    assert own[0].signals == ["overlap"]  # high and free: 30 to 40, 35 to 45
    assert [(r.doc_id, r.type, r.error) for r in got if r.error] == [("bad.pptx", "error", "BadZipFile: File is not a zip file")]
    frame = spark.createDataFrame([{"doc_id": "d"} | a for a in slides.atoms(inherited_deck())], operators.ATOMS)
    places = {r.text: r.top for r in operators.placed(frame).where("layer = 'shape'").collect()}
    assert places == {"foot": 90, "low": 60, "high": 30, "Title": 5, "free": 35, "lost": None}


def test_deck_is_one_exchange(spark):
    """Inheritance, order and assembly follow one exchange by deck."""
    plan = operators.elements(spark.createDataFrame([], operators.ATOMS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Window") >= 3


def test_no_slides(spark):
    assert operators.elements(spark.createDataFrame([], operators.ATOMS)).count() == 0
