"""Whole documents from small files built in memory: elements, units, Markdown, JSON and saved files."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from sources.test_office import W, files, zipped
from sources.test_slides import deck

from folioframe import documents
from folioframe.sources import pdf
from folioframe.sources.documents import elements
from folioframe.operators import sheets as sheet_operators
from folioframe.sources.sheets import chart_kind

R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def report_docx():
    p = lambda t, pr="": f"<w:p>{pr}<w:r><w:t>{t}</w:t></w:r></w:p>"
    tc = lambda t, pr="", inner="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(t)}{inner}</w:tc>"
    nested = f"<w:tbl><w:tr>{tc('n1')}{tc('n2')}</w:tr></w:tbl>"
    wide = tc("a", '<w:gridSpan w:val="2"/>')
    table = f"<w:tbl><w:tr>{wide}{tc('v', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{tc('b')}{tc('c', '', nested)}{tc('', '<w:vMerge/>')}</w:tr></w:tbl>"
    box = "<w:p><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>in a  box</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p>"
    end = '<w:sectPr><w:headerReference w:type="default" r:id="h1"/><w:footerReference w:type="default" r:id="h1"/></w:sectPr>'
    body = p("Top", '<w:pPr><w:pStyle w:val="H9"/></w:pPr>') + box + p("&lt;script&gt;", "<w:pPr><w:numPr/></w:pPr>") + table + p("end") + "<w:p><w:r><w:drawing><a:blip/></w:drawing></w:r></w:p><w:p><w:ins/></w:p>" + end
    rel = lambda i, kind, to: f'<Relationship Id="{i}" Type="http://x/{kind}" Target="{to}"/>'
    return zipped({
        "word/document.xml": f"<w:document {W} {R} xmlns:a='a'><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H9"><w:name w:val="Heading 9"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": f"<Relationships>{rel('h1', 'header', 'header1.xml')}{rel('c', 'comments', 'comments.xml')}</Relationships>",
        "word/header1.xml": f"<w:hdr {W}>{p('running head')}</w:hdr>",
    })


def book_xlsx():
    cell = lambda ref, v, f="": f'<c r="{ref}" t="str">{f and f"<f>{f}</f>"}<v>{v}</v></c>'
    num = lambda ref, v, f="": f'<c r="{ref}">{f and f"<f>{f}</f>"}' + (f"<v>{v}</v>" if v != "" else "") + "</c>"
    finance = cell("A1", "Report") + cell("A3", "name") + cell("B3", "value") + cell("A4", "x|y") + num("B4", 260) + cell("A5", "z") + num("B5", 295, "B4+35")
    other = cell("D7", "k") + cell("E7", "v") + cell("D8", "p") + num("E8", "", "E9") + cell("D9", "q") + num("E9", 3)
    sheet = lambda x, more="": f"<worksheet {R}><sheetData><row>{x}</row></sheetData>{more}</worksheet>"
    pts = lambda tag, *v: f"<c:{tag}><c:numRef><c:f>Finance!$B$4:$B$5</c:f>" + (f"<c:numCache>{''.join(f'<c:pt idx=\"{i}\"><c:v>{x}</c:v></c:pt>' for i, x in enumerate(v))}</c:numCache>" if v else "") + f"</c:numRef></c:{tag}>"
    chart = f"<c:chartSpace xmlns:c='c' xmlns:a='a'><c:chart><c:title><a:t>Sales</a:t></c:title><c:plotArea><c:barChart><c:ser><c:tx><c:v>S1</c:v></c:tx><c:cat><c:strRef><c:f>Finance!$A$4:$A$5</c:f></c:strRef></c:cat>{pts('val')}</c:ser><c:ser>{pts('val', '260.0', 295, 330, 354)}</c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>"
    rel = lambda i, kind, to: f'<Relationships><Relationship Id="{i}" Type="http://x/{kind}" Target="{to}"/></Relationships>'
    return zipped({
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="Finance" r:id="r1"/><sheet name="Empty &amp; more" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet(finance + other, '<mergeCells><mergeCell ref="D7:D8"/></mergeCells>'),
        "xl/worksheets/sheet2.xml": sheet(""),
        "xl/worksheets/_rels/sheet1.xml.rels": rel("d", "drawing", "../drawings/d.xml"),
        "xl/drawings/_rels/d.xml.rels": rel("c", "chart", "../charts/c.xml"),
        "xl/drawings/d.xml": "<x/>",
        "xl/charts/c.xml": chart,
    })


def report_pdf():
    """Two pages: one with a title, text and a ruled table; one that only shows an image."""
    cells = "".join(f"BT /F1 10 Tf {60 + 100 * c} {492 - 30 * r} Td ({t}) Tj ET " for r, row in enumerate((("name", "value"), ("x", "260"), ("y", "295"))) for c, t in enumerate(row))
    grid = "".join(f"50 {510 - 30 * k} m 250 {510 - 30 * k} l S " for k in range(4)) + "".join(f"{50 + 100 * k} 420 m {50 + 100 * k} 510 l S " for k in range(3)) + "50 300 150 1 re f " * 3
    text = "BT /F1 20 Tf 50 720 Td (Yearly *report*) Tj ET " + "".join(f"BT /F1 10 Tf 50 {660 - 12 * k} Td (A plain line number {k} of the text.) Tj ET " for k in range(4))
    streams = [(text + cells + grid).encode(), b"q 600 0 0 780 6 6 cm /I Do Q"]
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 612 792] /Resources << /Font << /F1 7 0 R >> /XObject << /I 8 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>",
        7: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>",
    }
    for k, s in enumerate(streams):
        z = zlib.compress(s)
        objects[5 + k] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(z) + z + b"\nendstream"
    objects[8] = b"<< /Type /XObject /Subtype /Image /Width 2 /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Length 6 >>\nstream\n\xff\x00\x00\x00\xff\x00\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + objects[n] + b"\nendobj\n" for n in sorted(objects)) + b"trailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF"


def of(spark, **named):
    return elements(files(spark, **{k.replace("_", "."): v for k, v in named.items()})).cache()


def test_word(spark):
    e = of(spark, a_docx=report_docx())
    rows = [(r.type, r.text, r.level, r.note) for r in e.where("type <> 'unit'").orderBy("elem_no").collect()]
    assert rows == [
        ("heading", "Top", 6, None), ("textbox", "in a box", None, "text recovered from a text box"), ("list_item", "<script>", None, None),
        ("table", None, None, "nested-table"), ("paragraph", "end", None, None), ("note", "running head", None, "header"),
        ("image", "1 embedded image(s)", None, "images are referenced but not extracted in this pass"),
    ]
    u = documents.units(e).first()
    assert u.flags == ["textbox-content", "merged-cells", "nested-table", "embedded-images-not-extracted", "tracked-changes-present", "comments-present"]
    assert (u.confidence, u.needs_vision) == (0.65, False)
    md = documents.to_markdown(e).first().markdown
    assert md.startswith("<!-- parsed from a.docx -->\n\n\n> 🔎 Low parse confidence (0.65); verify. flags: textbox-content, merged-cells")
    assert '<tr><th colspan="2">a</th><th rowspan="2">v</th></tr>' in md and "<td>c<table>\n  <tr><th>n1</th><th>n2</th></tr>\n</table></td>" in md
    assert "- &lt;script&gt;" in md and "<!-- header --> running head" in md and "###### Top" in md
    made = json.loads(documents.to_json(e).first().json)
    table = next(x for x in made["elements"] if x["type"] == "table")
    assert table["rows"] == [["a", "", "v"], ["b", "c", ""]] and table["spans"][1] == {"row": 0, "col": 2, "rowspan": 2, "colspan": 1}
    assert table["nested"] == [{"row": 1, "col": 1, "rows": [["n1", "n2"]], "spans": [], "nested": []}]
    assert made["needs_review"] and made["element_count"] == 7


def test_workbook(spark):
    e = of(spark, b_xlsx=book_xlsx())
    rows = [(r.type, r.ref, r.note, r.rows) for r in e.where("unit_no = 1 and type <> 'unit'").orderBy("elem_no").collect()]
    assert rows[0] == ("note", "A1:A1", None, None)
    assert rows[1] == ("table", "A3:B5", "contains-formula(cached values shown)", [["name", "value"], ["x|y", "260"], ["z", "295"]])
    assert rows[2][:2] == ("table", "D7:E9") and "no cached values" in rows[2][2] and rows[2][3] == [["k", "v"], ["", "=E9"], ["q", "3"]]
    chart = e.where("type = 'chart'").first().chart
    assert (chart.kind, chart.title, chart.categories) == ("BarChart", "Sales", ["x|y", "z"])
    assert [(s.name, list(s["values"])) for s in chart.series] == [("S1", ["260", "295"]), (None, ["260", "295", "330", "354"])]
    units = {u.title: u for u in documents.units(e).collect()}
    assert units["Empty & more"].flags == ["empty-sheet"] and units["Finance"].confidence == 0.65
    assert units["Finance"].flags == ["multiple-table-regions", "merged-cells", "formula-cells", "formula-no-cache"]
    up = documents.rollup(documents.units(e)).first()
    assert (up.units, up.min_confidence, up.verify) == (2, 0.5, [1, 2])
    md = documents.to_markdown(e).first().markdown
    assert "| x\\|y | 260 |" in md and "| series | x\\|y | z |\n| --- | --- | --- |\n| S1 | 260 | 295 |" in md
    assert "\n\n\n\n# Sheet: Empty &amp; more" in md and '<tr><th rowspan="2">k</th><th>v</th></tr>' in md
    made = json.loads(documents.to_json(e).first().json)
    assert made["verify_sheets"] == ["Finance", "Empty & more"] and made["sheets"][0]["elements"][-1]["chart"]["series"][1]["name"] is None


def test_deck(spark):
    e = of(spark, c_pptx=deck(), bad_pptx=b"x")
    assert e.where("error is not null").first().doc_id == "bad.pptx"
    rows = [(r.unit_no, r.type, r.text, r.level) for r in e.where("error is null and type <> 'unit'").orderBy("unit_no", "elem_no").collect()]
    assert rows == [(1, "table", None, None), (1, "list_item", "item", 1), (1, "paragraph", "plain", None), (1, "note", "say this", None), (2, "chart", "Sales", None)]
    units = {u.unit_no: (u.title, u.flags, u.confidence) for u in documents.units(e).collect()}
    assert units == {1: ("Title", ["table-merged-cells", "grouped-shapes"], 0.8), 2: ("", ["has-chart"], 1.0), 3: ("", ["empty-slide"], 0.5)}
    md = documents.to_markdown(e).where("doc_id = 'c.pptx'").first().markdown
    assert "# Slide 1: Title" in md and "  - item" in md and "- Q: A=260.0, B=295.0" in md and "> 🗒 **[notes]** say this" in md and "_(kind: COLUMN_CLUSTERED (51))_" in md
    made = json.loads(documents.to_json(e).where("doc_id = 'c.pptx'").first().json)
    assert made["verify_slides"] == [3] and made["slides"][1]["elements"][0]["chart"]["series"][0]["values"] == [260.0, 295.0]


def test_pdf(spark, tmp_path):
    e = documents.from_pdf(files(spark, **{"d.pdf": report_pdf(), "e.pdf": b"%PDF-1.4 trailer << /Encrypt 1 0 R >> startxref"})).cache()
    assert e.where("error is not null").first().error == "PdfError: the document is encrypted"
    rows = [(r.unit_no, r.type, r.text, r.rows) for r in e.where("error is null and type <> 'unit'").orderBy("unit_no", "elem_no").collect()]
    body = "\n".join(f"A plain line number {k} of the text." for k in range(4))
    assert rows == [(1, "heading", "Yearly *report*", None), (1, "paragraph", body, None), (1, "table", None, [["name", "value"], ["x", "260"], ["y", "295"]]), (2, "image", None, None)]
    units = {u.unit_no: u for u in documents.units(e).collect()}
    assert units[1].props["route"] == "table" and not units[1].needs_vision
    assert units[2].props["route"] == "scanned" and units[2].needs_vision
    md = documents.to_markdown(e, "assets").where("doc_id = 'd.pdf'").first().markdown
    assert "# Yearly \\*report\\*" in md and "| x | 260 |" in md and "![image](assets/p2_img0.png)" in md and "> ⚠️ Page 2 needs vision" in md
    shown = documents.to_markdown(e, "assets", renders="render").where("doc_id = 'd.pdf'").first().markdown
    assert "![page 2 (rendered for vision)](render/page_002.png)" in shown and "p2_img0" not in shown  # the page isn't shown twice
    assert documents.rollup(documents.units(e)).where("doc_id = 'd.pdf'").first().vision == [2]
    paths = dict(documents.save(e, str(tmp_path)))
    assert json.load(open(paths[str(tmp_path / "d.md")], encoding="utf-8"))["page_count"] == 2
    assert e.where("type = 'image'").select(documents.covers_page(F.col("bbox"), F.lit(612.0 * 792.0))).first()[0]


def test_pdf_images_and_renderer(monkeypatch):
    images = list(pdf.pdf_images(report_pdf()))
    assert len(images) == 1 and images[0][-1].startswith(b"\x89PNG") and images[0][:3] == (2, 0, 8)
    with pytest.raises(pdf.PdfError, match="out of range"):
        pdf.render(report_pdf(), 3)
    with pytest.raises(pdf.PdfError, match="no page renderer"):
        pdf.render(report_pdf(), 1)
    monkeypatch.setattr(pdf, "RENDERER", lambda data, page, dpi: b"png%d" % page)
    assert pdf.render(report_pdf(), 2) == b"png2"


def test_regions_in_order(spark):
    """Rows are cut before columns at every level, so a right part with an empty row of its own comes last; regions are the same by the kernel for deep nests."""
    for places, want in (
        ([(1, 4), (3, 6), (4, 2), (5, 4), (5, 6)], [(1, 4, 1, 4), (4, 2, 4, 2), (3, 6, 3, 6), (5, 4, 5, 4), (5, 6, 5, 6)]),
        ([(1, 1), (2, 1), (3, 1), (1, 3), (1, 5), (3, 3), (3, 4)], [(1, 1, 3, 1), (1, 3, 1, 3), (1, 5, 1, 5), (3, 3, 3, 4)]),
    ):
        cells = spark.createDataFrame([("d", 0, *p) for p in places], "doc_id string, sheet_no int, row int, col int")
        found = sheet_operators.numbered(sheet_operators.boxes(sheet_operators.in_regions(cells))).orderBy("region").collect()
        assert [(r.min_row, r.min_col, r.max_row, r.max_col) for r in found] == want
        number = sheet_operators.cut_places(*np.array(places).T)
        assert {frozenset(p for p, n in zip(places, number, strict=True) if n == k) for k in set(number)} == {frozenset(p for p in places if a <= p[0] <= c and b <= p[1] <= d) for a, b, c, d in want}
    assert [chart_kind(x) for x in ("barChart", "bar3DChart", "ofPieChart", "lineChart")] == ["BarChart", "BarChart3D", "ProjectedPieChart", "LineChart"]


def test_sheet_rules(spark):
    """Titles above headers, merged cells over stored values, formulas without values, dates as labels, far references."""
    cell = lambda s, r, c, text, kind="s", formula=None: ("d", s, r, c, kind, text, formula)
    cells = [cell(0, 1, 2, "Title"), cell(0, 2, 1, "k"), cell(0, 2, 2, "v"), cell(0, 3, 1, "a"), cell(0, 3, 2, "1", "n"), cell(0, 4, 1, "b"), cell(0, 4, 2, "=A1", "f", "=A1")]
    cells += [cell(1, 1, 1, "x"), cell(1, 1, 2, "hidden"), cell(1, 2, 1, "2024-01-01 00:00:00", "d"), cell(1, 2, 2, "1", "n"), cell(1, 3, 1, "y"), cell(1, 3, 2, "2", "n")]
    merges = [("d", 1, 1, 1, 1, 2), ("d", 1, 2, 1, 900000, 1)]
    points = [("d", 0, 0, "BarChart", None, 0, "val", "S!$B$1:$B$1048576", None, None, None), ("d", 0, 0, "BarChart", None, 0, "name", "S!$A$2", None, 0, "stored"), ("d", 0, 0, "BarChart", None, None, "plot", None, None, None, None), ("d", 2, 0, "PieChart", "T", None, "plot", None, None, None, None)]
    frames = [
        spark.createDataFrame([("d", 0, "S"), ("d", 1, "M"), ("d", 2, "only a chart"), ("d", 3, "empty")], "doc_id string, sheet_no int, name string"),
        spark.createDataFrame(cells, "doc_id string, sheet_no int, row int, col int, kind string, text string, formula string"),
        spark.createDataFrame(merges, "doc_id string, sheet_no int, r0 int, c0 int, r1 int, c1 int"),
        spark.createDataFrame(points, "doc_id string, sheet_no int, chart_no int, plot string, title string, series int, role string, ref string, literal string, idx int, value string"),
    ]
    found = sheet_operators.elements(*frames).orderBy("unit_no", "elem_no").collect()
    one, two = [r for r in found if r.unit_no == 1], [r for r in found if r.unit_no == 2]
    assert one[0].signals == ["formula", "no_cache"] and (one[1].type, one[1].ref, one[1].text) == ("note", "A1:B1", "Title")
    assert (one[2].ref, one[2].rows, one[2].spans) == ("A2:B4", [["k", "v"], ["a", "1"], ["b", "=A1"]], None)
    assert [(s.name, s["values"]) for s in one[3].chart.series] == [("k", ["Title", "v", "1"])] and one[3].chart.series_refs == ["S!$B$1:$B$1048576"]
    # The covered cell's value is gone, and what reaches over the region's end is no span of it; y is covered too.
    assert two[1].rows == [["x", ""], ["2024-01-01 00:00:00", "1"], ["", "2"]] and [tuple(s) for s in two[1].spans] == [(0, 0, 1, 2)]
    assert [(r.unit_no, r.type, r.signals) for r in found if r.unit_no > 2] == [(3, "unit", []), (3, "chart", None), (4, "unit", ["empty"])]
