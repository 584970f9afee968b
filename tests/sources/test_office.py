"""Small office files built in memory, decoded to atoms and run through operators."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioframe.operators import tables
from folioframe.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def files(spark, **named):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary")


def docx():
    p = lambda t, pr="": f"<w:p>{pr}<w:r><w:t>{t}</w:t></w:r></w:p>"
    tc = lambda t, pr="", inner="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(t)}{inner}</w:tc>"
    nested = f"<w:tbl><w:tr>{tc('n1')}{tc('n2')}</w:tr></w:tbl>"
    table = f"<w:tbl><w:tr>{tc('a', '<w:gridSpan w:val=\"2\"/>')}{tc('v', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{tc('b')}{tc('c', '', nested)}{tc('', '<w:vMerge/>')}</w:tr></w:tbl>"
    body = p("Title", '<w:pPr><w:pStyle w:val="H1"/></w:pPr>') + p("item", "<w:pPr><w:numPr/></w:pPr>") + table + p("end")
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>'})


def xlsx():
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>x  y</t></is></c></row><row><c r="A2"><v>260.0</v></c><c r="B2"><f>A2*2</f></c></row><row><c r="AA9" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    return zipped({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="My sheet" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet,
        "xl/sharedStrings.xml": "<sst><si><r><t>he</t></r><r><t>ad</t></r></si></sst>",
    })


def test_docx(spark):
    rows = office.decode(files(spark, a=docx(), bad=b"no zip"), "docx_blocks").collect()
    assert [(r.kind, r.style, r.listed, r.text) for r in rows if r.doc_id == "a"] == [("paragraph", "Heading 1", False, "Title"), ("paragraph", "Normal", True, "item"), ("table", None, False, None), ("paragraph", "Normal", False, "end")]
    assert [r.error for r in rows if r.doc_id == "bad"] == ["BadZipFile: File is not a zip file"]
    cells = office.decode(files(spark, a=docx()), "docx_cells")
    assert [(r.table_id, r.parent, r.text) for r in cells.collect()] == [(0, None, "a"), (0, None, "v"), (0, None, "b"), (0, None, "c"), (1, 0, "n1"), (1, 0, "n2"), (0, None, "")]
    spans = tables.vertical_spans(tables.column_starts(cells)).collect()
    assert [(r.table_id, r.row, r.col, r.rowspan) for r in spans] == [(0, 0, 2, 2)]


def test_xlsx(spark):
    f = files(spark, a=xlsx())
    got = [(r.sheet, r.row, r.col, r.kind, r.text) for r in office.decode(f, "xlsx_cells").collect()]
    assert got == [("My sheet", 1, 1, "s", "head"), ("My sheet", 1, 2, "s", "x y"), ("My sheet", 2, 1, "n", "260"), ("My sheet", 2, 2, "f", "=A2*2"), ("My sheet", 9, 27, "b", "True")]
    assert [tuple(r)[1:6] for r in office.decode(f, "xlsx_merges").collect()] == [("My sheet", 1, 1, 1, 2)]
    found = tables.regions(office.decode(f, "xlsx_cells").select("sheet", "row", "col")).collect()
    assert sorted(r.ref for r in found) == ["A1:B2", "AA9:AA9"]


def test_hwpx_and_files(spark, tmp_path):
    section = lambda *t: "<s>" + "".join(f"<hp:p xmlns:hp='h'><hp:run><hp:t>{x}</hp:t></hp:run></hp:p>" for x in t) + "</s>"
    data = zipped({"mimetype": "application/hwp+zip", "Contents/section10.xml": section("last"), "Contents/section2.xml": section("a<hp:lineBreak/>b", "c &amp; d")})
    (tmp_path / "x.hwpx").write_bytes(data)
    got = office.read_office(spark, str(tmp_path), "hwpx_paragraphs").collect()
    assert [(r.section[-6:-4], r.text) for r in got] == [("n2", "a\nb"), ("n2", "c & d"), ("10", "last")]
    assert office.is_hwpx(data) and not office.is_hwpx(b"PK") and not office.is_hwpx(zipped({"a": "b"}))
    with pytest.raises(Exception, match="BadZipFile"):
        office.decode(files(spark, a=b"x"), "docx_cells", strict=True).agg(F.count(F.lit(1))).collect()


def test_dates_and_shared_formulas():
    cells = '<c r="A1" s="1"><v>45292</v></c><c r="B1" s="2"><v>45292.75</v></c><c r="C1" s="1"><v>0.5</v></c><c r="D1" s="0"><v>45292</v></c><c r="E1" s="3"><v>7</v></c>'
    rows = "".join(f'<c r="F{r}"><f t="shared" si="0"{" ref=%sF1:F3%s" % (chr(34), chr(34)) if r == 1 else ""}>{"A1*$B$2+D$3&amp;&quot;A1&quot;+LOG10(C1)" if r == 1 else ""}</f><v>{r}</v></c>' for r in (1, 2, 3))
    data = zipped({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData><row>{cells}{rows}</row></sheetData></worksheet>",
    })
    got = {(r, c): (kind, text, formula) for _, _, r, c, kind, text, formula in office.xlsx_cells(data)}
    assert [got[1, c][:2] for c in range(1, 6)] == [("d", "2024-01-01 00:00:00"), ("d", "2024-01-01 18:00:00"), ("d", "12:00:00"), ("n", "45292"), ("n", "7")]
    assert [got[r, 6][2] for r in (1, 2, 3)] == [f'=A{r}*$B$2+D$3&"A1"+LOG10(C{r})' for r in (1, 2, 3)]
    assert office.moved("'My sheet'!A1+Other!$A1:B$2", 1, 26) == "'My sheet'!AA2+Other!$A2:AB$2"
