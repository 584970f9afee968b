"""The commands over small files."""

import json

import pytest
from sources.test_documents import report_docx, report_pdf
from sources.test_hangul_edit import hwp, hwpx

from folioframe.__main__ import main, page_list
from folioframe.sources import hangul


@pytest.fixture
def folder(tmp_path):
    for name, data in (("a.hwp", hwp()), ("b.hwpx", hwpx()), ("c.docx", report_docx()), ("d.pdf", report_pdf()), ("bad.docx", b"x")):
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_hangul_commands(folder, capsys):
    assert main(["hwp-extract", str(folder / "a.hwp"), "-o", str(folder / "a.txt"), "--no-table-markers"]) == 0
    assert (folder / "a.txt").read_text(encoding="utf-8").startswith("이름: {name}")
    assert main(["hwp-inspect", str(folder / "a.hwp"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["sections"][0]["tag_counts"]["TABLE"] == 2
    assert main(["hwp-inspect", str(folder / "a.hwp"), "--paragraphs"]) == 0
    assert "(blank, text at level 4)" in capsys.readouterr().out
    assert main(["hwp-tables", str(folder / "b.hwpx")]) == 0
    shown = capsys.readouterr().out
    assert shown.startswith("### 표 1 (Contents/section2.xml)\n\n| h<br>x |  |\n| --- | --- |\n| a | b |") and "(r0,c0)→1×2" in shown
    assert main(["hwp-tables", str(folder / "b.hwpx"), "-f", "csv", "-o", str(folder / "t.csv")]) == 0
    assert (folder / "t.csv").read_bytes() == b'"h\nx","h\nx"\r\na,b\r\n'
    assert main(["hwp-tables", str(folder / "a.hwp"), "-f", "json", "-t", "2"]) == 0
    assert json.loads(capsys.readouterr().out)["tables"][0]["grid"] == [["deep"]]
    assert main(["hwp-tables", str(folder / "a.hwp"), "-t", "9"]) == 1
    assert main(["hwp-extract", str(folder / "none.hwp")]) == 2


def test_form_filling(folder):
    """Placeholders replaced, then a blank cell filled by its index."""
    (folder / "rules.json").write_text(json.dumps([{"old": "{name}", "new": "Kim", "max": 1}]))
    assert main(["hwp-edit", "replace", str(folder / "a.hwp"), str(folder / "1.hwp"), "--rules", str(folder / "rules.json"), "--pair", "end=END"]) == 0
    data = (folder / "1.hwp").read_bytes()
    section = hangul.inspect(data)["sections"][0]
    (folder / "edits.json").write_text(json.dumps({section["name"]: {section["blank_paragraphs"][0]["header_index"]: "filled"}}))
    assert main(["hwp-edit", "fill-blank", str(folder / "1.hwp"), str(folder / "2.hwp"), "--edits", str(folder / "edits.json")]) == 0
    text = hangul.text((folder / "2.hwp").read_bytes())
    assert text.startswith("이름: Kim {name}") and "filled" in text and "𝄞END" in text
    assert main(["hwp-edit", "set", str(folder / "b.hwpx"), str(folder / "3.hwp"), "--edits", str(folder / "edits.json")]) == 2


def test_parse_commands(spark, folder, capsys):
    assert main(["docx-parse", str(folder / "c.docx"), str(folder / "bad.docx"), "-o", str(folder / "out")]) == 2
    assert (folder / "out/c.md").read_text(encoding="utf-8").startswith("<!-- parsed from c.docx -->") and "bad.docx: BadZipFile" in capsys.readouterr().err
    assert main(["pdf-parse", str(folder / "d.pdf"), "-o", str(folder / "out"), "--render", "--pages", "2"]) == 0
    assert "](assets/p2_img0.png)" in (folder / "out/d.md").read_text(encoding="utf-8") and (folder / "out/assets/p2_img0.png").read_bytes().startswith(b"\x89PNG")
    assert "no page renderer is plugged in" in capsys.readouterr().err
    assert main(["pdf-triage", str(folder / "d.pdf")]) == 0
    assert "routes: scanned=1, table=1" in capsys.readouterr().out
    assert page_list("1,3-5,3") == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        page_list("0-2")
    assert main(["docx-parse", str(folder / "nowhere.docx")]) == 2
