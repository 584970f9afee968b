"""Tables, texts and edited copies of hwp and hwpx files, and the compound files that they are written as."""

import io
import struct
import zipfile

import pytest
from sources.test_hangul import header, packed, record
from sources.test_office import zipped

from folioframe.sources import compound, hangul, office

u = lambda s: s.encode("utf-16-le")


def cell(row, col, down=1, across=1):
    return struct.pack("<HIHHHH", 1, 0, col, row, across, down) + bytes(20)


def hwp(flags=1, more=()):
    head = lambda n: struct.pack("<I", n | 0x80000000) + bytes(20)
    inner = record(71, 4, b"tbl ") + record(77, 5, struct.pack("<IHH", 0, 1, 1)) + record(72, 5, cell(0, 0)) + record(66, 6, head(3)) + record(67, 7, u("deep"))
    table = record(71, 1, b"tbl ") + record(77, 2, struct.pack("<IHH", 0, 2, 3)) + record(72, 2, cell(0, 0, 1, 2)) + record(66, 3, head(5)) + record(67, 4, u("A|B\r")) + inner
    table += record(72, 2, cell(0, 2)) + record(66, 3, head(2)) + record(67, 4, u("x\r")) + record(66, 3, head(2)) + record(67, 4, u("y\r")) + record(72, 2, cell(1, 0)) + record(66, 3, head(0)) + record(68, 4, b"") + record(72, 2, b"cap")
    body = record(66, 0, head(9)) + record(67, 1, u("이름: {name} {name}\x02ABCDEFG{name}\r")) + table + record(66, 0, head(4)) + record(67, 1, u("𝄞end{name}\r"))
    streams = {"FileHeader": header(flags), "BodyText/Section0": packed(body) if flags & 1 else body, "DocInfo": b"i" * 5000, "BinData/BIN0001.png": bytes(range(256)) * 40, "\x05HwpSummaryInformation": b"s" * 70, **dict(more)}
    return compound.build(streams)


def hwpx():
    run = lambda t: f"<hp:p><hp:run><hp:t>{t}</hp:t></hp:run></hp:p>"
    tc = lambda r, c, t, a=1: f'<hp:tc><hp:subList>{run(t)}</hp:subList><hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="{a}" rowSpan="1"/></hp:tc>'
    table = f'<hp:p><hp:run><hp:tbl rowCnt="2" colCnt="2"><hp:tr>{tc(0, 0, "h<hp:lineBreak/>x", 2)}</hp:tr><hp:tr>{tc(1, 0, "a")}{tc(1, 1, "b")}</hp:tr></hp:tbl></hp:run></hp:p>'
    sec = lambda x: f'<?xml version="1.0"?><hs:sec xmlns:hs="s" xmlns:hp="p">{x}</hs:sec>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/hwp+zip", zipfile.ZIP_STORED)
        z.writestr("Contents/section10.xml", sec(run("last {name}")))
        z.writestr("Contents/section2.xml", sec(run("A &amp; {name}<hp:tab/>{name} &lt;") + table))
        z.writestr("BinData/x.bin", bytes(range(256)))
    return out.getvalue()


def test_tables():
    for data, want in ((hwp(), [["A|B", "", "x\ny"], ["", "", ""]]), (hwpx(), [["h\nx", ""], ["a", "b"]])):
        found = hangul.tables(data)
        assert hangul.table_grid(found[0]) == want
        assert [s["colspan"] for s in found[0]["spans"]] == [2]
    assert [t["index"] for t in hangul.tables(hwp())] == [0, 1] and hangul.table_grid(hangul.tables(hwp())[1]) == [["deep"]]
    assert hangul.table_grid(hangul.tables(hwp())[0], "duplicate")[0] == ["A|B", "A|B", "x\ny"]
    assert hangul.assembled(0, 0, [{"row": 1, "col": 2, "rowspan": 2, "colspan": 1, "text": ""}])["nrows"] == 3


def test_texts_and_inspect(spark):
    assert hangul.text(hwp()).split("\n") == ["이름: {name} {name}{name}", "[표]", "A|B", "[표]", "deep", "x", "y", "𝄞end{name}"]
    assert "[표]" not in hangul.text(hwp(), markers=False)
    assert hangul.text(hwpx()).split("\n")[:2] == ["=== Contents/section2.xml ===", "A & {name}\t{name} <"] and hangul.text(hwpx()).endswith("last {name}")
    told = hangul.inspect(hwp())
    section = told["sections"][0]
    assert told["compressed"] and section["tag_counts"]["TABLE"] == 2 and section["paragraphs"][0]["text"].endswith("¶")
    assert [(b["level"], b["suggested_text_level"]) for b in section["blank_paragraphs"]] == [(3, 4)]
    assert hangul.inspect(hwpx())["format"] == "hwpx" and len(hangul.inspect(hwp(), 2)["sections"][0]["paragraphs"]) == 2
    f = spark.createDataFrame([("a.hwp", bytearray(hwp())), ("b.hwpx", bytearray(hwpx()))], "path string, content binary")
    rows = office.decode(f, "hwp_cells").collect()
    assert len([r for r in rows if r.doc_id == "a.hwp"]) == 4 and not any(r.error for r in rows)


def streams(data):
    c = hangul.Compound(data)
    return {p: c.stream(p) for p in c.paths}


def test_replace():
    data = hwp()
    new, n = hangul.replace(data, [("{name}", "홍길동")])
    assert n == 4 and hangul.text(new).startswith("이름: 홍길동 홍길동홍길동\n") and hangul.text(new).endswith("𝄞end홍길동")
    before, after = streams(data), streams(new)
    assert {p for p in before if before[p] != after[p]} == {"BodyText/Section0"}  # all others byte for byte
    recs = next(hangul.section_records(new))[1]
    for k, h in hangul.owners(recs).items():
        if "홍길동" in hangul.raw_text(recs[k][2]):
            units = len(recs[k][2]) // 2
            assert struct.unpack_from("<I", recs[h][2])[0] == units | 0x80000000  # a clef counts as two
    assert "\x02ABCDEFG" in hangul.raw_text(recs[1][2])  # a control keeps what belongs to it
    assert hangul.replace(data, [{"old": r"\{(\w+)\}", "new": r"<\1>", "regex": True, "max": 3}])[1] == 3
    assert hangul.text(hangul.replace(data, [("{name}", "a"), {"old": "a", "new": "b", "max": 1}])[0]).startswith("이름: b aa")
    assert hangul.replace(data, [("", "x")])[1] == 0 and streams(hangul.replace(data, [("nowhere", "x")])[0]) == before
    plain = hwp(0)
    assert hangul.text(hangul.replace(plain, [("end", "END")])[0]).endswith("𝄞END{name}")


def test_replace_xml():
    new, n = hangul.replace(hwpx(), [{"old": "{name}", "new": "<K&R>", "max": 2}])
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        assert z.read("BinData/x.bin") == bytes(range(256))
        assert "A &amp; &lt;K&amp;R&gt;<hp:tab/>&lt;K&amp;R&gt; &lt;" in z.read("Contents/section2.xml").decode()
        assert "last {name}" in z.read("Contents/section10.xml").decode()
    assert n == 2
    with pytest.raises(NotImplementedError):
        hangul.set_text(hwpx(), {})


def test_set_and_fill():
    data, s = hwp(), "BodyText/Section0"
    new = hangul.set_text(data, {s: {1: ["one", "two"]}})
    assert hangul.raw_text(next(hangul.section_records(new))[1][1][2]) == "one\x02ABCDEFGtwo\r"
    blank = hangul.inspect(data)["sections"][0]["blank_paragraphs"][0]["header_index"]
    filled = hangul.fill_blank(data, {s: {blank: "filled"}})
    assert hangul.table_grid(hangul.tables(filled)[0])[1][0] == "filled" and not hangul.inspect(filled)["sections"][0]["blank_paragraphs"]
    for bad in ({0: "x"}, {1: "x"}, {999: "x"}):
        with pytest.raises(ValueError):
            hangul.fill_blank(data, {s: bad})
    with pytest.raises(ValueError):
        hangul.replace(hwp(3), [("a", "b")])


def test_records_round_trip():
    body = record(67, 2, b"ab") + record(1000, 1023, bytes(5000)) + record(66, 0, b"")
    assert hangul.packed(list(hangul.records(body))) == body


def test_compound_files():
    for sizes in ([0], [1, 63, 64, 65, 4095], [4096, 5000, 70000], [8_000_000]):
        own = {f"S{k}/T{k % 3}/stream{k}": bytes([k % 251]) * n for k, n in enumerate(sizes)} | {"top": b"x"}
        assert streams(compound.build(own)) == own
    many = {f"BinData/B{k:04}": b"%d" % k for k in range(300)}
    assert streams(compound.build(many)) == many


def test_is_hwpx():
    assert office.is_hwpx(hwpx()) and not office.is_hwpx(hwp()) and not office.is_hwpx(zipped({"a": "b"}))
