"""Binary hwp files built in memory, with a short stream, a long one and one that is cut off."""

import struct
import zlib

from pyspark.sql import functions as F

from folioframe.functions.text import control_strip
from folioframe.sources import office
from folioframe.sources.hangul import Compound, records

END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def entry(name, kind, start=END, size=0, left=FREE, right=FREE, inner=FREE):
    raw = (name + "\0").encode("utf-16-le")
    return raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, left, right, inner) + bytes(36) + struct.pack("<IQ", start, size)


def compound(header, sections):
    """Sector 0 is the FAT, 1 to 2 the directory, 3 the mini FAT; then the mini stream and long streams."""
    streams = [("FileHeader", header), *[(f"Section{k}", b) for k, b in sections]]
    mini, mini_fat, body, fat, places = b"", [], b"", {0: FAT, 1: 2, 2: END, 3: END}, {}
    at = 4

    def put(data):
        nonlocal at, body
        n = -(-len(data) // 512)
        for k in range(n):
            fat[at + k] = at + k + 1 if k < n - 1 else END
        body += data.ljust(n * 512, b"\0")
        at, start = at + n, at
        return start if n else END

    for name, data in streams:
        if len(data) < 4096:
            first, n = len(mini_fat), -(-len(data) // 64)
            mini_fat += [first + k + 1 for k in range(n - 1)] + [END] * (n > 0)
            mini += data.ljust(n * 64, b"\0")
            places[name] = (first if n else END, len(data))
        else:
            places[name] = (put(data), len(data))
    root = (put(mini), len(mini))
    entries = [entry("Root Entry", 5, *root, inner=1), entry("FileHeader", 2, *places["FileHeader"], right=2), entry("BodyText", 1, inner=3)]
    for i, (k, _) in enumerate(sections):
        entries.append(entry(f"Section{k}", 2, *places[f"Section{k}"], right=4 + i if i < len(sections) - 1 else FREE))
    directory = b"".join(entries).ljust(1024, b"\0")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, 1, 1, 0, 4096, 3, 1, END, 0) + struct.pack("<109I", 0, *[FREE] * 108)
    table = struct.pack("<128I", *[fat.get(k, FREE) for k in range(128)])
    return head + table + directory + struct.pack("<128I", *(mini_fat + [FREE] * (128 - len(mini_fat)))) + body


def record(tag, level, payload):
    size = len(payload)
    return struct.pack("<I", tag | level << 10 | min(size, 0xFFF) << 20) + (struct.pack("<I", size) if size >= 0xFFF else b"") + payload


def packed(b):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(b) + c.flush()


def header(flags):
    return b"HWP Document File".ljust(32, b"\0") + struct.pack("<II", 0x05000300, flags)


def test_records(spark):
    u = lambda s: s.encode("utf-16-le")
    first = record(66, 0, bytes(24)) + record(67, 1, u("가나\x02ABCDEFG다\r"))
    long = record(67, 1, u("x" * 6000))
    plain = b"".join(record(67, 0, u(str(k) * 40)) for k in range(10)) * 6
    small = compound(header(1), [(10, packed(long)), (2, packed(first))])
    large = compound(header(0), [(0, plain)])
    assert len(plain) > 4096 and sorted(Compound(large).paths) == ["BodyText/Section0", "FileHeader"]
    files = spark.createDataFrame([("a", bytearray(small)), ("b", bytearray(large)), ("c", bytearray(compound(header(3), [(0, b"")]))), ("d", bytearray(b"zz"))], "path string, content binary")
    rows = office.decode(files, "hwp_records").withColumn("shown", control_strip(F.col("text"))).collect()
    assert [(r.section_no, r.rec, r.tag, r.level, r.shown) for r in rows if r.doc_id == "a"] == [(2, 0, 66, 0, None), (2, 1, 67, 1, "가나다"), (10, 0, 67, 1, "x" * 6000)]
    assert [r.text for r in rows if r.doc_id == "b"] == [str(k) * 40 for k in range(10)] * 6
    assert {r.doc_id: r.error for r in rows if r.error} == {"c": "ValueError: the document is encrypted", "d": "ValueError: not a compound file"}
    assert list(records(record(67, 3, b"abcd")[:-2])) == [(67, 3, b"ab")]
