"""Tables of record levels against a plain reader of one section, and a long section."""

import random
import struct

from pyspark.sql import functions as F

from folioframe.operators import records
from folioframe.sources.hangul import record_tables, table_grid

SCHEMA = "doc_id string, section string, rec int, tag int, level int, text string, payload binary"


def random_section(rnd):
    out = []

    def paragraphs(level, depth):
        for _ in range(rnd.randint(0, 3)):
            out.append((66, level, b""))
            if rnd.random() < 0.8:
                out.append((67, level + 1, rnd.choice("abc").encode("utf-16-le") + rnd.choice(["", "\n", "z"]).encode("utf-16-le")))
            if depth and rnd.random() < 0.5:
                table(level + 1, depth - 1)
            if rnd.random() < 0.1:
                out.append((72, level + 1, b"\0" * 6))  # too short for a cell

    def table(level, depth):
        out.append((71, level, b""))
        size = rnd.choice([(0, 0), (3, 3), (2, 4)])
        out.append((77, level + 1, struct.pack("<I2H", 0, *size)[: rnd.choice([8, 8, 5])]))
        for _ in range(rnd.randint(0, 4)):
            out.append((72, level + 1, bytes(6) + struct.pack("<4H", rnd.randint(0, 3), rnd.randint(0, 3), rnd.randint(0, 2), rnd.randint(0, 2))))
            paragraphs(level + 2, depth)

    paragraphs(0, 3)
    return out


def test_random_sections(spark):
    rnd = random.Random(11)
    sections = {(f"d{k % 9}", f"S{k}"): random_section(rnd) for k in range(60)}
    sections["none", "S0"] = [(66, 0, b""), (67, 1, "q".encode("utf-16-le"))]
    rows = [(d, s, i, t, level, p.decode("utf-16-le") if t == 67 else None, bytearray(p)) for (d, s), found in sections.items() for i, (t, level, p) in enumerate(found)]
    atoms = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    made = {key: list(record_tables(found)) for key, found in sections.items()}
    want = sorted((*key, k, t["nrows"], t["ncols"], i, c["row"], c["col"], c["rowspan"], c["colspan"], c["text"]) for key, found in made.items() for k, (_, t) in enumerate(found) for i, c in enumerate(t["cells"]))
    got = sorted(map(tuple, records.tables(atoms).select("doc_id", "section", "table", "nrows", "ncols", "cell", "row", "col", "rowspan", "colspan", "text").collect()))
    assert got == want and len(want) > 100
    shown = {(r.doc_id, r.section, r.rec): r for r in records.elements(atoms).collect()}
    for key, found in made.items():
        for rec, t in found:
            r = shown[(*key, rec)]
            assert [list(x) for x in r.rows] == table_grid(t) and [tuple(s) for s in r.spans or []] == [(s["row"], s["col"], s["rowspan"], s["colspan"]) for s in t["spans"]]
    assert shown["none", "S0", 1].text == "q" and sum(r.type == "table" for r in shown.values()) == sum(map(len, made.values()))
    assert records.tables(atoms.where("rec < 0")).count() == records.elements(atoms.where("rec < 0")).count() == 0


def test_long_section(spark):
    """200,000 records of one section, tables in cells throughout; nothing of it is held in Python."""
    n = 20_000
    zero = "00000000000000000000000001000100"
    parts = [(66, 0, None), (71, 1, None), (77, 2, "0" * 16), (72, 2, zero), (66, 3, None), (67, 4, "out"), (71, 4, None), (77, 5, "0" * 16), (72, 5, zero), (66, 6, None), (67, 7, "in")]
    told = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(v).alias("level"), F.lit(x if t == 67 else None).cast("string").alias("text"), F.unhex(F.lit(x if t in (72, 77) else "")).alias("payload")) for t, v, x in parts])
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("S").alias("section"), F.posexplode(told).alias("j", "r"), "id").select("doc_id", "section", (F.col("id") * len(parts) + F.col("j")).cast("int").alias("rec"), "r.*")
    found = records.tables(rows)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.text, r["count"]) for r in found.groupBy("text").count().collect()} == {("out", n), ("in", n)}
    assert found.agg(F.count_distinct("table")).first()[0] == 2 * n
