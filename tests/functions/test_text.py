"""Text functions where the tables of the queries have no such characters."""

from pyspark.sql import functions as F

from folioframe.functions import clean, esc_md, looks_numeric, run_text, strip
from folioframe.operators import layout, records, tables


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_white_space_is_unicode(spark):
    assert one(spark, strip, "\u00a0 a\u3000b\x85\x1c", "\t", " " * 20000 + "x" + " " * 20000) == ["a\u3000b", "", "x"]
    assert one(spark, clean, "a\u00a0\u3000b\x0b", None) == ["a b", ""]
    assert one(spark, looks_numeric, "\u00a01,2.5%", "\u0661\u0662", "-", "1 2", None) == [True, True, False, False, False]
    assert one(spark, esc_md, "\u00a0# x\n-\nx", "\u0661. x", "- a") == ["\u00a0\\# x\n-\nx", "\u0661\\. x", "\\- a"]


def test_entities(spark):
    t = "a<hp:lineBreak/>b<hp:tab x='1'/>&lt;&eacute;&#233;<b>c</b>&amp;lt;"
    assert one(spark, run_text, t) == ["a\nb\t<&eacute;&#233;c&lt;"]
    assert one(spark, lambda c: run_text(c, every_entity=True), t, None) == ["a\nb\t<ééc&lt;", None]


def test_body_size_skips_blanks_of_any_kind(spark):
    spans = spark.createDataFrame([("d", 0, "\t", 9.0), ("d", 1, "\u00a0", 9.0), ("d", 2, "t", 12.0), ("e", 0, "a", 3.0), ("e", 1, "b", 1.0), ("e", 2, "c", 1.0), ("e", 3, "d", 3.0)], "doc_id string, span int, text string, size double")
    assert {r.doc_id: r.body for r in layout.body_size(spans).collect()} == {"d": 12.0, "e": 3.0}


def test_rules_in_order(spark):
    rows = spark.createDataFrame([(1, 1, "aXbX"), (1, 2, "X\\Ea1"), (2, 1, "XX a2")], "section int, rec int, text string")
    run = lambda *rules: {(r.section, r.rec): (r.text, r.replaced) for r in records.replace_rules(rows, list(rules), ["section", "rec"]).collect()}
    assert run({"old": "X", "new": "Y", "max": 4}) == {(1, 1): ("aYbY", 2), (1, 2): ("Y\\Ea1", 1), (2, 1): ("YX a2", 1)}
    assert run(("X", "a"), {"old": r"a(\d)", "new": "<$1>", "regex": True, "max": 1})[1, 2] == ("a\\E<1>", 2)
    assert run(("\\E", "!"))[1, 2] == ("X!a1", 1) and run(("", "z"))[1, 1] == ("aXbX", 0)


def test_section_heads(spark):
    rows = spark.createDataFrame([("a", 1, 1, "text", "x"), ("a", 1, 2, "text", "y"), ("b", 1, 1, "text", "z"), ("b", 2, 1, "text", "w")], "doc string, section int, rec int, tag string, text string")
    got = {(r.doc, r.section): r.text for r in records.section_text(rows, "doc").collect()}
    assert got == {("a", 1): "x\ny", ("b", 1): "=== 1 ===\nz", ("b", 2): "=== 2 ===\nw"}


def test_merges_lie_in_regions_as_a_whole(spark):
    cells = spark.createDataFrame([("s", 1, 1), ("s", 1, 2), ("s", 2, 2), ("s", 9, 9)], "sheet string, row int, col int")
    merges = spark.createDataFrame([("s", 1, 1, 2, 2), ("s", 2, 2, 3, 2)], "sheet string, r0 int, c0 int, r1 int, c1 int")
    got = tables.region_merges(merges, tables.region_of(cells)).collect()
    assert [(r.min_row, r.row, r.col, r.rowspan, r.colspan) for r in got] == [(1, 0, 0, 2, 2)]
