"""Merged cells of ruled grids against tilings that are known, and objects between texts against a plain search."""

import random

from pyspark.sql import functions as F

from folioframe.operators import layout, pages

BOXES = "doc_id string, page int, kind string, x0 double, y0 double, x1 double, y1 double"


def tiling(seed, rows=6, cols=5):
    """Rectangles (row, col, rowspan, colspan) that fill a grid."""
    draw, free, out = random.Random(seed), {(r, c) for r in range(rows) for c in range(cols)}, []
    for r in range(rows):
        for c in range(cols):
            if (r, c) not in free:
                continue
            h, w = draw.randint(1, 3), draw.randint(1, 3)
            while not all((r + i, c + j) in free for i in range(h) for j in range(w)):
                h, w = (h - 1, w) if h > 1 else (h, w - 1)
            free -= {(r + i, c + j) for i in range(h) for j in range(w)}
            out.append((r, c, h, w))
    return out


def test_tilings(spark):
    """Each rectangle of a tiling is a cell, whatever its spans; grid lines that no rectangle draws don't count as lines."""
    drawn, want = [], {}
    for seed in range(40):
        cells = tiling(seed)
        ys, xs = sorted({y for r, _, h, _ in cells for y in (r, r + h)}), sorted({x for _, c, _, w in cells for x in (c, c + w)})
        want[f"d{seed}"] = sorted((ys.index(r), xs.index(c), ys.index(r + h) - ys.index(r), xs.index(c + w) - xs.index(c)) for r, c, h, w in cells)
        drawn += [(f"d{seed}", 1, "re", 40.0 * c, 20.0 * r, 40.0 * (c + w), 20.0 * (r + h)) for r, c, h, w in cells]
    found = pages.ruled_spans(spark.createDataFrame(drawn, BOXES)).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.row, r.col, r.rowspan, r.colspan))
    assert {k: sorted(v) for k, v in got.items()} == want and {r.grid for r in found} == {0}


def test_what_is_no_cell(spark):
    """A corner-shaped room and an open one are none; two grids with a gap between are two; no drawings give no cells."""
    line = lambda doc, *at: (doc, 1, "l", *map(float, at))
    room = [line("corner", *x) for x in ((0, 0, 80, 0), (0, 40, 80, 40), (0, 0, 0, 40), (80, 0, 80, 40), (40, 20, 80, 20), (40, 20, 40, 40))]
    wide = [line("open", *x) for x in ((0, 0, 80, 0), (0, 40, 80, 40), (0, 0, 0, 40))]
    two = [("two", 1, "re", 40.0 * c, y + 20.0 * r, 40.0 * c + 40, y + 20.0 * r + 20) for y in (0.0, 100.0) for r in range(2) for c in range(2)]
    found = pages.ruled_spans(spark.createDataFrame(room + wide + two, BOXES)).collect()
    assert [(r.row, r.col, r.rowspan, r.colspan) for r in found if r.doc_id == "corner"] == [(1, 1, 1, 1)]
    assert not [r for r in found if r.doc_id == "open"] and sorted((r.grid, r.row) for r in found if r.doc_id == "two") == [(0, 0), (0, 0), (0, 1), (0, 1), (1, 3), (1, 3), (1, 4), (1, 4)]
    assert pages.ruled_spans(spark.createDataFrame([], BOXES)).count() == 0


def test_table_with_a_merged_head(spark):
    """A head over two columns keeps its text, in the first of them."""
    cells = [(0, 0, 80, 20, "head"), (0, 20, 40, 40, "a"), (40, 20, 80, 40, "b"), (0, 40, 40, 60, "c"), (40, 40, 80, 60, "d")]
    boxes = spark.createDataFrame([("d", 1, "re", *map(float, c[:4])) for c in cells], BOXES)
    spans = spark.createDataFrame([("d", 1, n, 0, 0, t, float(x0 + 2), float(y0 + 2), float(x0 + 20), float(y0 + 12)) for n, (x0, y0, _, _, t) in enumerate(cells)], SPANS)
    assert [r.rows for r in pages.ruled_tables(boxes, spans).collect()] == [[["head", ""], ["a", "b"], ["c", "d"]]]


SPANS = "doc_id string, page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double"


def test_aligned_text(spark):
    """Columns by gaps over all rows; lines that overlap a little in height stay two rows; running text and single rows are no table."""
    rows = {
        "t": [("Title of the page", 0, 0, 90), ("name", 0, 30, 30), ("value", 60, 30, 85), ("x", 0, 41, 8), ("1", 70, 41, 75), ("2 3", 120, 41, 140), ("long name", 0, 52, 50), ("4", 62, 52, 66), ("", 200, 52, 240), ("end", 0, 90, 20)],
        "prose": [("words that", 0, 0, 50), ("go on", 52, 0, 80), ("and on", 0, 12, 40)],
        "single": [("a", 0, 0, 8), ("b", 60, 0, 68)],
        "bridged": [("a", 0, 0, 8), ("b", 60, 0, 68), ("cc", 5, 12, 62), ("d", 80, 12, 90), ("e", 0, 24, 4), ("f", 30, 24, 34)],
    }
    flat = [(d, 1, 0, n, 0, text, float(x0), float(y), float(x1), float(y + 12)) for d, own in rows.items() for n, (text, x0, y, x1) in enumerate(own)]
    spans = spark.createDataFrame(flat, SPANS)
    assert {r.doc_id: r.rows for r in pages.aligned_tables(spans).collect()} == {"t": [["name", "value", ""], ["x", "1", "2 3"], ["long name", "4", ""]], "bridged": [["a b", ""], ["cc", "d"], ["e f", ""]]}
    assert pages.aligned_cells(spans)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert pages.aligned_tables(spark.createDataFrame([], SPANS)).count() == 0


def test_interleave(spark):
    """Ties, texts in any order, objects without a place, pages with one kind only; brute force."""
    draw = random.Random(5)
    texts = [(f"d{d}", 1, n, draw.choice([None, *range(8)])) for d in range(12) for n in range(draw.randint(0, 9))]
    objects = [(f"d{d}", 1, n, draw.choice([None, *range(9)])) for d in range(12) for n in range(draw.randint(0, 4))]
    want = set()
    for d in {x[0] for x in texts + objects}:
        own = [(pos, top) for i, _, pos, top in texts if i == d]
        slot = lambda top: min((pos for pos, y in own if top is not None and y is not None and y >= top), default=1 << 31)  # noqa: B023, E731
        order = [(pos, 1, 0, pos, "text") for pos, _ in own] + [(slot(top), 0, -99 if top is None else -top, n, "object") for i, _, n, top in objects if i == d]
        want |= {(d, kind, n, nth) for nth, (*_, n, kind) in enumerate(sorted(order))}
    frame = lambda rows, name: spark.createDataFrame([(*r[:3], None if r[3] is None else float(r[3])) for r in rows], f"doc_id string, page int, {name} int, top double")
    found = layout.interleave(frame(texts, "pos"), frame(objects, "ord"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.doc_id, r.kind, r.ord, r.nth) for r in found.collect()} == want
    assert found.where(F.col("nth").isNull()).isEmpty()
