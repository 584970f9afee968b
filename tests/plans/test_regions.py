"""Regions against a recursive cutter of sheets, on random sheets and on the query's own cells."""

import random

from folioframe.operators import tables
from folioframe.plans.queries import sheet_cells


def recursive(cells):
    """Cut at the first empty row, else at the first empty column, and each part again; a list in place of deep calls."""
    todo, out = [set(cells)], []
    while todo:
        block = todo.pop()
        for axis in (0, 1):
            used = sorted({c[axis] for c in block})
            gap = next((b for a, b in zip(used, used[1:]) if b > a + 1), None)
            if gap is not None:
                todo += [{c for c in block if c[axis] < gap}, {c for c in block if c[axis] >= gap}]
                break
        else:
            rows, cols = zip(*block)
            out.append((min(rows), min(cols), max(rows), max(cols), len(block)))
    return out


def by_sheet(found):
    return sorted((r.sheet, r.min_row, r.min_col, r.max_row, r.max_col, r["cells"]) for r in found.collect())


def expected(rows):
    sheets = {}
    for s, r, c in rows:
        sheets.setdefault(s, []).append((r, c))
    return sorted((s, *box) for s, cells in sheets.items() for box in recursive(cells))


def nested(depth, row=1, col=1):
    """Cells that need ``depth`` cuts, each inside a part of the one before."""
    if not depth:
        return [(row, col)]
    inner = nested(depth - 1, row, col)
    low, right = max(r for r, _ in inner), max(c for _, c in inner)
    if depth % 2:
        return inner + [(low + 2, c) for c in range(col, right + 1)]
    return inner + [(r, right + 2) for r in range(row, low + 1)]


def test_random_sheets(spark):
    rnd = random.Random(5)
    rows = [(s, r, c) for s in range(60) for r in range(1, 16) for c in range(1, 12) if rnd.random() < (0.08, 0.2, 0.35)[s % 3]]
    rows += [(100 + d, r, c) for d in range(1, 10) for r, c in nested(d)]
    cells = spark.createDataFrame(rows, "sheet long, row int, col int")
    assert by_sheet(tables.regions(cells)) == expected(rows)
    assert tables.regions(cells.where("sheet < 0")).count() == 0


def test_cells_of_the_query(spark):
    cells = sheet_cells(spark, "/root/testdata/sf0.01")
    want = expected([tuple(r) for r in cells.select("sheet", "row", "col").collect()])
    assert by_sheet(tables.regions(cells)) == want
    assert len(want) == 2405
