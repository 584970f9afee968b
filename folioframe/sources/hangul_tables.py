"""Tables of hwp and hwpx files (``hangul.tables``) as Markdown, CSV and JSON."""

from __future__ import annotations

import csv
import io

from .hangul import table_grid


def markdown(table: dict, expand: str = "blank") -> str:
    """A Markdown table, the first row its head, with a note that lists merged cells."""
    grid = table_grid(table, expand)
    if not (grid and table["ncols"]):
        return "(빈 표)"
    cell = lambda t: t.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>")
    lines = ["| " + " | ".join(map(cell, row)) + " |" for row in grid]
    lines.insert(1, "| " + " | ".join(["---"] * table["ncols"]) + " |")
    if table["spans"]:
        merged = ", ".join(f"(r{s['row']},c{s['col']})→{s['rowspan']}×{s['colspan']}" for s in table["spans"])
        lines += ["", f"> 병합 셀(rowspan×colspan): {merged}"]
    return "\n".join(lines)


def all_markdown(tables: list[dict], expand: str = "blank") -> str:
    return "\n\n".join(f"### 표 {t['index'] + 1} ({t['section']})\n\n{markdown(t, expand)}" for t in tables)


def as_csv(table: dict, expand: str = "duplicate") -> str:
    out = io.StringIO()
    csv.writer(out).writerows(table_grid(table, expand))
    return out.getvalue()


def as_json(tables: list[dict], expand: str = "blank") -> dict:
    return {"tables": [{k: t[k] for k in ("section", "index", "nrows", "ncols")} | {"grid": table_grid(t, expand), "spans": t["spans"]} for t in tables]}
