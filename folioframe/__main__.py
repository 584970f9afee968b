"""Commands over files: ``python -m folioframe <command> ...``.

    pdf-parse, xlsx-parse, docx-parse, pptx-parse  FILE... -o FOLDER   Markdown and JSON of each file
    pdf-triage   FILE...          the plan of each page, and totals of routes
    hwp-extract  FILE             readable text
    hwp-inspect  FILE             streams, records, paragraphs and blank paragraphs
    hwp-tables   FILE             tables as Markdown, CSV or JSON
    hwp-edit     replace|set|fill-blank IN OUT   an edited copy

Errors in a file end a command with 2, no tables with 1.
"""

from __future__ import annotations

import argparse
import atexit
import json
import os
import shutil
import sys
import tempfile

from .sources import hangul, hangul_tables


def _spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("folioframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _write(path: str | None, body: str) -> None:
    if path:
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(body)
    else:
        sys.stdout.write(body if body.endswith("\n") else body + "\n")


def page_list(given: str) -> list[int]:
    """1,3-5 as numbers from 1."""
    out: list[int] = []
    for part in given.split(","):
        first, _, last = part.strip().partition("-")
        if not first.isdigit() or (last and not last.isdigit()) or int(first) < 1 or (last and int(last) < int(first)):
            raise ValueError(f"bad page selection {part.strip()!r}: pages count from 1")
        out += range(int(first), int(last or first) + 1)
    return sorted(set(out))


def _files(spark, paths: list[str]):
    from pyspark.sql import functions as F

    for p in paths:
        if not os.path.exists(p):
            raise ValueError(f"file not found: {p!r}")
    return spark.read.format("binaryFile").load([os.path.abspath(p) for p in paths]).select(F.col("path"), "content")


def scratch() -> str:
    """A folder of this process, which runs Spark in itself, for atoms; it goes at exit."""
    folder = tempfile.mkdtemp(prefix="folioframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def parse(kind: str, a: argparse.Namespace) -> int:
    from . import documents
    from .sources.documents import elements

    spark = _spark()
    files = _files(spark, a.files)
    found = (documents.from_pdf(files) if kind == "pdf" else elements(files, store=scratch())).cache()
    if kind == "pdf" and a.pages:
        found = found.where(found.unit_no.isin(page_list(a.pages)) | found.error.isNotNull())
    bad = found.where("error is not null").select("doc_id", "error").collect()
    for r in bad:
        print(f"error: {r.doc_id}: {r.error}", file=sys.stderr)
    rendered = kind == "pdf" and a.render and _render(found, a)
    for made in documents.save(found.where("error is null"), a.out, "assets" if kind == "pdf" else None, "render" if rendered else None):
        print(*made, sep="\n")
    if kind == "pdf":
        for path in a.files:
            _save_images(path, os.path.join(a.out, "assets"))
    if a.crosscheck:
        for p in a.files:
            if (text := documents.crosscheck(p)) is not None:
                _write(os.path.join(a.out, os.path.basename(p) + ".crosscheck.md"), text)
    return 2 if bad else 0


def _save_images(path: str, folder: str) -> None:
    """The images that a page's elements name, as files."""
    from .operators.pages import IMAGE_SHARE
    from .sources import pdf

    try:
        data = _read(path)
        whole = {page: width * height for page, width, height in pdf.pdf_pages(data)}
        found: dict[tuple, list] = {}
        for page, _, xref, x0, y0, x1, y1, _, _, png in pdf.pdf_images(data):
            own = found.setdefault((page, xref), [0.0, png])
            own[0] = max(own[0], abs((x1 - x0) * (y1 - y0)))
    except pdf.PdfError:
        return  # reported with the file's elements
    count: dict[int, int] = {}
    for (page, _), (area, png) in found.items():
        if area >= IMAGE_SHARE * whole[page]:
            nth = count[page] = count.get(page, -1) + 1
            if png:
                os.makedirs(folder, exist_ok=True)
                with open(os.path.join(folder, f"p{page}_img{nth}.png"), "wb") as f:
                    f.write(png)


def _render(found, a: argparse.Namespace) -> bool:
    """PNG files of the pages that need vision, where a renderer is plugged in; a failure is a warning. Whether all are there."""
    from .documents import units
    from .sources import pdf

    whole, folder = True, os.path.join(a.out, "render")
    for r in units(found).where("needs_vision").select("doc_id", "unit_no").toLocalIterator():
        try:
            png = pdf.render(_read(r.doc_id.removeprefix("file:")), r.unit_no, a.dpi)
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, f"page_{r.unit_no:03d}.png"), "wb") as f:
                f.write(png)
        except pdf.PdfError as e:
            whole = False
            print(f"warning: page {r.unit_no} not rendered: {e}", file=sys.stderr)
    return whole


def triage(a: argparse.Namespace) -> int:
    from . import documents

    found = documents.from_pdf(_files(_spark(), a.files)).where("type in ('unit', 'error')").orderBy("doc_id", "unit_no").collect()
    rows = [{"file": os.path.basename(r.doc_id), "page": r.unit_no, **dict(r.props or {}), **({"error": r.error} if r.error else {})} for r in found]
    totals: dict[str, int] = {}
    for r in rows:
        if "route" in r:
            totals[r["route"]] = totals.get(r["route"], 0) + 1
    if a.json:
        print(json.dumps({"pages": rows, "routes": totals}, ensure_ascii=False, indent=2))
    else:
        for r in rows:
            print(f"{r['file']} page {r['page']}: {r.get('route', 'error')}{' + vision' if r.get('needs_vision') == 'true' else ''} - {r.get('reason', r.get('error'))}")
        print("routes: " + ", ".join(f"{k}={v}" for k, v in sorted(totals.items())))
    return 2 if any("error" in r for r in rows) else 0


def extract(a: argparse.Namespace) -> int:
    _write(a.out, hangul.text(_read(a.file), not a.no_table_markers))
    return 0


def inspect(a: argparse.Namespace) -> int:
    told = hangul.inspect(_read(a.file))
    if a.json:
        _write(None, json.dumps(told, ensure_ascii=False, indent=2))
        return 0
    print(f"format={told['format']} compressed={told['compressed']} encrypted={told['encrypted']}")
    for name, size in told["streams"].items():
        print(f"  {size:>9}  {name}")
    for s in told["sections"]:
        print(f"{s['name']}: {s['record_count']} records, " + ", ".join(f"{k}={v}" for k, v in s["tag_counts"].items()))
        if a.paragraphs:
            for p in s["paragraphs"]:
                print(f"  [{p['rec_index']}] {p['text']}")
            for p in s["blank_paragraphs"]:
                print(f"  [{p['header_index']}] (blank, text at level {p['suggested_text_level']})")
    return 0


def tables(a: argparse.Namespace) -> int:
    found = hangul.tables(_read(a.file))
    if a.table is not None:
        found = [t for t in found if t["index"] == a.table - 1]
    if not found:
        print("no tables", file=sys.stderr)
        return 1
    expand = a.expand or ("duplicate" if a.format == "csv" else "blank")
    if a.format == "md":
        body = hangul_tables.all_markdown(found, expand)
    elif a.format == "json":
        body = json.dumps(hangul_tables.as_json(found, expand), ensure_ascii=False, indent=2)
    else:
        body = "\r\n".join(hangul_tables.as_csv(t, expand) for t in found)
    _write(a.out, body)
    return 0


def edit(a: argparse.Namespace) -> int:
    data = _read(a.file)
    if a.what == "replace":
        rules = [tuple(p.split("=", 1)) for p in a.pair or []] + (json.loads(_read(a.rules)) if a.rules else [])
        made, n = hangul.replace(data, rules)
        print(f"{n} replacement(s)")
        if not n:
            print("warning: nothing was replaced", file=sys.stderr)
    else:
        made = (hangul.set_text if a.what == "set" else hangul.fill_blank)(data, json.loads(_read(a.edits)))
    with open(a.out, "wb") as f:
        f.write(made)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="folioframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    for kind in ("pdf", "xlsx", "docx", "pptx"):
        c = commands.add_parser(f"{kind}-parse")
        c.add_argument("files", nargs="+")
        c.add_argument("-o", "--out", default="out")
        c.add_argument("--crosscheck", action="store_true")
        if kind == "pdf":
            c.add_argument("--pages")
            c.add_argument("--render", action="store_true")
            c.add_argument("--dpi", type=int, default=200)
        c.set_defaults(run=lambda a, kind=kind: parse(kind, a))
    c = commands.add_parser("pdf-triage")
    c.add_argument("files", nargs="+")
    c.add_argument("--json", action="store_true")
    c.set_defaults(run=triage)
    c = commands.add_parser("hwp-extract")
    c.add_argument("file")
    c.add_argument("-o", "--out")
    c.add_argument("--no-table-markers", action="store_true")
    c.set_defaults(run=extract)
    c = commands.add_parser("hwp-inspect")
    c.add_argument("file")
    c.add_argument("--json", action="store_true")
    c.add_argument("--paragraphs", action="store_true")
    c.set_defaults(run=inspect)
    c = commands.add_parser("hwp-tables")
    c.add_argument("file")
    c.add_argument("-f", "--format", choices=("md", "csv", "json"), default="md")
    c.add_argument("--expand", choices=("blank", "duplicate"))
    c.add_argument("-t", "--table", type=int)
    c.add_argument("-o", "--out")
    c.set_defaults(run=tables)
    c = commands.add_parser("hwp-edit")
    c.add_argument("what", choices=("replace", "set", "fill-blank"))
    c.add_argument("file")
    c.add_argument("out")
    c.add_argument("--pair", action="append", help="OLD=NEW, as often as needed")
    c.add_argument("--rules", help="JSON list of rules")
    c.add_argument("--edits", help="JSON {section: {index: text or lines}}")
    c.set_defaults(run=edit)
    a = top.parse_args(argv)
    try:
        return a.run(a)
    except (OSError, ValueError, NotImplementedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
