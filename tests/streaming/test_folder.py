"""A watched folder: files become elements once, in the order in which they come."""

from sources.test_documents import book_xlsx, report_docx

from folioframe.streaming import parse, totals, watch


def test_watch(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.docx").write_bytes(report_docx())

    def run(name, mode):
        parse(spark, str(inbox), out, f"{state}/files", once=True).awaitTermination()
        found = watch(spark, out) if mode == "append" else totals(watch(spark, out))
        found.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{state}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    first = run("seen", "append")
    assert first.where("type = 'unit'").count() == 1 and first.where("format <> 'docx'").count() == 0
    (inbox / "b.xlsx").write_bytes(book_xlsx())
    (inbox / "c.xlsx").write_bytes(b"x")
    n = {(r.format, r.type): (r.n, r.errors) for r in run("counted", "complete").collect()}
    assert n["docx", "unit"] == (1, 0) and n["xlsx", "unit"] == (2, 0) and n["xlsx", "error"] == (1, 1)
