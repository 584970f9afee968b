"""Files out of executors: names that never meet, tasks that are run again, and what is refused."""

import os

import pytest
from pyspark.errors import PySparkException

from folioframe import documents
from folioframe.schema import shaped
from folioframe.sources import sink


def paragraphs(spark, ids):
    rows = [(i, "docx", 1, n, kind, text) for i in ids for n, (kind, text) in enumerate((("unit", None), ("paragraph", f"text of {i}")))]
    return shaped(spark.createDataFrame(rows, "doc_id string, format string, unit_no int, elem_no int, type string, text string"))


def test_stems_never_meet(spark, tmp_path):
    """Base names that differ by folder, ending or case only; a name that looks like another's with its ending; one without a base name."""
    ids = ["a/x.docx", "b/x.docx", "x.pptx", "X.hwp", "x.docx.pptx", "alone.docx", ".hidden", "c:\\d\\win.docx"]
    got = dict(documents.stems(spark.createDataFrame([(i,) for i in ids], "doc_id string")).collect())
    assert got.keys() == set(ids) and len({s.lower() for s in got.values()}) == len(ids)
    assert (got["alone.docx"], got["x.docx.pptx"], got["c:\\d\\win.docx"], got[".hidden"]) == ("alone", "x.docx", "win", ".hidden")
    assert got["a/x.docx"].startswith("x.docx-") and got["X.hwp"].startswith("X.hwp-")
    found = paragraphs(spark, ids)
    made = dict(documents.save(found, str(tmp_path)))
    assert sorted(os.listdir(tmp_path)) == sorted(s + end for s in got.values() for end in (".md", ".json"))
    for i, stem in got.items():
        body = (tmp_path / f"{stem}.md").read_text(encoding="utf-8")
        assert f"text of {i}" in body and str(tmp_path / f"{stem}.md") in made


def test_written_twice(spark, tmp_path):
    """A task that runs again, here after it has written all of its rows, leaves one file each and nothing hidden."""
    sink.register(spark)
    rows = spark.createDataFrame([(f"{k}.md", f"body {k}" if k else None) for k in range(40)], "name string, body string")
    for _ in range(2):
        rows.repartition(4).write.format("text_files").mode("append").save(str(tmp_path / "new" / "er"))
    assert sorted(os.listdir(tmp_path / "new" / "er")) == sorted(f"{k}.md" for k in range(40))
    assert (tmp_path / "new" / "er" / "7.md").read_text() == "body 7" and (tmp_path / "new" / "er" / "0.md").read_text() == ""
    writer = sink._Writer(str(tmp_path / "lost"))
    writer.write(rows.limit(3).collect())
    (tmp_path / "lost" / f"{writer.mark}.1").write_text("half")
    (tmp_path / "lost" / ".mine").write_text("kept")
    writer.write(rows.limit(3).collect())
    writer.abort([None])
    assert sorted(os.listdir(tmp_path / "lost")) == [".mine", "0.md", "1.md", "2.md"]


def test_refused(spark, tmp_path):
    sink.register(spark)
    with pytest.raises(PySparkException, match="not the name of a file"):
        spark.createDataFrame([("../up.md", "x")], "name string, body string").write.format("text_files").mode("append").save(str(tmp_path))
    with pytest.raises(PySparkException, match="takes the columns"):
        spark.range(1).write.format("text_files").mode("append").save(str(tmp_path))
