"""Tables that every family shares: elements in document order, and units (pages, sheets, slides, whole documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

SPAN = "struct<row:int,col:int,rowspan:int,colspan:int>"
CHART = "struct<kind:string,title:string,series_refs:array<string>,categories:array<string>,series:array<struct<name:string,ref:string,values:array<string>>>>"
#: (doc_id, unit_no, elem_no) is the order of a document. Rows of type ``unit`` come before the elements of their unit and
#: carry its title (text) and ``signals``, the conditions of the quality model that hold, in order of emission.
ELEMENTS = (
    "doc_id string, format string, unit_no int, elem_no int, type string, text string, level int, ref string, note string, path string, "
    f"bbox struct<x0:double,y0:double,x1:double,y1:double>, rows array<array<string>>, spans array<{SPAN}>, nested string, chart {CHART}, "
    "signals array<string>, props map<string,string>, error string"
)


def shaped(elements: DataFrame) -> DataFrame:
    """All columns of ELEMENTS; those that are not there are null."""
    have = set(elements.columns)
    return elements.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse_datatype_string(ELEMENTS)])
