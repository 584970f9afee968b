"""Text functions as Catalyst expressions: whitespace, escaping, cell references, control codes."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Every character that counts as white space in Unicode-aware matching.
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}++|(?<!{WS}){WS}++\z", "")  # a run is tried once, from its head


def clean(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WS}+", " "))


# What is escaped, by what and in which order, is output.


def esc_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def gfm_cell(c: Column) -> Column:
    c = F.replace(esc_html(c), F.lit("|"), F.lit("\\|"))
    return F.replace(c, F.lit("\n"), F.lit(" "))


def hwp_cell(c: Column) -> Column:
    """Backslashes and bars escaped, line ends as <br>."""
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def comment_safe(c: Column) -> Column:
    return F.translate(c, "<>", "")


def esc_inline(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_\[\]<>~|])", r"\\$1")


def esc_md(c: Column) -> Column:
    """Inline marks escaped, then what would start a block, line by line."""

    def block(line: Column) -> Column:
        return (
            F.when(line.rlike(rf"^{WS}*#"), F.regexp_replace(line, rf"^({WS}*)#", r"$1\\#"))
            .when(line.rlike(rf"^{WS}*[-+]{WS}"), F.regexp_replace(line, rf"^({WS}*)([-+])({WS})", r"$1\\$2$3"))
            .when(line.rlike(rf"^{WS}*\p{{Nd}}+[.)]{WS}"), F.regexp_replace(line, rf"^({WS}*\p{{Nd}}+)([.)])({WS})", r"$1\\$2$3"))
            .when(line.rlike(rf"^{WS}*(-{{3,}}|={{3,}}){WS}*\z"), F.regexp_replace(line, rf"^({WS}*)", r"$1\\"))
            .otherwise(line)
        )

    return F.array_join(F.transform(F.split(esc_inline(c), "\n", -1), block), "\n")


def looks_numeric(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"^[-+]?[\p{Nd},]*\.?\p{Nd}+%?\z"), F.lit(False))


def column_letters(n: Column) -> Column:
    """1 is A, 27 is AA; up to 16384."""
    n = n.cast("int")
    letter = lambda x: F.char(F.lit(65) + x)
    last = letter((n - 1) % 26)
    middle = F.when(n > 26, letter(F.expr("0") + (F.floor((n - 27) / 26) % 26).cast("int"))).otherwise("")
    first = F.when(n > 702, letter(F.floor((n - 703) / 676).cast("int"))).otherwise("")
    return F.concat(first, middle, last)


def a1_ref(min_row: Column, min_col: Column, max_row: Column, max_col: Column) -> Column:
    return F.concat(column_letters(min_col), min_row.cast("string"), F.lit(":"), column_letters(max_col), max_row.cast("string"))


#: Control codes that take eight units, then those that take one.
CONTROL = r"(?s)[\x01-\x09\x0b\x0c\x0e-\x17].{0,7}|[\x00-\x1f]"


def control_strip(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def visible(c: Column) -> Column:
    """As ``control_strip``, with line and paragraph ends shown."""
    c = F.regexp_replace(c, r"(?s)[\x01-\x09\x0b\x0c\x0e-\x17].{0,7}|[\x00\x18-\x1f]", "")
    return F.regexp_replace(c, r"[\x0a\x0d]", "¶")


@F.pandas_udf(StringType())
def _unescaped(c: pd.Series) -> pd.Series:
    return c.map(html.unescape, na_action="ignore")


def run_text(c: Column, every_entity: bool = False) -> Column:
    """Markup of a text run as text: line breaks, tabs, other tags dropped, entities resolved. XML has five named entities;
    ``every_entity`` knows those of HTML and numbers too, in Python."""
    c = F.regexp_replace(c, r"<(?:\w+:)?lineBreak\s*/?>", "\n")
    c = F.regexp_replace(c, r"<(?:\w+:)?tab\b[^>]*/?>", "\t")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    if every_entity:
        return _unescaped(c)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
