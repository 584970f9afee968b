"""Decoders of office files and PDFs; all of them are in ``office.DECODERS``."""

from . import hangul, office, pdf, sheets

office.DECODERS.update(sheets.DECODERS | hangul.DECODERS | pdf.DECODERS)
