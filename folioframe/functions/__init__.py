"""Column functions shared by all document families."""

from .text import a1_ref, clean, column_letters, comment_safe, control_strip, esc_html, esc_inline, esc_md, gfm_cell, hwp_cell, looks_numeric, run_text, strip, visible

__all__ = ["a1_ref", "clean", "column_letters", "comment_safe", "control_strip", "esc_html", "esc_inline", "esc_md", "gfm_cell", "hwp_cell", "looks_numeric", "run_text", "strip", "visible"]
