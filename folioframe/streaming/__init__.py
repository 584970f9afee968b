"""Files that arrive in a folder, parsed as they come."""

from .folder import parse, totals, watch

__all__ = ["parse", "totals", "watch"]
