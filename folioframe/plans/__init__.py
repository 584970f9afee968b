"""Compositions of operators: renderers and the queries over the driver's tables."""
