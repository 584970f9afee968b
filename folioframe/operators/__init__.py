"""Operators over atom tables: each takes DataFrames and returns one."""
