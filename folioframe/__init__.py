"""Document-structure analytics on PySpark."""
