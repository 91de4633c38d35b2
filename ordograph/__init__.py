"""Graph bandwidth and ordering analytics on PySpark."""
