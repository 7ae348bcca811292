"""A point-in-time market research engine on PySpark."""
