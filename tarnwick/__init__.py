"""tarnwick: a SQL and DataFrame analytics engine expressed on PySpark."""

__version__ = "0.1.0"
