"""The SQL dialect: text in, Spark SQL out."""

from .parser import Parser, parse_script

__all__ = ["Parser", "parse_script"]
