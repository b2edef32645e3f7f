"""The scalar function library.

Every function is a template from argument SQL to Spark SQL, so that it stays inside Catalyst; RENDER maps
names to templates.  fn(name, *args) gives the same as a Column for DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import convert, datetime, json, numeric, string

RENDER: dict[str, Callable[..., str]] = numeric.RENDER | string.RENDER | datetime.RENDER | convert.RENDER | json.RENDER


def fn(name: str, *args: str) -> Column:
    """A function of the dialect over SQL argument texts, e.g. fn('ROUND', 'price', '1')."""
    return F.expr(RENDER[name.upper()](*args))
