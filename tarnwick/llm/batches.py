"""Helpers for functions over Arrow batches."""

from __future__ import annotations

import pandas as pd


def strings(values: list[str]) -> pd.Series:
    """A column of plain objects: pandas' own string type may hand Arrow several chunks, which Spark refuses."""
    return pd.Series(values, dtype=object)
