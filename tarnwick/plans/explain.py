"""A plan as rows (id, parent, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_rows(df: DataFrame) -> list[tuple[int, int, str]]:
    """Catalyst's optimised plan, one row for each operator; the root's parent is 0."""
    out, above = [], []
    for line in df._jdf.queryExecution().optimizedPlan().treeString().splitlines():
        text = line.lstrip(" :+-")
        if not text:
            continue
        depth = len(line) - len(text)
        while above and above[-1][0] >= depth:
            above.pop()
        out.append((len(out) + 1, above[-1][1] if above else 0, text))
        above.append((depth, len(out)))
    return out


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().treeString()
