"""The relational core of INSERT conflict handling, UPDATE, DELETE and MERGE, for DataFrames.

None of these collects rows.  Rows are told apart by key columns, or by the hidden column RID: for a table's
rows their file and place in it, for others a number that numbered() adds.  Where the row-at-a-time rule is "first match wins", the order is that of the RID (of the key, where
given); it is a defined order, so results do not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RID = "__rid"


def numbered(df: DataFrame, name: str = RID) -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`") == F.col(f"{right}.`{k}`") for k in keys])


def first_of(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """Of the rows that agree in keys the first (or last) in order; a key with a NULL agrees with nothing."""
    null = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    w = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | null).drop("__n")


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[list[str]], order: str) -> DataFrame:
    """The rows to add: those that conflict in no key with the target or an earlier row."""
    for k in keys:
        rows = first_of(rows, k, order)
        rows = rows.alias("n").join(target.alias("t"), _same(k, "n", "t"), "left_anti")
    return rows


def insert_or_replace(target: DataFrame, rows: DataFrame, keys: list[list[str]], order: str) -> tuple[DataFrame, DataFrame]:
    """(RIDs of the target's rows that go, rows to add): later rows replace earlier ones and the target's."""
    for k in keys:
        rows = first_of(rows, k, order, last=True)
    hit = [target.alias("t").join(rows.alias("n"), _same(k, "t", "n"), "left_semi").select(RID) for k in keys]
    return reduce(DataFrame.unionByName, hit).distinct() if hit else target.select(RID).limit(0), rows


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], sets: dict[str, str], where: str | None = None, alias: str = "t") -> tuple[DataFrame, DataFrame]:
    """(updated rows of the target, with RID; rows to add); sets and where may name excluded and the target's alias."""
    both = target.alias(alias).join(rows.alias("excluded"), _same(keys, alias, "excluded"))
    hit = both.filter(F.expr(where)) if where else both
    updated = hit.select([F.expr(sets[c]).cast(target.schema[c].dataType).alias(c) if c in sets else F.col(f"{alias}.`{c}`").alias(c) for c in target.columns])
    return updated, rows.alias("n").join(target.alias("t0"), _same(keys, "n", "t0"), "left_anti")


def merge_actions(pairs: DataFrame, source_id: str, order: list[str]) -> DataFrame:
    """Of (source, target) matches: each source row's first target row, then each target row's first source row."""
    a = Window.partitionBy(source_id).orderBy(*order)
    b = Window.partitionBy(RID).orderBy(source_id)
    one = pairs.withColumn("__a", F.row_number().over(a)).filter("__a = 1").withColumn("__b", F.row_number().over(b)).filter("__b = 1")
    return one.drop("__a", "__b")
