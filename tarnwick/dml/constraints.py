"""Validation of new states and rows by queries: a violation is a row that a query finds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError


def _refuse(bad: DataFrame, why: str) -> None:
    if bad.limit(1).count():
        raise ConstraintError(why)


def check_rows(table: dict, rows: DataFrame) -> None:
    """NOT NULL, declared sizes and CHECK of new or changed rows; a check that is NULL holds."""
    tests = [(F.col(f"`{c['name']}`").isNull(), f"{table['name']}.{c['name']} may not be NULL") for c in table["columns"] if not c["nullable"] and not c["computed"]]
    for c in table["columns"]:
        if c["declared"] in ("CHAR", "NCHAR", "VARCHAR", "NVARCHAR", "BINARY", "VARBINARY") and c["params"] and c["params"][0].isdigit():
            tests.append((F.length(f"`{c['name']}`") > int(c["params"][0]), f"{table['name']}.{c['name']} is longer than {c['params'][0]}"))
    tests += [(~F.coalesce(F.expr(k["check"]), F.lit(True)), f"{table['name']} breaks CHECK {k['name'] or k['check']}") for k in table["constraints"] if k["kind"] == "CHECK"]
    if not tests:
        return
    # one pass for all tests
    found = rows.select([F.max(F.coalesce(t, F.lit(False))).alias(f"t{i}") for i, (t, _) in enumerate(tests)]).first()
    for i, (_, why) in enumerate(tests):
        if found[i]:
            raise ConstraintError(why)


def unique_keys(table: dict, indexes: list[dict]) -> list[list[str]]:
    """Primary key first, then unique constraints, then plain unique indexes."""
    keys = [k["columns"] for kind in ("PRIMARY KEY", "UNIQUE") for k in table["constraints"] if k["kind"] == kind]
    return keys + [[e["column"] for e in i["elements"]] for i in indexes if i["unique"] and not i["where"] and all(e["column"] for e in i["elements"])]


def check_unique(table: dict, rows: DataFrame, indexes: list[dict], others: DataFrame | None = None) -> None:
    """Keys of new or changed rows, among themselves and against the others that stay; NULLs are distinct."""
    keys = [([F.col(f"`{c}`") for c in key], None, f"({', '.join(key)})") for key in unique_keys(table, indexes)]
    for i in indexes:
        if i["unique"] and (i["where"] or not all(e["column"] for e in i["elements"])):
            keys.append(([F.expr(e["sql"]) for e in i["elements"]], i["where"], f"index {i['name']}"))
    for columns, where, what in keys:
        part = lambda df, cs=columns, w=where: (df.filter(F.expr(w)) if w else df).select([c.alias(f"k{n}") for n, c in enumerate(cs)]).dropna()
        names = [f"k{n}" for n in range(len(columns))]
        _refuse(part(rows).groupBy(names).count().filter("count > 1"), f"{table['name']}: {what} is not unique")
        if others is not None:
            _refuse(part(rows).join(part(others), names, "left_semi"), f"{table['name']}: {what} is not unique")


def check_parents(table: dict, rows: DataFrame, parent_of) -> None:
    """Foreign keys of new or changed rows; a key with a NULL refers to nothing."""
    for k in table["constraints"]:
        if k["kind"] == "FOREIGN KEY":
            parent, keys = parent_of(k)
            orphan = rows.dropna(subset=k["columns"]).select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(k["columns"])])
            there = parent.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keys)])
            _refuse(orphan.join(there, [f"c{i}" for i in range(len(keys))], "left_anti"), f"{table['name']}: ({', '.join(k['columns'])}) has no row in {k['references']['table']}")
