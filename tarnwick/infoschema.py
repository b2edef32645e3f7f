"""The INFORMATION_SCHEMA tables, built from the catalog's definitions (metadata only, so small)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "main"
#: Columns of each table; a * marks a number (names as in the SQL standard).
COLUMNS = {
    "tables": "table_schema table_name table_type",
    "columns": "table_schema table_name column_name ordinal_position* column_default is_nullable data_type character_maximum_length* numeric_precision* numeric_scale* is_generated generation_expression is_identity",
    "key_column_usage": "constraint_name table_schema table_name column_name ordinal_position*",
    "table_constraints": "constraint_name table_schema table_name constraint_type check_clause",
    "referential_constraints": "constraint_name table_name referenced_table_name update_rule delete_rule",
    "indexes": "table_schema table_name index_name is_unique column_name ordinal_position* is_descending filter_condition is_included",
    "views": "table_schema table_name view_definition",
    "triggers": "trigger_name event_manipulation event_object_table action_timing action_condition action_statement",
    "triggered_update_columns": "trigger_name event_object_table event_object_column",
    "routines": "routine_name routine_type data_type routine_definition",
    "parameters": "specific_name ordinal_position* parameter_name data_type",
    "sequences": "sequence_name start_value* current_value*",
}


def constraint_name(table: dict, k: dict) -> str:
    short = {"PRIMARY KEY": "pk", "UNIQUE": "uq", "FOREIGN KEY": "fk", "CHECK": "ck"}[k["kind"]]
    return k["name"] or "_".join([short, table["name"], *(k.get("columns") or [str(table["constraints"].index(k))])])


def rows(state: dict) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {k: [] for k in COLUMNS}
    for t in state["tables"].values():
        out["tables"].append((_SCHEMA, t["name"], "BASE TABLE"))
        for i, c in enumerate(t["columns"], 1):
            nums = [int(p) if p.isdigit() else None for p in c["params"]] + [None, None]
            text = c["type"] in ("string", "binary")
            out["columns"].append((_SCHEMA, t["name"], c["name"], i, c["default"], "YES" if c["nullable"] else "NO", c["declared"] or c["type"].upper(), nums[0] if text else None, None if text else nums[0], None if text else nums[1], "ALWAYS" if c["computed"] else "NEVER", c["computed"], "YES" if c["autoincrement"] else "NO"))
        for k in t["constraints"]:
            name = constraint_name(t, k)
            out["table_constraints"].append((name, _SCHEMA, t["name"], k["kind"], k.get("check")))
            out["key_column_usage"] += [(name, _SCHEMA, t["name"], c, i) for i, c in enumerate(k.get("columns") or [], 1)]
            if k["kind"] == "FOREIGN KEY":
                r = k["references"]
                out["referential_constraints"].append((name, t["name"], r["table"], r["on_update"], r["on_delete"]))
    for v in state["views"].values():
        out["tables"].append((_SCHEMA, v["name"], "VIEW"))
        out["views"].append((_SCHEMA, v["name"], v["source"]))
    for x in state["indexes"].values():
        n = 0
        for n, e in enumerate(x["elements"], 1):
            out["indexes"].append((_SCHEMA, x["table"], x["name"], "YES" if x["unique"] else "NO", e["column"] or e["sql"], n, "YES" if e["desc"] else "NO", x["where"], "NO"))
        out["indexes"] += [(_SCHEMA, x["table"], x["name"], "YES" if x["unique"] else "NO", c, n + i, "NO", x["where"], "YES") for i, c in enumerate(x["include"], 1)]
    for g in state["triggers"].values():
        out["triggers"].append((g["name"], g["event"], g["table"], g["time"], g["when"], "; ".join(g["body"])))
        out["triggered_update_columns"] += [(g["name"], g["table"], c) for c in g["columns"] or []]
    for kind, what in (("functions", "FUNCTION"), ("procedures", "PROCEDURE")):
        for r in state[kind].values():
            body = r["body"] if isinstance(r["body"], str) else "; ".join(r["body"])
            out["routines"].append((r["name"], what, r.get("type"), body))
            out["parameters"] += [(r["name"], i, p, t) for i, (p, t) in enumerate(r["parameters"], 1)]
    out["sequences"] = [(s["name"], s["start"], s["current"]) for s in state["sequences"].values()]
    return out


def frames(spark: SparkSession, state: dict) -> dict[str, DataFrame]:
    got = rows(state)
    return {k: spark.createDataFrame(got[k], ", ".join(f"{c.rstrip('*')} {'long' if c[-1] == '*' else 'string'}" for c in cols.split())) for k, cols in COLUMNS.items()}
