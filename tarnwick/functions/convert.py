"""Conversions: lenient, a text that does not parse becomes zero (numbers), false (booleans) or NULL (dates); plus NULL and id functions."""

from __future__ import annotations

#: Type names of the dialect and their Spark types (fixed values).
TYPES = {
    "TINYINT": "tinyint", "INT8": "tinyint", "UTINYINT": "smallint", "UINT8": "smallint", "SMALLINT": "smallint", "INT16": "smallint", "USMALLINT": "int", "UINT16": "int",
    "INT": "int", "INT32": "int", "INTEGER": "int", "UINT": "bigint", "UINT32": "bigint", "BIGINT": "bigint", "INT64": "bigint", "LONG": "bigint",
    "UBIGINT": "decimal(20,0)", "UINT64": "decimal(20,0)", "ULONG": "decimal(20,0)", "FLOAT16": "float", "HALF": "float", "FLOAT": "float", "FLOAT32": "float", "REAL": "float",
    "DOUBLE": "double", "FLOAT64": "double", "DECIMAL": "decimal(38,10)", "NUMERIC": "decimal(38,10)", "MONEY": "decimal(38,10)", "BOOLEAN": "boolean", "BOOL": "boolean",
    "DATE": "date", "DATEONLY": "date", "TIME": "interval day to second", "TIMEONLY": "interval day to second", "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz",
    "DATETIMEOFFSET": "struct<ts:timestamp,offset_min:int>", "INTERVAL": "interval day to second", "TIMESPAN": "interval day to second", "GUID": "string", "UUID": "string", "UNIQUEIDENTIFIER": "string",
    "CHAR": "string", "NCHAR": "string", "VARCHAR": "string", "NVARCHAR": "string", "TEXT": "string", "NTEXT": "string", "BINARY": "binary", "VARBINARY": "binary", "BLOB": "binary",
    "ROWVERSION": "bigint", "JSON": "string", "JSONB": "string",
}
#: Runtime class names by Spark type name (fixed values).
CLASSES = {
    "Integer": ("tinyint", "smallint", "int", "bigint"), "Real": ("float", "double"), "Decimal": ("decimal",), "Boolean": ("boolean",), "DateOnly": ("date",),
    "DateTime": ("timestamp", "timestamp_ntz"), "TimeSpan": ("interval",), "Text": ("string",), "Blob": ("binary",), "Null": ("void",),
}
#: Words that Spark reads as moments but the dialect reads as text (fixed values).
SPECIAL_MOMENTS = r"(?i)^\s*(epoch|now|today|tomorrow|yesterday)\b"


def spark_type(name: str, params: tuple[str, ...] = ()) -> str:
    """The Spark type of a type name; an unknown name is a string."""
    kind = TYPES.get(name.upper(), "string")
    if kind.startswith("decimal(38") and params:
        return f"decimal({params[0]},{params[1] if len(params) > 1 else 0})"
    return kind


def cast(x: str, kind: str) -> str:
    """A lenient cast to a Spark type."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE coalesce(try_cast({x} as bigint), try_cast(try_cast({x} as double) as bigint), 0L) END"
    if kind in ("float", "double"):
        return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE coalesce(try_cast({x} as double), 0d) END"
    if kind.startswith("decimal"):
        return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE coalesce(try_cast({x} as {kind}), cast(0 as {kind})) END"
    if kind == "boolean":
        return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE coalesce(try_cast({x} as boolean), try_cast({x} as double) <> 0, false) END"
    if kind in ("date", "timestamp_ntz"):
        return f"CASE WHEN cast({x} as string) RLIKE r'{SPECIAL_MOMENTS}' THEN NULL ELSE try_cast({x} as {kind}) END"
    return f"cast({x} as {kind})"


def compare(column: str, op: str, text: str, kind: str) -> str:
    """column op 'text' for a column of the given Spark type: text that does not parse equals nothing and differs from everything."""
    if kind == "string":
        return f"({column} {op} {text})"
    value = f"try_cast({text} as {kind})" if kind not in ("date", "timestamp", "timestamp_ntz") else f"CASE WHEN {text} RLIKE r'{SPECIAL_MOMENTS}' THEN NULL ELSE try_cast({text} as {kind}) END"
    as_text = f"cast({column} as string) {op} {text}"
    return f"CASE WHEN {column} IS NULL OR {text} IS NULL THEN NULL WHEN ({value}) IS NOT NULL THEN {column} {op} ({value}) ELSE {as_text} END"


def typeof(x: str) -> str:
    arms = " ".join(f"WHEN typeof({x}) RLIKE '^({'|'.join(v)})' THEN '{k}'" for k, v in CLASSES.items())
    return f"CASE {arms} ELSE 'Text' END"


def _to(kind: str):
    return lambda x: cast(x, kind)


RENDER = {
    "COALESCE": lambda *a: f"coalesce({', '.join(a)})",
    "NULLIF": lambda a, b: f"nullif({a}, {b})",
    "IFNULL": lambda a, b: f"coalesce({a}, {b})",
    "NVL": lambda a, b: f"coalesce({a}, {b})",
    "IIF": lambda c, a, b: f"if({c}, {a}, {b})",
    "NEWGUID": lambda: "uuid()",
    "NEWUUID": lambda: "uuid()",
    "TYPEOF": typeof,
    "HEX": lambda x: f"hex({x})",
    "UNHEX": lambda x: f"unhex({x})",
    "BASE64": lambda x: f"base64(cast({x} as binary))",
    "UNBASE64": lambda x: f"unbase64({x})",
    "CONVERT": lambda x, kind: cast(x, spark_type(kind.strip("'"))),
    "TOGUID": lambda x: f"CASE WHEN cast({x} as string) RLIKE '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$' THEN lower(cast({x} as string)) END",
    "TODATETIME": _to("timestamp_ntz"),
    "TODECIMAL": _to("decimal(38,10)"),
    "DATABASE": lambda: "'tarnwick'",
    "VERSION": lambda: "'0.1.0'",
} | {n: _to(k) for k, names in {"string": ("TOSTRING", "STR"), "bigint": ("TOINT", "INT"), "double": ("TOREAL", "REAL", "TODOUBLE"), "boolean": ("TOBOOL", "TOBOOLEAN", "BOOL")}.items() for n in names}
