"""JSON functions over JSON text.  Reading stays in Catalyst; writing by path has no built-in and runs as Arrow UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(p: str) -> str:
    if p.startswith("'"):
        body = p[1:-1]
        return p if body.startswith("$") else f"'${'' if body.startswith('[') else '.'}{body}'"
    return f"if(startswith({p}, '$'), {p}, concat('$.', {p}))"


def extract(j: str, p: str = "'$'") -> str:
    return f"get_json_object({j}, {_path(p)})"


def _raw(j: str, p: str) -> str:
    """The value at a path as a variant; text that is no JSON gives NULL."""
    return f"try_variant_get(try_parse_json({j}), {_path(p)}, 'variant')"


def kind(j: str, p: str = "'$'") -> str:
    s = f"schema_of_variant({_raw(j, p)})"
    return f"CASE WHEN {s} = 'VOID' THEN 'null' WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} = 'STRING' THEN 'string' WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} LIKE 'OBJECT%' THEN 'object' WHEN {s} IS NOT NULL THEN 'number' END"


def value(j: str, p: str = "'$'") -> str:
    return f"CASE WHEN {kind(j, p)} IN ('array', 'object') THEN NULL ELSE {extract(j, p)} END"


def query(j: str, p: str = "'$'") -> str:
    return f"CASE WHEN {kind(j, p)} IN ('array', 'object') THEN {extract(j, p)} END"


def _encoded(x: str) -> str:
    return f"coalesce(regexp_replace(to_json(array({x})), r'^\\[|\\]$', ''), 'null')"


def array(*values: str) -> str:
    inner = ", ',', ".join(map(_encoded, values))
    return f"concat('[', {inner}, ']')" if values else "'[]'"


def object_(*pairs: str) -> str:
    items = [f"{_encoded(f'cast({k} as string)')}, ':', {_encoded(v)}" for k, v in zip(pairs[::2], pairs[1::2], strict=True)]
    inner = ", ',', ".join(items)
    return f"concat('{{', {inner}, '}}')" if pairs else "'{}'"


def _steps(path: str) -> list[str]:
    if not re.fullmatch(r"\$?\.?\w+(\.\w+)*|\$", path):
        raise ValueError(f"JSON writes take property paths only: {path}")
    return [s for s in path.removeprefix("$").split(".") if s]


def change(text: str | None, path: str | None, new, mode: str):
    """The document with the value at path set, inserted (only new), replaced (only existing) or removed; names match in any case."""
    if text is None or path is None:
        return None
    try:
        root = json.loads(text)
    except ValueError:
        return None
    steps = _steps(path)
    if not steps:
        return text if mode in ("insert", "remove") else json.dumps(new, ensure_ascii=False, separators=(",", ":"))
    at = root
    for i, step in enumerate(steps):
        if not isinstance(at, dict):
            return json.dumps(root, ensure_ascii=False, separators=(",", ":"))
        name = next((k for k in at if k.lower() == step.lower()), None)
        if i == len(steps) - 1:
            if mode == "remove":
                if name is not None:
                    del at[name]
            elif mode == "set" or (mode == "insert") == (name is None):
                at[name or step] = new
        elif name is None:
            if mode in ("remove", "replace"):
                break
            at[step] = {}
            at = at[step]
        else:
            at = at[name]
    return json.dumps(root, ensure_ascii=False, separators=(",", ":"))


def _writer(mode: str):
    def run(doc: pd.Series, path: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([change(d, p, None if v is None else json.loads(v), mode) for d, p, v in zip(doc, path, new, strict=True)], dtype=object)

    return run


def register(spark: SparkSession) -> None:
    """The Arrow UDFs behind JSON_SET, JSON_INSERT, JSON_REPLACE and JSON_REMOVE."""
    for mode in ("set", "insert", "replace", "remove"):
        spark.udf.register(f"tarnwick_json_{mode}", F.pandas_udf(_writer(mode), T.StringType()))


def _write(mode: str):
    def render(j: str, *pairs: str) -> str:
        out = f"cast({j} as string)"
        for p, v in zip(pairs[::2], pairs[1::2], strict=True):
            out = f"tarnwick_json_{mode}({out}, {p}, {_encoded(v)})"
        return out

    return render


def remove(j: str, *paths: str) -> str:
    out = f"cast({j} as string)"
    for p in paths:
        out = f"tarnwick_json_remove({out}, {p}, 'null')"
    return out


RENDER = {
    "JSON_EXTRACT": extract,
    "JSON_VALUE": value,
    "JSON_QUERY": query,
    "JSON_TYPE": kind,
    "JSON_ARRAY_LENGTH": lambda j, p="'$'": f"json_array_length({extract(j, p)})",
    "JSON_VALID": lambda j: f"(try_parse_json({j}) IS NOT NULL)",
    "JSON_SET": _write("set"),
    "JSON_INSERT": _write("insert"),
    "JSON_REPLACE": _write("replace"),
    "JSON_REMOVE": remove,
    "JSON_ARRAY": array,
    "JSON_OBJECT": object_,
}
