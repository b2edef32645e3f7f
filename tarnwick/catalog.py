"""Tables as versioned lists of Parquet parts, with their definitions and all other catalog objects in one JSON file.

A statement writes new parts and then a new catalog file, whose number must be free: it takes effect whole or
not at all, readers keep the version they began with, and of two sessions that write from the same catalog the
second is refused.  An INSERT adds a part; rows that change or go cost the rewriting of the files that hold
them, no others.  So many parts of one level as FAN are merged into one of the next, so a row is rewritten a
few times however many statements add rows.
"""

from __future__ import annotations

import copy
import json
import re
import time
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dml.changes import RID
from .errors import ConflictError, EngineError
from .sources.storage import Storage

KINDS = ("tables", "views", "indexes", "triggers", "functions", "procedures", "sequences")
#: Parts of a level that are merged; versions of a table and catalog files that are kept.
FAN, VERSIONS, CATALOGS = 16, 50, 20
_NAME = re.compile(r"(\d{12})\.json")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Storage(spark)
        self.folder, self.number = f"{self.root}/catalog", 0
        self.state: dict = {k: {} for k in KINDS}
        self.held = 0  # over 0 inside a transaction or a statement: changes stay in memory
        self.refresh()
        if not self.number and self.files.names(self.root):
            raise EngineError(f"{self.root} holds files but no catalog")

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def refresh(self) -> None:
        """Read the newest catalog file if it is newer than what is known."""
        newest = max((int(m[1]) for n in self.files.names(self.folder) if (m := _NAME.fullmatch(n))), default=0)
        if newest > self.number:
            self.state, self.number = json.loads(self.files.read(self._path(newest))), newest

    def save(self) -> None:
        if self.held:
            return
        if not self.files.write_new(self._path(self.number + 1), json.dumps(self.state)):
            self.refresh()
            raise ConflictError("another session has changed the catalog; run the statement again")
        self.number += 1
        if self.number > CATALOGS:
            self.files.delete(self._path(self.number - CATALOGS))

    def copy(self) -> dict:
        return copy.deepcopy(self.state)

    def find(self, kind: str, name: str) -> dict | None:
        return self.state[kind].get(name.lower())

    def get(self, kind: str, name: str) -> dict:
        found = self.find(kind, name)
        if found is None:
            raise EngineError(f"no {kind[:-1]} named {name}")
        return found

    def put(self, kind: str, name: str, what: dict) -> None:
        self.state[kind][name.lower()] = what | {"name": name}
        self.save()

    def drop(self, kind: str, name: str) -> None:
        del self.state[kind][name.lower()]
        self.save()

    # tables

    def schema(self, table: dict) -> str:
        cols = [f"`{c['name']}` {c['type']}" for c in table["columns"] if not c["computed"] or c["stored"]]
        return ", ".join(cols)

    def _open(self, table: dict, paths: list[str], numbered: bool) -> DataFrame:
        """Rows of files or folders; numbered: with their file and their place in it as RID."""
        if not paths:
            return self.spark.createDataFrame([], self.schema(table) + (f", {RID} struct<file:string,i:bigint>" if numbered else ""))
        df = self.spark.read.schema(self.schema(table)).parquet(*paths)
        return df.withColumn(RID, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"))) if numbered else df

    @staticmethod
    def _paths(parts: list[dict]) -> list[str]:
        return [x for p in parts for x in ([p["path"]] if p["files"] is None else [f"{p['path']}/{n}" for n in p["files"]])]

    def parts(self, table: dict, as_of: float | None = None) -> list[dict]:
        versions = [v for v in table["versions"] if as_of is None or v["time"] <= as_of]
        return versions[-1]["parts"] if versions else []

    def stored(self, table: dict, as_of: float | None = None, numbered: bool = False) -> DataFrame:
        """The stored columns of the current version, or of the newest one at or before a time (seconds)."""
        return self._open(table, self._paths(self.parts(table, as_of)), numbered)

    def read(self, name: str, as_of: float | None = None, numbered: bool = False) -> DataFrame:
        """A table with its computed columns."""
        table = self.get("tables", name)
        df = self.stored(table, as_of, numbered)
        for c in table["columns"]:
            if c["computed"] and not c["stored"]:
                df = df.selectExpr("*", f"{c['computed']} AS `{c['name']}`")
        return df.select([f"`{c['name']}`" for c in table["columns"]] + [RID] * numbered)

    def _part(self, table: dict, df: DataFrame, level: int) -> dict:
        number = table["next_part"] = table.get("next_part", 0) + 1
        path = f"{self.root}/{table['id']}/p{number}-{time.time_ns()}"
        cols = [f"`{c['name']}`" for c in table["columns"] if not c["computed"] or c["stored"]]
        df.select(cols).write.parquet(path)
        return {"path": path, "level": level, "files": None}

    def _version(self, table: dict, parts: list[dict]) -> None:
        while len(parts) >= FAN and len({p["level"] for p in parts[-FAN:]}) == 1:
            last = parts[-FAN:]
            parts = [*parts[:-FAN], self._part(table, self._open(table, self._paths(last), False), last[0]["level"] + 1)]
        number = table["next_version"] = table.get("next_version", 0) + 1
        table["versions"] = [*table["versions"], {"number": number, "time": time.time(), "parts": parts}][-VERSIONS:]
        self.save()

    def write(self, name: str, df: DataFrame | None) -> None:
        """The whole table anew; None for an empty one."""
        table = self.get("tables", name)
        self._version(table, [] if df is None else [self._part(table, df, 0)])

    def change(self, name: str, gone: DataFrame | None, rows: DataFrame | None) -> None:
        """Rows (by RID) go and rows come; the files that hold rows that go are written anew without them."""
        table = self.get("tables", name)
        parts = copy.deepcopy(self.parts(table))
        touched = [r.file for r in gone.select(f"{RID}.file").distinct().collect()] if gone is not None else []
        if touched:
            paths = [unquote(f) for f in touched]
            rest = self._open(table, paths, True).join(gone.select(RID), RID, "left_anti").drop(RID)
            rows = rest if rows is None else rest.unionByName(rows.select(rest.columns))
            lost: dict[str, set[str]] = {}
            for f in paths:
                folder, name_ = f.rsplit("/", 2)[1:]
                lost.setdefault(folder, set()).add(name_)
            for p in parts:
                if names := lost.get(p["path"].rsplit("/", 1)[1]):
                    have = p["files"] if p["files"] is not None else [n for n in self.files.names(p["path"]) if n.startswith("part-")]
                    p["files"] = [n for n in have if n not in names]
            parts = [p for p in parts if p["files"] is None or p["files"]]
        if rows is not None:
            parts.append(self._part(table, rows, 0))
        self._version(table, parts)
