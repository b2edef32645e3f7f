"""The engine: dialect text in, DataFrames and changed tables out."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import infoschema
from .catalog import Catalog
from .dialect.parser import Parser, Statement, name_sql, string_sql, unparsable
from .dml import changes
from .dml.changes import RID
from .dml.constraints import check_parents, check_rows, check_unique, unique_keys
from .errors import ConflictError, ConstraintError, EngineError, Signal
from .functions import json as json_functions
from .functions.convert import compare
from .plans.explain import plan_rows
from .session import prepared

DEPTH = 32


@dataclass
class Result:
    """df: rows of a query or of RETURNING; affected: rows that a change touched."""

    df: DataFrame | None = None
    affected: int = 0

    def rows(self) -> list[dict]:
        return [r.asDict() for r in self.df.collect()] if self.df is not None else []

    def scalar(self):
        row = self.df.first() if self.df is not None else None
        return None if row is None else row[0]


class Engine:
    """One catalog folder and one Spark session.  Other DataFrames join in by register()."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.catalog = prepared(spark), Catalog(spark, folder)
        json_functions.register(spark)
        self.depth, self.changed, self.last_id, self.began, self.savepoints = 0, 0, None, None, {}
        self.seen: dict[str, object] = {}
        self.temps: list[str] = []
        for f in self.catalog.state["functions"].values():
            self._define(f)

    # running

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def execute(self, text: str, params: dict | list | None = None) -> Result:
        """Run every statement of a script; the last one's result is given back."""
        args = {f"p{i}": v for i, v in enumerate(params, 1)} if isinstance(params, (list, tuple)) else dict(params or {})
        session = {"CHANGES": f"{self.changed}L", "LAST_INSERT_ROWID": "cast(NULL as bigint)" if self.last_id is None else f"{self.last_id}L"}
        parser = Parser(text, set(self.catalog.state["functions"]), session)
        result = Result()
        while parser.token.kind != "end":
            parser.functions = {f.upper() for f in self.catalog.state["functions"]}
            at, positional = parser.i, parser.positional
            while True:
                s = parser.statement()
                try:
                    result = self.run(s, args)
                    break
                except Exception as e:
                    text = unparsable(e)
                    if s.kind != "query" or text is None or text in parser.as_text:
                        raise
                    parser.as_text.add(text)
                    parser.i, parser.positional = at, positional
            parser.session["CHANGES"] = f"{self.changed}L"
            if self.last_id is not None:
                parser.session["LAST_INSERT_ROWID"] = f"{self.last_id}L"
            if not parser.accept(";") and parser.token.kind != "end":
                parser.fail("unexpected input")
        return result

    def query(self, text: str, params: dict | list | None = None) -> DataFrame:
        df = self.execute(text, params).df
        if df is None:
            raise EngineError("not a query")
        return df

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def run(self, s: Statement, args: dict) -> Result:
        """One statement: it takes effect whole or not at all."""
        if self.depth >= DEPTH:
            raise EngineError(f"statements are nested more than {DEPTH} deep")
        do = getattr(self, f"_{s.kind}")
        if s.kind in ("begin", "commit", "rollback", "savepoint", "release", "isolation"):
            return do(s, args)
        if not self.depth and self.began is None:
            self.catalog.refresh()  # what other sessions have written meanwhile
        before, self.depth = self.catalog.copy(), self.depth + 1
        self.catalog.held += 1
        out = Result()
        try:
            out = do(s, args)
        except BaseException:
            self.catalog.state = before
            raise
        finally:
            self.depth -= 1
            self.catalog.held -= 1
            if not self.depth and out.df is None:  # a result with rows may still read them
                for path in self.temps:
                    self.catalog.files.delete(path)
                self.temps.clear()
        if s.kind not in ("query", "explain") or before["sequences"] != self.catalog.state["sequences"]:
            try:
                self.catalog.save()
            except ConflictError:
                raise  # the other session's state has been read
            except BaseException:
                self.catalog.state = before
                raise
        return out

    def sql(self, text: str, args: dict | None = None) -> DataFrame:
        """Spark SQL over the catalog's tables and views."""
        self._views(text)
        return self.spark.sql(self._sequences(text), args=args or None)

    def _views(self, text: str) -> None:
        """Temporary views for the tables and views that a text names, directly or through views."""
        names, todo = set(), [text]
        while todo:
            for n in {x.lower() for x in re.findall(r"`((?:[^`]|``)*)`|(information_schema_\w+)", todo.pop(), re.I) for x in x if x}:
                if n not in names:
                    names.add(n)
                    if v := self.catalog.find("views", n):
                        todo.append(v["sql"])
        if any(n.startswith("information_schema_") for n in names):
            for k, df in infoschema.frames(self.spark, self.catalog.state).items():
                df.createOrReplaceTempView(f"information_schema_{k}")
        for n in names:
            if t := self.catalog.find("tables", n):
                mark = (t["id"], t.get("next_version"), repr(t["columns"]))
                if self.seen.get(n) != mark:
                    self.catalog.read(n).createOrReplaceTempView(name_sql(n))
                    self.seen[n] = mark
        for n in [n for n in names if self.catalog.find("views", n)][::-1]:
            self._view(self.catalog.find("views", n))

    def _view(self, v: dict) -> None:
        for n in {x.lower() for x in re.findall(r"`((?:[^`]|``)*)`", v["sql"])}:
            if (inner := self.catalog.find("views", n)) and inner is not v:
                self._view(inner)
        df = self.spark.sql(v["sql"])
        (df.toDF(*v["columns"]) if v["columns"] else df).createOrReplaceTempView(name_sql(v["name"]))

    def _sequences(self, text: str) -> str:
        def value(m: re.Match) -> str:
            s = self.catalog.get("sequences", m[2])
            if m[1] == "next":
                s["current"] = s["start"] if s["current"] is None else s["current"] + 1
            elif s["current"] is None:
                raise EngineError(f"sequence {m[2]} has no value yet")
            return f"{s['current']}L"

        return re.sub(r"__(next|curr)val_(\w+?)__", value, text)

    # queries

    def _query(self, s: Statement, args: dict) -> Result:
        df = self.sql(s.sql, args)
        df._jdf.queryExecution().optimizedPlan()  # texts that do not parse show here
        return Result(df)

    def _explain(self, s: Statement, args: dict) -> Result:
        return Result(self.spark.createDataFrame(plan_rows(self.sql(s.sql, args)), "id int, parent int, detail string"))

    def compare(self, table: str, column: str, op: str, text: str) -> DataFrame:
        """Rows of a table whose column compares with a text under the dialect's rule for texts that do not parse."""
        df = self.catalog.read(table)
        return df.filter(F.expr(compare(name_sql(column), op, string_sql(text), dict(df.dtypes)[column])))

    def as_of(self, table: str, moment: float) -> DataFrame:
        """A table as it was at a time (seconds since the epoch)."""
        return self.catalog.read(table, moment)

    # transactions

    def _begin(self, s: Statement, args: dict) -> Result:
        if self.began is not None:
            raise EngineError("a transaction is open")
        self.began, self.savepoints = self.catalog.copy(), {}
        self.catalog.held += 1
        return Result()

    def _end(self) -> None:
        if self.began is None:
            raise EngineError("no transaction is open")
        self.catalog.held -= 1
        self.began, self.savepoints = None, {}

    def _commit(self, s: Statement, args: dict) -> Result:
        self._end()
        self.catalog.save()
        return Result()

    def _rollback(self, s: Statement, args: dict) -> Result:
        if s.name is None:
            before = self.began
            self._end()
            self.catalog.state = before
        else:
            self.catalog.state = self.savepoints[self._saved(s.name)]
            self.savepoints[s.name] = self.catalog.copy()
        return Result()

    def _saved(self, name: str) -> str:
        if name not in self.savepoints:
            raise EngineError(f"no savepoint named {name}")
        return name

    def _savepoint(self, s: Statement, args: dict) -> Result:
        if self.began is None:
            raise EngineError("no transaction is open")
        self.savepoints[s.name] = self.catalog.copy()
        return Result()

    def _release(self, s: Statement, args: dict) -> Result:
        del self.savepoints[self._saved(s.name)]
        return Result()

    def _isolation(self, s: Statement, args: dict) -> Result:
        if s.level not in ("READ UNCOMMITTED", "READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE", "SNAPSHOT"):
            raise EngineError(f"unknown isolation level {s.level}")
        return Result()  # every statement reads one snapshot; a single session sees no other's changes

    # definitions

    def _create_table(self, s: Statement, args: dict) -> Result:
        if self.catalog.find("tables", s.table) or self.catalog.find("views", s.table):
            if s.missing_ok:
                return Result()
            raise EngineError(f"{s.table} exists")
        names = [c["name"].lower() for c in s.columns]
        if len(set(names)) < len(names):
            raise EngineError(f"{s.table} has two columns of one name")
        for k in s.constraints:
            for c in k.get("columns") or []:
                if c.lower() not in names:
                    raise EngineError(f"{s.table} has no column {c}")
        if sum(k["kind"] == "PRIMARY KEY" for k in s.constraints) > 1:
            raise EngineError(f"{s.table} has two primary keys")
        for k in s.constraints:
            if k["kind"] == "PRIMARY KEY":
                for c in s.columns:
                    c["nullable"] = c["nullable"] and c["name"].lower() not in [x.lower() for x in k["columns"]]
        plain = ", ".join(f"cast(NULL as {c['type']}) AS {name_sql(c['name'])}" for c in s.columns if not c["computed"])
        for c in s.columns:
            if c["computed"]:  # a computed column has its expression's type
                c["type"] = self.spark.sql(f"SELECT {c['computed']} AS x FROM (SELECT {plain})").dtypes[0][1]
        self.catalog.put("tables", s.table, {"id": uuid.uuid4().hex[:12], "columns": s.columns, "constraints": s.constraints, "versions": [], "next_id": 1})
        return Result()

    def _drop(self, s: Statement, args: dict) -> Result:
        kind = {"INDEX": "indexes"}.get(s.what, f"{s.what.lower()}s")
        if not self.catalog.find(kind, s.name):
            if s.missing_ok:
                return Result()
            raise EngineError(f"no {s.what.lower()} named {s.name}")
        if kind == "tables":
            users = [t["name"] for t in self.catalog.state["tables"].values() for k in t["constraints"] if k["kind"] == "FOREIGN KEY" and k["references"]["table"].lower() == s.name.lower() and t["name"].lower() != s.name.lower()]
            if users:
                raise ConstraintError(f"{s.name} is referred to by {users[0]}")
            for other in ("indexes", "triggers"):
                for n in [n for n, x in self.catalog.state[other].items() if x["table"].lower() == s.name.lower()]:
                    self.catalog.drop(other, n)
            self.seen.pop(s.name.lower(), None)
        self.catalog.drop(kind, s.name)
        if kind in ("tables", "views"):
            self.spark.catalog.dropTempView(s.name)
        if kind == "functions":
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name_sql(s.name.lower())}")
        return Result()

    def _alter_table(self, s: Statement, args: dict) -> Result:
        t = self.catalog.get("tables", s.table)
        before = self.catalog.stored(t)
        do, cols = s.do, t["columns"]
        at = next((i for i, c in enumerate(cols) if c["name"].lower() == str(s.parts.get("name", "")).lower()), None)
        if do in ("drop_column", "rename_column", "type", "default", "nullable") and at is None:
            raise EngineError(f"{s.table} has no column {s.name}")
        if do == "add_constraint":
            t["constraints"].append(s.constraint)
            self._check(t, self.catalog.read(s.table), None)
        elif do == "drop_constraint":
            found = [k for k in t["constraints"] if infoschema.constraint_name(t, k).lower() == s.name.lower()]
            if not found:
                raise EngineError(f"no constraint named {s.name}")
            t["constraints"].remove(found[0])
        elif do == "add_column":
            c = s.column
            if any(x["name"].lower() == c["name"].lower() for x in cols):
                raise EngineError(f"{s.table} has a column {c['name']}")
            if c["computed"]:
                c["type"] = before.selectExpr(f"{c['computed']} AS x").dtypes[0][1]
            cols.append(c)
            t["constraints"] += s.constraints
            if not c["computed"] or c["stored"]:
                new = before.selectExpr("*", f"cast({c['computed'] or c['default'] or 'NULL'} as {c['type']}) AS {name_sql(c['name'])}")
                self._check(t, new, None)
                self.catalog.write(s.table, new)
        elif do == "drop_column":
            if any(c["name"].lower() == s.name.lower() for k in t["constraints"] for c in [{"name": x} for x in k.get("columns") or []]):
                raise EngineError(f"{s.name} is part of a constraint")
            cols.pop(at)
            self.catalog.write(s.table, before.drop(s.name))
        elif do == "rename_column":
            old = cols[at]["name"]
            cols[at]["name"] = s.to
            for k in t["constraints"]:
                k["columns"] = [s.to if c == old else c for c in k["columns"]] if k.get("columns") else k.get("columns")
            self.catalog.write(s.table, before.withColumnRenamed(old, s.to))
        elif do == "type":
            cols[at] |= {"type": s.type, "declared": s.declared, "params": s.params}
            self.catalog.write(s.table, before.withColumn(cols[at]["name"], F.col(name_sql(cols[at]["name"])).cast(s.type)))
        elif do == "default":
            cols[at]["default"] = s.default
        elif do == "nullable":
            cols[at]["nullable"] = s.nullable
            check_rows(t, self.catalog.read(s.table))
        elif do == "rename_table":
            self.catalog.drop("tables", s.table)
            self.catalog.put("tables", s.to, t)
            self.spark.catalog.dropTempView(s.table)
            for x in [*self.catalog.state["indexes"].values(), *self.catalog.state["triggers"].values()]:
                x["table"] = s.to if x["table"].lower() == s.table.lower() else x["table"]
        return Result()

    def _create_index(self, s: Statement, args: dict) -> Result:
        if self.catalog.find("indexes", s.name):
            if s.missing_ok:
                return Result()
            raise EngineError(f"index {s.name} exists")
        t = self.catalog.get("tables", s.table)
        self.catalog.put("indexes", s.name, {k: s.parts[k] for k in ("table", "unique", "elements", "include", "where")})
        check_unique(t, self.catalog.read(s.table), [self.catalog.find("indexes", s.name)])
        return Result()

    def _create_view(self, s: Statement, args: dict) -> Result:
        if self.catalog.find("views", s.name) or self.catalog.find("tables", s.name):
            if s.missing_ok:
                return Result()
            raise EngineError(f"{s.name} exists")
        self.sql(s.sql)  # it must resolve
        self.catalog.put("views", s.name, {"sql": s.sql, "columns": s.columns, "source": s.source})
        return Result()

    def _create_trigger(self, s: Statement, args: dict) -> Result:
        if self.catalog.find("triggers", s.name):
            if s.missing_ok:
                return Result()
            raise EngineError(f"trigger {s.name} exists")
        if not self.catalog.find("views", s.table):
            self.catalog.get("tables", s.table)
        self.catalog.put("triggers", s.name, {k: s.parts[k] for k in ("table", "time", "event", "columns", "when", "body")})
        return Result()

    def _define(self, f: dict) -> None:
        params = ", ".join(f"{name_sql(n)} {t}" for n, t in f["parameters"])
        body = re.sub(r":(\w+)", lambda m: name_sql(m[1]), f["body"])
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name_sql(f['name'].lower())}({params}) RETURNS {f['type']} RETURN cast({body} as {f['type']})")

    def _create_function(self, s: Statement, args: dict) -> Result:
        if self.catalog.find("functions", s.name):
            if s.missing_ok:
                return Result()
            raise EngineError(f"function {s.name} exists")
        self._define(s.parts)
        self.catalog.put("functions", s.name, {k: s.parts[k] for k in ("parameters", "type", "body")})
        return Result()

    def _create_procedure(self, s: Statement, args: dict) -> Result:
        if self.catalog.find("procedures", s.name):
            if s.missing_ok:
                return Result()
            raise EngineError(f"procedure {s.name} exists")
        if any(re.match(r"(?i)\s*(BEGIN|COMMIT|ROLLBACK|SAVEPOINT)\b", b) for b in s.body):
            raise EngineError("a procedure may not control transactions")
        self.catalog.put("procedures", s.name, {k: s.parts[k] for k in ("parameters", "body")})
        return Result()

    def _call(self, s: Statement, args: dict) -> Result:
        p = self.catalog.get("procedures", s.name)
        if len(p["parameters"]) != len(s.args):
            raise EngineError(f"{s.name} takes {len(p['parameters'])} arguments")
        values = [self.sql(f"SELECT cast({a} as {t})", args).first()[0] for a, (_, t) in zip(s.args, p["parameters"], strict=True)]
        given = {n: v for (n, _), v in zip(p["parameters"], values, strict=True)}
        out = Result()
        for text in p["body"]:
            out = self.execute(text, given)
        return out

    def _create_sequence(self, s: Statement, args: dict) -> Result:
        if self.catalog.find("sequences", s.name):
            if s.missing_ok:
                return Result()
            raise EngineError(f"sequence {s.name} exists")
        self.catalog.put("sequences", s.name, {"start": s.start, "current": None})
        return Result()

    def _alter_sequence(self, s: Statement, args: dict) -> Result:
        seq = self.catalog.get("sequences", s.name)
        seq["start"], seq["current"] = seq["start"] if s.start is None else s.start, None
        return Result()

    def _signal(self, s: Statement, args: dict) -> Result:
        raise Signal(s.state, None if s.message is None else str(self.sql(f"SELECT {s.message}", args).first()[0]))

    def _truncate(self, s: Statement, args: dict) -> Result:
        t = self.catalog.get("tables", s.table)
        n = self.catalog.stored(t).count()
        t["next_id"] = 1
        self.catalog.write(s.table, None)
        self.changed = n
        return Result(affected=n)

    # changes

    def _indexes(self, table: str) -> list[dict]:
        return [i for i in self.catalog.state["indexes"].values() if i["table"].lower() == table.lower()]

    def _parent(self, k: dict) -> tuple[DataFrame, list[str]]:
        r = k["references"]
        parent = self.catalog.get("tables", r["table"])
        keys = r["columns"] or next((p["columns"] for p in parent["constraints"] if p["kind"] == "PRIMARY KEY"), [])
        return self.catalog.read(r["table"]), keys

    def _check(self, t: dict, rows: DataFrame, others: DataFrame | None) -> None:
        """rows: new or changed; others: the table's rows that stay (None: rows are the whole table)."""
        check_rows(t, rows)
        check_unique(t, rows, self._indexes(t["name"]), others)
        own = t["name"].lower()
        names = [name_sql(c["name"]) for c in t["columns"]]
        whole = lambda: rows.select(names) if others is None else rows.select(names).unionByName(others.select(names))
        check_parents(t, rows, lambda k: (whole(), self._parent(k)[1]) if k["references"]["table"].lower() == own else self._parent(k))

    def _temp(self, df: DataFrame) -> DataFrame:
        """Write rows once: what follows reads the same rows whatever it does with them."""
        path = f"{self.catalog.root}/tmp-{uuid.uuid4().hex}"
        self.temps.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _computed(self, t: dict, df: DataFrame) -> DataFrame:
        """df with the table's stored computed columns filled and all columns cast and in order; other columns go."""
        out = [f"cast({name_sql(c['name'])} as {c['type']}) AS {name_sql(c['name'])}" for c in t["columns"] if not c["computed"]]
        keep = [c for c in (RID, "__ord") if c in df.columns]
        df = df.selectExpr(*out, *keep)
        for c in t["columns"]:
            if c["computed"]:
                df = df.selectExpr("*", f"{c['computed']} AS {name_sql(c['name'])}")
        return df.select([name_sql(c["name"]) for c in t["columns"]] + keep)

    def _finish(self, table: str, gone: DataFrame | None, rows: DataFrame | None, changed: DataFrame, returning: list[str] | None, alias: str | None = None) -> Result:
        """Write the change: rows that go (by RID) and rows that come; changed: the rows that RETURNING sees and that count."""
        t = self.catalog.get("tables", table)
        self.catalog.change(table, gone, rows)
        self.changed = changed.count()
        if returning is None:
            return Result(affected=self.changed)
        changed.createOrReplaceTempView("__changed")
        return Result(self.spark.sql(f"SELECT {', '.join(returning)} FROM (SELECT {', '.join(name_sql(c['name']) for c in t['columns'])} FROM __changed) AS {name_sql(alias or table)}"), self.changed)

    def _fire(self, table: str, event: str, time_: str, new: DataFrame | None, old: DataFrame | None, columns: set[str] | None = None) -> bool:
        """Run the triggers' bodies once over all changed rows; whether there was one."""
        found = [g for g in self.catalog.state["triggers"].values() if g["table"].lower() == table.lower() and g["event"] == event and g["time"] == time_]
        found = [g for g in found if not g["columns"] or columns is None or {c.lower() for c in g["columns"]} & columns]
        for g in found:
            pack = lambda df, name: df.select(RID, F.struct(*[c for c in df.columns if c not in (RID, "__ord")]).alias(name))
            rows = pack(new, "NEW") if old is None else pack(old, "OLD") if new is None else pack(new, "NEW").join(pack(old, "OLD"), RID)
            rows = rows.filter(F.expr(g["when"])) if g["when"] else rows
            rows = self._temp(rows)
            if not rows.limit(1).count():
                continue
            for text in g["body"]:
                rows.createOrReplaceTempView("__trigger")
                s = Parser(text, set(self.catalog.state["functions"])).statement()
                if s.kind == "insert" and s.rows is not None:
                    s.parts |= {"query": " UNION ALL ".join(f"SELECT {', '.join(r)} FROM `__trigger`" for r in s.rows), "rows": None}
                elif s.kind in ("update", "delete"):
                    s.parts["sources"] = [*s.sources, "`__trigger`"]
                elif s.kind == "signal":
                    s.parts["message"] = f"(SELECT first({s.message}) FROM `__trigger`)" if s.message else None
                self.run(s, {})
        return bool(found)

    def _new_rows(self, s: Statement, t: dict, args: dict) -> DataFrame:
        """The rows that an INSERT proposes, with defaults and automatic numbers, in order of __ord."""
        plain = [c for c in t["columns"] if not c["computed"]]
        by_name = {c["name"].lower(): c for c in t["columns"]}
        given = [c.lower() for c in s.columns or [c["name"] for c in plain]]
        for c in given:
            if c not in by_name:
                raise EngineError(f"{t['name']} has no column {c}")
            if by_name[c]["computed"]:
                raise EngineError(f"{t['name']}.{c} is computed")
        auto = next((c for c in plain if c["autoincrement"]), None)
        default = lambda c: c["default"] if c["default"] is not None else "NULL"
        if s.rows is not None:
            lines = []
            for n, row in enumerate(s.rows):
                if row and len(row) != len(given):
                    raise EngineError(f"{len(given)} columns but {len(row)} values")
                values = dict(zip(given, row, strict=False))
                cells = []
                for c in plain:
                    v = values.get(c["name"].lower(), "DEFAULT")
                    v = default(c) if v == "DEFAULT" else v
                    cells.append(f"cast({self._sequences(v)} as {c['type']}) AS {name_sql(c['name'])}")
                lines.append(f"SELECT {', '.join(cells)}, {n}L AS __ord")
            df = self.sql(" UNION ALL ".join(lines), args)
        else:
            q = self.sql(s.query, args)
            if len(q.columns) != len(given):
                raise EngineError(f"{len(given)} columns but {len(q.columns)} values")
            q = self._temp(q.toDF(*given).withColumn("__ord", F.monotonically_increasing_id()))
            df = q.selectExpr(*[f"cast({name_sql(c['name']) if c['name'].lower() in given else default(c)} as {c['type']}) AS {name_sql(c['name'])}" for c in plain], "__ord")
        if auto:
            df = self._temp(df)
            a = name_sql(auto["name"])
            most = df.agg(F.max(a)).first()[0]
            start = max(t["next_id"], (most or 0) + 1)
            missing = df.filter(F.col(a).isNull()).withColumn("__part", F.shiftright("__ord", 33).cast("int"))
            sizes = {r["__part"]: r["count"] for r in missing.groupBy("__part").count().collect()}
            if sizes:
                # numbers go on from part to part in the order of the rows, so no single task numbers all of them
                before, at = [], 0
                for part in range(max(sizes) + 1):
                    before.append(at)
                    at += sizes.get(part, 0)
                place = F.row_number().over(Window.partitionBy("__part").orderBy("__ord")) - 1
                offset = F.get(F.expr("array(" + ",".join(f"{n}L" for n in before) + ")"), F.col("__part"))
                filled = missing.withColumn(auto["name"], (place + offset + start).cast(auto["type"])).drop("__part")
                df = self._temp(df.filter(F.col(a).isNotNull()).unionByName(filled))
                start += at
            t["next_id"] = start
            top = df.agg(F.max(a)).first()[0]
            self.last_id = top if top is not None else self.last_id
        for c in t["columns"]:
            if c["declared"] == "ROWVERSION":
                df = df.withColumn(c["name"], F.coalesce(name_sql(c["name"]), F.lit(1).cast("long")))
        return self._computed(t, df)

    def _insert(self, s: Statement, args: dict) -> Result:
        if (v := self.catalog.find("views", s.table)) is not None:
            return self._insert_view(s, v, args)
        t = self.catalog.get("tables", s.table)
        rows = self._temp(self._new_rows(s, t, args))
        if self._has(s.table, "INSERT"):
            new = rows.withColumn(RID, F.col("__ord"))
            self._fire(s.table, "INSERT", "BEFORE", new, None)
        target = self.catalog.read(s.table, numbered=True)
        keys, plain = unique_keys(t, self._indexes(s.table)), [name_sql(c["name"]) for c in t["columns"]]
        added, updated, gone = rows, None, None
        if s.resolve == "IGNORE" or s.conflict and s.conflict["sets"] is None:
            added = changes.insert_or_ignore(target, rows, [s.conflict["on"]] if s.conflict and s.conflict["on"] else keys, "__ord")
        elif s.resolve == "REPLACE":
            gone, added = changes.insert_or_replace(target, rows, keys, "__ord")
            gone = self._temp(gone)
            if t["constraints"]:
                for k in keys[:1]:
                    lost = target.join(rows.select([name_sql(c) for c in k]), k, "left_semi").join(rows, k, "left_anti")
                    self._cascade(s.table, lost)
        elif s.conflict:
            on = s.conflict["on"] or (keys[0] if keys else [])
            if not on:
                raise EngineError("ON CONFLICT needs a key")
            if rows.dropna(subset=on).groupBy(*map(name_sql, on)).count().filter("count > 1").limit(1).count():
                raise ConstraintError("two rows of one INSERT conflict with each other")
            updated, added = changes.upsert(target, rows, on, {self._column(t, c): e for c, e in s.conflict["sets"]}, s.conflict["where"], s.table)
            updated = self._temp(self._computed(t, updated))
            gone = updated.select(RID)
        touched = added.select(plain) if updated is None else added.select(plain).unionByName(updated.select(plain))
        touched = self._temp(touched)
        self._check(t, touched, target if gone is None else target.join(gone, RID, "left_anti"))
        out = self._finish(s.table, gone, touched, touched, s.returning)
        if self._has(s.table, "INSERT"):
            self._fire(s.table, "INSERT", "AFTER", changes.numbered(touched), None)
            self.changed = out.affected
        return out

    def _insert_view(self, s: Statement, v: dict, args: dict) -> Result:
        self._views(name_sql(s.table))
        names = s.columns or self.spark.table(name_sql(s.table)).columns
        q = s.query or " UNION ALL ".join(f"SELECT {', '.join(r)}" for r in s.rows)
        new = self._temp(changes.numbered(self.sql(q, args).toDF(*names)))
        if not self._fire(s.table, "INSERT", "INSTEAD OF", new, None):
            raise EngineError(f"{s.table} is a view")
        return Result(affected=new.count())

    def _has(self, table: str, event: str) -> bool:
        return any(g["table"].lower() == table.lower() and g["event"] == event for g in self.catalog.state["triggers"].values())

    @staticmethod
    def _column(t: dict, name: str) -> str:
        for c in t["columns"]:
            if c["name"].lower() == name.lower():
                if c["computed"]:
                    raise EngineError(f"{t['name']}.{name} is computed")
                return c["name"]
        raise EngineError(f"{t['name']} has no column {name}")

    def _target(self, t: dict) -> DataFrame:
        """The table's rows with their place in its files."""
        df = self.catalog.read(t["name"], numbered=True)
        df.createOrReplaceTempView("__target")
        return df

    def _default(self, t: dict, name: str) -> str:
        return next(c["default"] or "NULL" for c in t["columns"] if c["name"] == name)

    def _update(self, s: Statement, args: dict) -> Result:
        if self.catalog.find("views", s.table):
            return self._change_view(s, "UPDATE", args)
        t = self.catalog.get("tables", s.table)
        target = self._target(t)
        sets = {self._column(t, c): self._default(t, self._column(t, c)) if e == "DEFAULT" else e for c, e in s.sets}
        for c in t["columns"]:
            if c["declared"] == "ROWVERSION":
                sets[c["name"]] = f"{name_sql(s.alias)}.{name_sql(c['name'])} + 1"
        alias = name_sql(s.alias)
        cells = [f"{sets[c['name']]} AS {name_sql(c['name'])}" if c["name"] in sets else f"{alias}.{name_sql(c['name'])}" for c in t["columns"] if not c["computed"]]
        source = ", ".join([f"__target AS {alias}", *s.sources])
        new = self.sql(f"SELECT {', '.join(cells)}, {alias}.{RID} FROM {source}" + (f" WHERE {s.where}" if s.where else ""), args)
        if s.sources:  # several matches: the first in the order of the new values counts
            new = new.groupBy(RID).agg(F.min(F.struct(*[c for c in new.columns if c != RID])).alias("r")).select("r.*", RID)
        new = self._temp(self._computed(t, new))
        return self._apply(t, target, new, s.returning, s.alias, {c.lower() for c in sets})

    def _apply(self, t: dict, target: DataFrame, new: DataFrame, returning: list[str] | None, alias: str, columns: set[str]) -> Result:
        old = None
        if self._has(t["name"], "UPDATE"):
            old = self._temp(target.join(new.select(RID), RID, "left_semi"))
            self._fire(t["name"], "UPDATE", "BEFORE", new, old, columns)
        self._check(t, new, target.join(new, RID, "left_anti"))
        self._cascade_update(t, target, new, columns)
        out = self._finish(t["name"], new.select(RID), new, new, returning, alias)
        if old is not None:
            self._fire(t["name"], "UPDATE", "AFTER", new, old, columns)
            self.changed = out.affected
        return out

    def _change_view(self, s: Statement, event: str, args: dict) -> Result:
        self._views(name_sql(s.table))
        old = changes.numbered(self.spark.table(name_sql(s.table)))
        old.createOrReplaceTempView("__target")
        alias, where = name_sql(s.alias), f" WHERE {s.where}" if s.where else ""
        sets = {c.lower(): e for c, e in s.parts.get("sets", [])}
        cells = [f"{sets[c.lower()]} AS {name_sql(c)}" if c.lower() in sets else f"{alias}.{name_sql(c)}" for c in old.columns]
        hit = self._temp(self.sql(f"SELECT {alias}.* FROM __target AS {alias}{where}", args))
        new = self._temp(self.sql(f"SELECT {', '.join(cells)} FROM __target AS {alias}{where}", args)) if event == "UPDATE" else None
        if not self._fire(s.table, event, "INSTEAD OF", new, hit, set(sets) or None):
            raise EngineError(f"{s.table} is a view")
        return Result(affected=hit.count())

    def _delete(self, s: Statement, args: dict) -> Result:
        if self.catalog.find("views", s.table):
            return self._change_view(s, "DELETE", args)
        t = self.catalog.get("tables", s.table)
        target, alias = self._target(t), name_sql(s.alias)
        source = ", ".join([f"__target AS {alias}", *s.sources])
        hit = self.sql(f"SELECT DISTINCT {alias}.{RID} FROM {source}" + (f" WHERE {s.where}" if s.where else ""), args)
        gone = self._temp(target.join(hit, RID, "left_semi"))
        return self._remove(t, target, gone, s.returning, s.alias)

    def _remove(self, t: dict, target: DataFrame, gone: DataFrame, returning: list[str] | None = None, alias: str | None = None) -> Result:
        fires = self._has(t["name"], "DELETE")
        if fires:
            self._fire(t["name"], "DELETE", "BEFORE", None, gone)
        out = self._finish(t["name"], gone.select(RID), None, gone, returning, alias)
        if t["constraints"]:
            self._cascade(t["name"], gone)
        if fires:
            self._fire(t["name"], "DELETE", "AFTER", None, gone)
        self.changed = out.affected
        return out

    def _children(self, table: str) -> list[tuple[dict, dict, list[str]]]:
        """(child table, foreign key, parent columns) of the keys that refer to a table."""
        out = []
        for t in self.catalog.state["tables"].values():
            for k in t["constraints"]:
                if k["kind"] == "FOREIGN KEY" and k["references"]["table"].lower() == table.lower():
                    out.append((t, k, self._parent(k)[1]))
        return out

    def _cascade(self, table: str, gone: DataFrame) -> None:
        """What deleted rows do to the rows that refer to them; self-references go on until nothing is left."""
        for child, k, keys in self._children(table):
            target = self._target(child)
            lost = gone.select([F.col(name_sql(p)).alias(c) for p, c in zip(keys, k["columns"], strict=True)]).distinct()
            hit = target.join(lost, k["columns"], "left_semi")
            if not hit.limit(1).count():
                continue
            do = k["references"]["on_delete"]
            if do in ("NO ACTION", "RESTRICT"):
                raise ConstraintError(f"{child['name']} refers to deleted rows of {table}")
            self.depth += 1
            if self.depth > 1000:
                raise EngineError("cascades are nested too deep")
            hit = self._temp(hit)
            if do == "CASCADE":
                self._remove(child, target, hit)
            else:
                value = lambda c, d=do, t=child: "NULL" if d == "SET NULL" else self._default(t, c)
                cells = [f"{value(c)} AS {name_sql(c)}" if c in k["columns"] else name_sql(c) for c in hit.columns if c != RID]
                self._apply(child, target, self._temp(self._computed(child, hit.selectExpr(*cells, RID))), None, child["name"], {c.lower() for c in k["columns"]})
            self.depth -= 1

    def _cascade_update(self, t: dict, target: DataFrame, new: DataFrame, columns: set[str]) -> None:
        """What changed keys do to the rows that refer to them."""
        for child, k, keys in self._children(t["name"]):
            if not {c.lower() for c in keys} & columns:
                continue
            old = target.select(RID, *[F.col(name_sql(p)).alias(f"__old{i}") for i, p in enumerate(keys)])
            pairs = old.join(new.select(RID, *[F.col(name_sql(p)).alias(f"__new{i}") for i, p in enumerate(keys)]), RID).drop(RID)
            differ = F.lit(False)
            for i in range(len(keys)):
                differ |= ~F.col(f"__old{i}").eqNullSafe(F.col(f"__new{i}"))
            pairs = self._temp(pairs.filter(differ))
            rows = self._target(child)
            on = F.lit(True)
            for i, c in enumerate(k["columns"]):
                on &= F.col(name_sql(c)) == F.col(f"__old{i}")
            hit = rows.join(pairs, on)
            if not hit.limit(1).count():
                continue
            do = k["references"]["on_update"]
            if do in ("NO ACTION", "RESTRICT"):
                raise ConstraintError(f"{child['name']} refers to changed keys of {t['name']}")
            value = lambda i, c, d=do, x=child: f"__new{i}" if d == "CASCADE" else "NULL" if d == "SET NULL" else self._default(x, c)
            cells = [f"{value(k['columns'].index(c), c)} AS {name_sql(c)}" if c in k["columns"] else name_sql(c) for c in rows.columns if c != RID]
            made = self._temp(self._computed(child, hit.selectExpr(*cells, RID)))
            self.catalog.change(child["name"], made.select(RID), made)

    def _merge(self, s: Statement, args: dict) -> Result:
        t = self.catalog.get("tables", s.table)
        target, alias, other = self._target(t), name_sql(s.alias), name_sql(s.source_alias)
        source = self.sql(f"SELECT * FROM {s.query or name_sql(s.source_table)} AS {other}", args)
        source = self._temp(source.withColumn("__sid", F.monotonically_increasing_id()))
        source.createOrReplaceTempView("__source")
        both = f"__target AS {alias} JOIN __source AS {other} ON {s.on}"
        pk = next((k["columns"] for k in t["constraints"] if k["kind"] == "PRIMARY KEY"), [])
        key = [f"{alias}.{name_sql(c)} AS __k{i}" for i, c in enumerate(pk)]
        pairs = self.sql(f"SELECT {', '.join([f'{alias}.{RID}', f'{other}.__sid', *key])} FROM {both}", args)
        pairs = self._temp(pairs)
        one = self._temp(changes.merge_actions(pairs, "__sid", [*[f"__k{i}" for i in range(len(pk))], RID]).select(RID, "__sid"))
        one.createOrReplaceTempView("__pairs")
        matched = [c for c in s.clauses if c["matched"]]
        which = "CASE" + "".join(f" WHEN {c['when'] or 'true'} THEN {i}" for i, c in enumerate(matched)) + " ELSE -1 END" if matched else "-1"
        plain = [c for c in t["columns"] if not c["computed"]]
        joined = f"__pairs AS __p JOIN __target AS {alias} ON __p.{RID} = {alias}.{RID} JOIN __source AS {other} ON __p.__sid = {other}.__sid"
        cells = []
        for c in plain:
            arms = "".join(f" WHEN {i} THEN {dict((self._column(t, n), e) for n, e in m['sets'])[c['name']]}" for i, m in enumerate(matched) if m["do"] == "update" and c["name"] in [self._column(t, n) for n, _ in m["sets"]])
            cells.append(f"cast(CASE {which}{arms} ELSE {alias}.{name_sql(c['name'])} END as {c['type']}) AS {name_sql(c['name'])}" if arms else f"{alias}.{name_sql(c['name'])}")
        made = self._temp(self.sql(f"SELECT {', '.join(cells)}, {alias}.{RID}, {which} AS __do FROM {joined}", args).filter("__do >= 0"))
        deletes = [i for i, m in enumerate(matched) if m["do"] == "delete"]
        gone = made.filter(F.col("__do").isin(deletes)) if deletes else made.limit(0)
        updated = self._computed(t, made.filter(~F.col("__do").isin(deletes)) if deletes else made)
        inserts = [c for c in s.clauses if not c["matched"]]
        added, used = None, []
        for c in inserts:
            columns = c["columns"] or [x["name"] for x in plain]
            skip = "".join(f" AND NOT coalesce({u}, false)" for u in used)
            q = f"SELECT {', '.join(c['values'])} FROM __source AS {other} LEFT ANTI JOIN (SELECT DISTINCT __sid FROM __matches) AS __m ON {other}.__sid = __m.__sid WHERE {c['when'] or 'true'}{skip}"
            pairs.createOrReplaceTempView("__matches")
            rows = self._new_rows(Statement("insert", {"rows": None, "query": q, "columns": columns}), t, args)
            added = rows if added is None else added.unionByName(rows)
            used.append(c["when"] or "true")
        names = [name_sql(c["name"]) for c in t["columns"]]
        touched = updated.select(names) if added is None else updated.select(names).unionByName(added.select(names))
        touched = self._temp(touched)
        n_gone = gone.count()
        self._check(t, touched, target.join(made.select(RID), RID, "left_anti"))
        out = self._finish(s.table, made.select(RID), touched, touched, None)
        if n_gone:
            self._cascade(s.table, self._temp(target.join(gone.select(RID), RID, "left_semi")))
        if self._has(s.table, "INSERT") and added is not None:
            self._fire(s.table, "INSERT", "AFTER", self._temp(changes.numbered(added.select(names))), None)
        if self._has(s.table, "UPDATE"):
            self._fire(s.table, "UPDATE", "AFTER", updated, self._temp(target.join(updated.select(RID), RID, "left_semi")))
        if self._has(s.table, "DELETE") and n_gone:
            self._fire(s.table, "DELETE", "AFTER", None, self._temp(target.join(gone.select(RID), RID, "left_semi")))
        self.changed = out.affected + n_gone
        return Result(affected=self.changed)

    # bulk

    def bulk_insert(self, table: str, rows: DataFrame | Iterable) -> int:
        """Rows (a DataFrame, dictionaries, objects or tuples in column order) in one snapshot."""
        t = self.catalog.get("tables", table)
        plain = [c for c in t["columns"] if not c["computed"]]
        if not isinstance(rows, DataFrame):
            rows = [r if isinstance(r, (dict, tuple, list)) else vars(r) for r in rows]
            names = list(dict.fromkeys(k for r in rows for k in r)) if rows and isinstance(rows[0], dict) else [c["name"] for c in plain]
            kinds = {c["name"].lower(): c["type"] for c in plain}
            rows = [tuple(r.get(n) for n in names) if isinstance(r, dict) else tuple(r) for r in rows]
            rows = self.spark.createDataFrame(rows, ", ".join(f"`{n}` {kinds[n.lower()]}" for n in names))
        rows.createOrReplaceTempView("__bulk")
        names = [c for c in rows.columns]
        return self.run(Statement("insert", {"table": table, "columns": names, "rows": None, "query": "SELECT * FROM `__bulk`", "resolve": None, "conflict": None, "returning": None}), {}).affected

    def bulk_update(self, table: str, sets: dict[str, str], where: str | None = None, params: dict | None = None) -> int:
        return self.execute(f"UPDATE {table} SET {', '.join(f'{c} = {e}' for c, e in sets.items())}" + (f" WHERE {where}" if where else ""), params).affected

    def bulk_delete(self, table: str, where: str | None = None, params: dict | None = None) -> int:
        return self.execute(f"DELETE FROM {table}" + (f" WHERE {where}" if where else ""), params).affected

    def vacuum(self) -> None:
        """Delete what statements wrote in between and snapshots that no table lists; results not yet read must not be needed any more."""
        files, root = self.catalog.files, self.catalog.root
        live = {p["path"] for t in self.catalog.state["tables"].values() for v in t["versions"] for p in v["parts"]}
        for name in files.names(root):
            if name.startswith("tmp-"):
                files.delete(f"{root}/{name}")
            elif name != "catalog":
                for part in files.names(f"{root}/{name}"):
                    if f"{root}/{name}/{part}" not in live:
                        files.delete(f"{root}/{name}/{part}")

    def dump(self, folder: str) -> list[str]:
        """Definitions and INSERT statements of all tables, parents before children; gives the tables in that order."""
        from .sources.files import export_sql

        tables, order = dict(self.catalog.state["tables"]), []
        while tables:
            free = [n for n, t in tables.items() if all(k["kind"] != "FOREIGN KEY" or k["references"]["table"].lower() in (n, *order) for k in t["constraints"])] or list(tables)[:1]
            order += free
            for n in free:
                tables.pop(n)
        for k, n in enumerate(order):
            t = self.catalog.get("tables", n)
            export_sql(self.catalog.read(n).select([name_sql(c["name"]) for c in t["columns"] if not c["computed"]]), t["name"], f"{folder}/{k:03d}-{n}")
        return order


class Prepared:
    """A statement parsed once and run with many parameters."""

    def __init__(self, engine: Engine, text: str):
        self.engine, self.text = engine, text
        Parser(text, set(engine.catalog.state["functions"])).script()

    def execute(self, params: dict | list | None = None) -> Result:
        return self.engine.execute(self.text, params)

    def execute_batch(self, params: Iterable[dict | list]) -> int:
        """All parameter sets as one statement where it is an INSERT of one row of parameters, else one by one in a transaction."""
        sets = list(params)
        s = Parser(self.text).statement()
        if s.kind == "insert" and s.rows is not None and len(s.rows) == 1 and not s.returning and sets:
            args, rows = {}, []
            for i, p in enumerate(sets):
                named = {f"p{k}": v for k, v in enumerate(p, 1)} if isinstance(p, (list, tuple)) else p
                args |= {f"{k}_{i}": v for k, v in named.items()}
                rows.append([re.sub(r":(\w+)", rf":\1_{i}", v) for v in s.rows[0]])
            s.parts["rows"] = rows
            return self.engine.run(s, args).affected
        own = self.engine.began is None
        if own:
            self.engine.execute("BEGIN")
        try:
            n = sum(self.engine.execute(self.text, p).affected for p in sets)
        except BaseException:
            if own:
                self.engine.execute("ROLLBACK")
            raise
        if own:
            self.engine.execute("COMMIT")
        return n
