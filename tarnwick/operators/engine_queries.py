"""Statements run by the engine over the star schema's tables, whole, and what a SELECT of the resulting state gives.

Each entry makes a catalog of its own in the shared folder; the given tables are views of the session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import ConstraintError, EngineError, ParseError, Signal
from ..sources import files
from ..sources.files import parquet
from ..sources.kv import KeyValue
from ..sources.scratch import new_folder

#: Two thirds of the customers are there at first, two thirds come; a third of them is new.
LOW, HIGH = "(SELECT MAX(c_custkey) / 3 FROM customer)", "(SELECT MAX(c_custkey) * 2 / 3 FROM customer)"
ACC = f"CREATE TABLE acc (k BIGINT PRIMARY KEY, name VARCHAR(60) NOT NULL, nation INT, bal DOUBLE); INSERT INTO acc SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey <= {HIGH};"
NEW = f"SELECT c_custkey, UPPER(c_name), 7, 1.5 FROM customer WHERE c_custkey > {LOW}"
STATE = "SELECT k, name, nation, bal FROM acc"
_OLD = f"SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, c_acctbal AS bal FROM customer WHERE c_custkey <= {HIGH}"
_COME = "c_custkey AS k, upper(c_name) AS name, 7 AS nation, 1.5 AS bal FROM customer WHERE"
_WHOLE = "SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, c_acctbal AS bal FROM customer"
LOADED = "CREATE TABLE acc (k BIGINT PRIMARY KEY, name VARCHAR(60) NOT NULL, nation INT, bal DOUBLE); INSERT INTO acc SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer;"


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    db = Engine(spark, new_folder(spark, "engine"))
    for t in tables:
        db.register(t, parquet(spark, sf_dir, t))
    return db


def script(text: str, query: str, *tables: str, params: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = engine(spark, sf_dir, *tables)
        if text:
            db.execute(text)
        return db.query(query, params)

    return run


def _outcomes(db: Engine, statements: dict[str, str]) -> DataFrame:
    """(what, outcome): the error that each statement ends with, or ok."""
    kinds = {ConstraintError: "constraint", ParseError: "syntax", Signal: "signal", EngineError: "engine"}
    out = []
    for what, text in statements.items():
        try:
            r = db.execute(text)
            if r.df is not None:
                r.df.collect()
            out.append((what, "ok"))
        except Exception as e:  # noqa: BLE001
            out.append((what, next((n for k, n in kinds.items() if isinstance(e, k)), "analysis" if type(e).__name__ == "AnalysisException" else type(e).__name__)))
    return db.spark.createDataFrame(out, "what string, outcome string")


#: Statements that must be refused, and how.
REFUSED = {
    "column outside GROUP BY": ("SELECT name, COUNT(*) FROM acc GROUP BY nation", "analysis"),
    "set operation of unlike widths": ("SELECT k FROM acc UNION SELECT k, name FROM acc", "analysis"),
    "unknown column": ("SELECT nope FROM acc", "analysis"),
    "unknown function": ("SELECT NOFUNCTION(k) FROM acc", "syntax"),
    "NULL where it may not be": ("INSERT INTO acc (k, name) VALUES (-1, NULL)", "constraint"),
    "key twice": ("INSERT INTO acc (k, name) VALUES (1, 'again')", "constraint"),
    "key twice in one statement": ("INSERT INTO acc (k, name) VALUES (-5, 'a'), (-5, 'b')", "constraint"),
    "key twice by update": ("UPDATE acc SET k = 1", "constraint"),
    "too long": (f"INSERT INTO acc (k, name) VALUES (-1, '{'x' * 61}')", "constraint"),
    "check": ("INSERT INTO child VALUES (1, -5)", "constraint"),
    "no parent": ("INSERT INTO child VALUES (-77, 5)", "constraint"),
    "unique index": ("INSERT INTO acc (k, name) SELECT -k, name FROM acc", "constraint"),
    "parent that is referred to": ("DELETE FROM acc", "constraint"),
    "table that is referred to": ("DROP TABLE acc", "constraint"),
    "table twice": ("CREATE TABLE acc (x INT)", "engine"),
    "column twice": ("CREATE TABLE two (x INT, X TEXT)", "engine"),
    "two primary keys": ("CREATE TABLE two (x INT PRIMARY KEY, y INT PRIMARY KEY)", "engine"),
    "key of no column": ("CREATE TABLE two (x INT, PRIMARY KEY (y))", "engine"),
    "commit of nothing": ("COMMIT", "engine"),
    "signal": ("SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'stop'", "signal"),
    "call with too few arguments": ("CALL p()", "engine"),
}


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = engine(spark, sf_dir, "customer")
    db.execute(LOADED + "CREATE TABLE child (a BIGINT REFERENCES acc(k), v INT, CHECK (v > 0)); INSERT INTO child VALUES (1, 1); CREATE UNIQUE INDEX names ON acc (name); CREATE PROCEDURE p(n INT) AS BEGIN DELETE FROM child; END")
    return _outcomes(db, {k: t for k, (t, _) in REFUSED.items()})


def atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that fail half-way, and one in a transaction, leave everything as it was."""
    db = engine(spark, sf_dir, "customer")
    db.execute(LOADED + "CREATE TABLE log (m TEXT); CREATE TRIGGER late AFTER UPDATE ON acc WHEN (NEW.k = 3) BEGIN INSERT INTO log VALUES ('seen'); SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'no'; END")
    for bad in ("UPDATE acc SET bal = 0", "INSERT INTO acc SELECT k - 1, name, nation, bal FROM acc", "DELETE FROM nowhere"):
        try:
            db.execute(bad)
        except Exception:  # noqa: BLE001, S110
            pass
    return db.query("SELECT k, name, nation, bal, (SELECT COUNT(*) FROM log) AS logged FROM acc")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it was before an update and a delete."""
    db = engine(spark, sf_dir, "customer")
    db.execute(LOADED)
    moment = db.catalog.get("tables", "acc")["versions"][-1]["time"]
    db.execute("UPDATE acc SET bal = bal + 1; DELETE FROM acc WHERE nation < 12")
    return db.as_of("acc", moment)


def returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = engine(spark, sf_dir, "customer")
    db.execute(LOADED)
    gone = db.execute("DELETE FROM acc WHERE bal < 0 RETURNING k, UPPER(name) AS what").df
    more = db.execute("UPDATE acc SET bal = bal * 2 WHERE nation = 3 RETURNING k, CAST(bal AS TEXT) IS NOT NULL AS what").df
    new = db.execute("INSERT INTO acc (k, name) VALUES (-1, 'x'), (-2, 'y') RETURNING k, name || '!' AS what").df
    return gone.unionByName(more.withColumn("what", F.lit("changed"))).unionByName(new)


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = engine(spark, sf_dir, "customer")
    db.execute(LOADED)
    n = db.execute("TRUNCATE TABLE acc").affected
    db.execute("INSERT INTO acc (k, name) VALUES (5, 'five')")
    return db.query("SELECT k, name, @n AS gone FROM acc", {"n": n})


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = engine(spark, sf_dir, "customer")
    db.execute("CREATE TABLE acc (k BIGINT PRIMARY KEY, name VARCHAR(60) NOT NULL, nation INT, bal DOUBLE)")
    n = db.bulk_insert("acc", parquet(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS bal"))
    n += db.bulk_insert("acc", [{"k": -1, "name": "first"}, {"k": -2, "name": "second", "bal": 2.5}])
    n += db.bulk_update("acc", {"name": "LOWER(name)"}, "nation = @n", {"n": 4})
    n += db.bulk_delete("acc", "bal < @b", {"b": 0})
    return db.query("SELECT k, name, nation, bal, @n AS touched FROM acc", {"n": n})


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = engine(spark, sf_dir)
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v TEXT)")
    n = db.prepare("INSERT INTO t VALUES (?, ?)").execute_batch([[i, f"v{i}"] for i in range(20)])
    n += db.prepare("UPDATE t SET v = v || @s WHERE k = @k").execute_batch([{"k": i, "s": "+"} for i in range(5)])
    return db.query("SELECT k, v, @n AS touched FROM t", {"n": n})


def imported(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db, at = engine(spark, sf_dir, "supplier"), new_folder(spark, kind)
        db.execute("CREATE TABLE s (s_suppkey BIGINT PRIMARY KEY, s_name TEXT, s_nationkey INT, s_acctbal DOUBLE)")
        schema = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
        if kind == "csv":
            files.export_csv(parquet(spark, sf_dir, "supplier"), at)
            db.bulk_insert("s", files.import_csv(spark, at, schema))
        else:
            files.export_json(parquet(spark, sf_dir, "supplier"), at)
            db.bulk_insert("s", files.import_json(spark, at, schema, lines=True))
        return db.query("SELECT * FROM s")

    return run


def exported(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = new_folder(spark, kind)
        (files.export_csv if kind == "csv" else files.export_json)(parquet(spark, sf_dir, "nation"), at)
        return spark.read.text(at).filter("value NOT LIKE 'n_nationkey,%'")

    return run


def dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents come before children; another catalog runs the parents' statements, the children's are counted."""
    db, at = engine(spark, sf_dir, "region", "nation"), new_folder(spark, "dump")
    db.execute("CREATE TABLE r (k INT PRIMARY KEY, t TEXT); CREATE TABLE a (k INT PRIMARY KEY, t TEXT, r INT REFERENCES r(k)); INSERT INTO r SELECT r_regionkey, r_name FROM region; INSERT INTO a SELECT n_nationkey, n_name, n_regionkey FROM nation")
    other, order = engine(spark, sf_dir), db.dump(at)
    other.execute("CREATE TABLE r (k INT PRIMARY KEY, t TEXT); BEGIN; " + " ".join(r.value for r in spark.read.text(f"{at}/000-{order[0]}").collect()) + " COMMIT")
    return other.query("SELECT k, t, @n AS children FROM r", {"n": spark.read.text(f"{at}/001-{order[1]}").filter("value LIKE 'INSERT INTO \"a\" %'").count()})


def key_value(spark: SparkSession, sf_dir: str, start: bytes | None = None, end: bytes | None = None, as_of: int | None = None) -> DataFrame:
    kv, c = KeyValue(spark, new_folder(spark, "kv")), parquet(spark, sf_dir, "customer")
    pair = lambda v: [F.col("c_name").cast("binary").alias("key"), v.cast("binary").alias("value")]
    kv.apply(c.select(*pair(F.col("c_mktsegment"))))
    kv.apply(c.filter("c_nationkey = 5").select(*pair(F.lit("five"))), c.filter("c_acctbal < 0 AND c_nationkey <> 5").select(F.col("c_name").cast("binary").alias("key")))
    return kv.scan(start, end, as_of).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_KV = "SELECT c_name AS key, CASE WHEN c_nationkey = 5 THEN 'five' ELSE c_mktsegment END AS value FROM customer WHERE (c_acctbal >= 0 OR c_nationkey = 5)"

#: name: (query, SQL that gives the same)
ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "engine_views": (
        script("CREATE VIEW often AS SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey; CREATE VIEW most (k, n) AS SELECT o_custkey, n FROM often WHERE n > 10", "SELECT m.k, m.n, c.c_name FROM most AS m JOIN customer AS c ON c.c_custkey = m.k", "orders", "customer"),
        "SELECT k, n, c_name FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10) JOIN customer ON c_custkey = k",
    ),
    "engine_schema_columns": (
        script("CREATE TABLE a (id BIGINT PRIMARY KEY AUTOINCREMENT, t VARCHAR(9) NOT NULL, n DECIMAL(8, 2) DEFAULT 3, v AS (id + 1)); CREATE VIEW w AS SELECT t FROM a", "SELECT table_name, column_name, ordinal_position, is_nullable, data_type, character_maximum_length, numeric_precision, numeric_scale, column_default, is_identity, is_generated FROM INFORMATION_SCHEMA.COLUMNS"),
        "SELECT * FROM (VALUES ('a', 'id', 1, 'NO', 'BIGINT', NULL, NULL, NULL, NULL, 'YES', 'NEVER'), ('a', 't', 2, 'NO', 'VARCHAR', 9, NULL, NULL, NULL, 'NO', 'NEVER'), ('a', 'n', 3, 'YES', 'DECIMAL', NULL, 8, 2, '3', 'NO', 'NEVER'), ('a', 'v', 4, 'YES', 'BIGINT', NULL, NULL, NULL, NULL, 'NO', 'ALWAYS')) x(table_name, column_name, ordinal_position, is_nullable, data_type, character_maximum_length, numeric_precision, numeric_scale, column_default, is_identity, is_generated)",
    ),
    "engine_schema_constraints": (
        script("CREATE TABLE a (id INT PRIMARY KEY, u TEXT UNIQUE); CREATE TABLE b (x INT, a INT REFERENCES a(id) ON DELETE CASCADE ON UPDATE SET NULL, CONSTRAINT plus CHECK (x > 0)); CREATE INDEX bx ON b (x DESC) INCLUDE (a)", "SELECT c.table_name, c.constraint_type, r.referenced_table_name, r.update_rule, r.delete_rule, (SELECT COUNT(*) FROM INFORMATION_SCHEMA.INDEXES) AS indexed FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS AS c LEFT JOIN INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS AS r ON r.constraint_name = c.constraint_name"),
        "SELECT * FROM (VALUES ('a', 'PRIMARY KEY', NULL, NULL, NULL, 2), ('a', 'UNIQUE', NULL, NULL, NULL, 2), ('b', 'FOREIGN KEY', 'a', 'SET NULL', 'CASCADE', 2), ('b', 'CHECK', NULL, NULL, NULL, 2)) x(table_name, constraint_type, referenced_table_name, update_rule, delete_rule, indexed)",
    ),
    "engine_schema_objects": (
        script("CREATE TABLE a (id INT); CREATE VIEW v AS SELECT id FROM a; CREATE SEQUENCE s START WITH 4; CREATE FUNCTION f(x INT) RETURNS INT AS BEGIN RETURN x + 1; END; CREATE PROCEDURE p(n INT) AS BEGIN DELETE FROM a; END; CREATE TRIGGER g AFTER UPDATE OF id ON a BEGIN DELETE FROM a; END", "SELECT 'table' AS kind, table_name AS name, table_type AS what FROM INFORMATION_SCHEMA.TABLES UNION ALL SELECT 'routine', routine_name, routine_type FROM INFORMATION_SCHEMA.ROUTINES UNION ALL SELECT 'parameter', specific_name, parameter_name FROM INFORMATION_SCHEMA.PARAMETERS UNION ALL SELECT 'trigger', trigger_name, action_timing || ' ' || event_manipulation FROM INFORMATION_SCHEMA.TRIGGERS UNION ALL SELECT 'sequence', sequence_name, CAST(start_value AS TEXT) FROM INFORMATION_SCHEMA.SEQUENCES"),
        "SELECT * FROM (VALUES ('table', 'a', 'BASE TABLE'), ('table', 'v', 'VIEW'), ('routine', 'f', 'FUNCTION'), ('routine', 'p', 'PROCEDURE'), ('parameter', 'f', 'x'), ('parameter', 'p', 'n'), ('trigger', 'g', 'AFTER UPDATE'), ('sequence', 's', '4')) x(kind, name, what)",
    ),
    "kv_scan": (lambda s, d: key_value(s, d), _KV),
    "kv_range": (lambda s, d: key_value(s, d, b"Customer#000000010", b"Customer#00000009"), f"{_KV} AND c_name >= 'Customer#000000010' AND c_name < 'Customer#00000009'"),
    "kv_snapshot": (lambda s, d: key_value(s, d, as_of=1), "SELECT c_name AS key, c_mktsegment AS value FROM customer"),
    "engine_index_range": (script(LOADED + "CREATE INDEX bals ON acc (bal) INCLUDE (name)", "SELECT k, name FROM acc WHERE bal BETWEEN 100 AND 2500", "customer"), "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal BETWEEN 100 AND 2500"),
    "engine_index_find": (script(LOADED + "CREATE UNIQUE INDEX names ON acc (name)", "SELECT k, nation FROM acc WHERE name IN (SELECT c_name FROM customer WHERE c_nationkey = 7)", "customer"), "SELECT c_custkey AS k, c_nationkey AS nation FROM customer WHERE c_nationkey = 7"),
    "engine_snapshot": (snapshot, _WHOLE),
    "engine_insert_select": (
        script("CREATE TABLE t (id BIGINT PRIMARY KEY AUTOINCREMENT, k BIGINT NOT NULL, score INT DEFAULT 7, twice AS (score * 2) STORED, plus AS (k + score)); INSERT INTO t (k) SELECT c_custkey FROM customer; INSERT INTO t (k, score) VALUES (-1, 1), (-2, DEFAULT)", "SELECT k, score, twice, plus, (SELECT COUNT(DISTINCT id) FROM t) AS ids, (SELECT MAX(id) FROM t) AS top FROM t", "customer"),
        "SELECT k, s AS score, 2 * s AS twice, k + s AS plus, (SELECT count(*) + 2 FROM customer) AS ids, (SELECT count(*) + 2 FROM customer) AS top FROM (SELECT c_custkey AS k, 7 AS s FROM customer UNION ALL VALUES (-1, 1), (-2, 7))",
    ),
    "engine_or_ignore": (script(f"{ACC} INSERT OR IGNORE INTO acc {NEW}", STATE, "customer"), f"{_OLD} UNION ALL SELECT {_COME} c_custkey > {HIGH}"),
    "engine_or_replace": (script(f"{ACC} INSERT OR REPLACE INTO acc {NEW}", STATE, "customer"), f"{_WHOLE} WHERE c_custkey <= {LOW} UNION ALL SELECT {_COME} c_custkey > {LOW}"),
    "engine_on_conflict_nothing": (script(f"{ACC} INSERT INTO acc {NEW} ON CONFLICT (k) DO NOTHING", STATE, "customer"), f"{_OLD} UNION ALL SELECT {_COME} c_custkey > {HIGH}"),
    "engine_on_conflict_update": (
        script(f"{ACC} INSERT INTO acc {NEW} ON CONFLICT (k) DO UPDATE SET name = EXCLUDED.name, nation = acc.nation + EXCLUDED.nation WHERE acc.k % 2 = 0", STATE, "customer"),
        f"SELECT c_custkey AS k, CASE WHEN c_custkey > {LOW} AND c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey > {LOW} AND c_custkey % 2 = 0 THEN c_nationkey + 7 ELSE c_nationkey END AS nation, c_acctbal AS bal FROM customer WHERE c_custkey <= {HIGH} UNION ALL SELECT {_COME} c_custkey > {HIGH}",
    ),
    "engine_merge": (
        script(f"{ACC} MERGE INTO acc AS a USING (SELECT c_custkey AS c, c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey > {LOW}) AS s ON a.k = s.c WHEN MATCHED AND s.b < 0 THEN DELETE WHEN MATCHED THEN UPDATE SET bal = s.b * 2, name = LOWER(a.name) WHEN NOT MATCHED AND s.c % 2 = 0 THEN INSERT (k, name, bal) VALUES (s.c, s.n, s.b)", STATE, "customer"),
        f"SELECT c_custkey AS k, CASE WHEN c_custkey > {LOW} AND c_custkey <= {HIGH} THEN lower(c_name) ELSE c_name END AS name, CASE WHEN c_custkey > {HIGH} THEN NULL ELSE c_nationkey END AS nation, CASE WHEN c_custkey > {LOW} AND c_custkey <= {HIGH} THEN c_acctbal * 2 ELSE c_acctbal END AS bal FROM customer WHERE c_custkey <= {LOW} OR (c_custkey <= {HIGH} AND c_acctbal >= 0) OR (c_custkey > {HIGH} AND c_custkey % 2 = 0)",
    ),
    "engine_update": (script(LOADED + "UPDATE acc SET bal = bal + nation, name = UPPER(name) WHERE nation > 10 OR bal < 0", STATE, "customer"), "SELECT c_custkey AS k, CASE WHEN c_nationkey > 10 OR c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS name, c_nationkey AS nation, CASE WHEN c_nationkey > 10 OR c_acctbal < 0 THEN c_acctbal + c_nationkey ELSE c_acctbal END AS bal FROM customer"),
    "engine_update_from": (
        script(LOADED + "UPDATE acc SET bal = o.top FROM (SELECT o_custkey, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey) AS o WHERE acc.k = o.o_custkey", STATE, "customer", "orders"),
        "SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), c_acctbal) AS bal FROM customer",
    ),
    "engine_delete": (script(LOADED + "DELETE FROM acc WHERE bal < 1000 AND nation <> 3", STATE, "customer"), f"{_WHOLE} WHERE NOT (c_acctbal < 1000 AND c_nationkey <> 3)"),
    "engine_delete_using": (
        script("CREATE TABLE o (k BIGINT PRIMARY KEY, c BIGINT); INSERT INTO o SELECT o_orderkey, o_custkey FROM orders; DELETE FROM o USING customer AS c WHERE o.c = c.c_custkey AND c.c_acctbal < 0", "SELECT k, c FROM o", "customer", "orders"),
        "SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)",
    ),
    "engine_returning": (returning, "SELECT c_custkey AS k, upper(c_name) AS what FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'changed' FROM customer WHERE c_nationkey = 3 AND c_acctbal >= 0 UNION ALL VALUES (-1, 'x!'), (-2, 'y!')"),
    "engine_truncate": (truncated, "SELECT 5 AS k, 'five' AS name, count(*) AS gone FROM customer"),
    "engine_atomic": (atomic, f"SELECT *, 0 AS logged FROM ({_WHOLE})"),
    "engine_refused": (refused, "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{o}')" for k, (_, o) in REFUSED.items()) + ") x(what, outcome)"),
    "engine_bulk": (
        bulk,
        "SELECT k, CASE WHEN nation = 4 THEN lower(name) ELSE name END AS name, nation, bal, (SELECT count(*) + 2 + count(*) FILTER (c_nationkey = 4) + count(*) FILTER (c_acctbal < 0) FROM customer) AS touched FROM (SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, c_acctbal AS bal FROM customer UNION ALL VALUES (-1, 'first', NULL, NULL), (-2, 'second', NULL, 2.5)) WHERE bal >= 0 OR bal IS NULL",
    ),
    "engine_batch": (batch, "SELECT i AS k, 'v' || i || CASE WHEN i < 5 THEN '+' ELSE '' END AS v, 25 AS touched FROM range(20) r(i)"),
    "engine_import_csv": (imported("csv"), "SELECT * FROM supplier"),
    "engine_import_json": (imported("json"), "SELECT * FROM supplier"),
    "export_inserts": (lambda s, d: files.insert_statements(parquet(s, d, "region"), "region"), """SELECT 'INSERT INTO "region" ("r_regionkey", "r_name") VALUES (' || r_regionkey || ', ''' || replace(r_name, '''', '''''') || ''');' AS value FROM region"""),
    "export_csv": (exported("csv"), "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS value FROM nation"),
    "export_json": (exported("json"), """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation"""),
    "engine_dump": (dumped, "SELECT r_regionkey AS k, r_name AS t, (SELECT count(*) FROM nation) AS children FROM region"),
    "engine_parameters": (script("", "SELECT c_custkey, c_name || @tail AS t FROM customer WHERE c_acctbal > @low AND c_nationkey IN (@a, @b)", "customer", params={"tail": "!", "low": 500, "a": 3, "b": 11}), "SELECT c_custkey, c_name || '!' AS t FROM customer WHERE c_acctbal > 500 AND c_nationkey IN (3, 11)"),
    "engine_unparsable_text": (
        script("", "SELECT o_orderkey, o_orderdate <> 'someday' AS a, o_custkey = 'x' AS b, NULLIF(o_custkey, 7) <> 'y' AS c FROM orders WHERE o_totalprice <> 'nope' AND o_custkey > '50'", "orders"),
        "SELECT o_orderkey, true AS a, false AS b, CASE WHEN o_custkey <> 7 THEN true END AS c FROM orders WHERE o_custkey > 50",
    ),
    "engine_clock": (
        script("", "SELECT n_nationkey, NOW() IS NOT NULL AND YEAR(NOW()) > 2020 AS a, CURRENT_DATE = CAST(NOW() AS DATE) AS b, LOCALTIMESTAMP() IS NOT NULL AS c, LOCALDATE() IS NOT NULL AS d, LOCALTIME() IS NOT NULL AS e, CURRENT_TIME IS NOT NULL AS f, CURRENT_TIMESTAMP >= TODATE('2020-01-01') AS g, MILLISECOND(CAST('2024-01-02 03:04:05.678' AS DATETIME)) AS h, TODATE('2024-02-30') IS NULL AS i FROM nation", "nation"),
        "SELECT n_nationkey, true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g, 678 AS h, true AS i FROM nation",
    ),
    "engine_random": (
        script("", "SELECT COUNT(*) AS n, MIN(r) >= 0 AND MAX(r) < 1 AS inside, MIN(i) = 1 AND MAX(i) = 6 AS dice, COUNT(DISTINCT g) AS ids, MIN(LENGTH(g)) AS size FROM (SELECT RANDOM() AS r, RANDOM(1, 6) AS i, NEWGUID() AS g FROM lineitem) AS x", "lineitem"),
        "SELECT count(*) AS n, true AS inside, true AS dice, count(*) AS ids, 36 AS size FROM lineitem",
    ),
    "engine_session": (
        script("CREATE TABLE t (id BIGINT PRIMARY KEY AUTOINCREMENT, k BIGINT); INSERT INTO t (k) SELECT c_custkey FROM customer; DELETE FROM t WHERE k % 2 = 0", "SELECT CHANGES() AS c, LAST_INSERT_ROWID() AS i, LENGTH(DATABASE()) > 0 AS d, LENGTH(VERSION()) > 0 AS v", "customer"),
        "SELECT count(*) FILTER (c_custkey % 2 = 0) AS c, count(*) AS i, true AS d, true AS v FROM customer",
    ),
    "engine_sequence": (
        script("CREATE TABLE t (k BIGINT, c BIGINT); CREATE SEQUENCE q START WITH 5; INSERT INTO t VALUES (NEXTVAL('q'), 0), (NEXTVAL('q'), 0); ALTER SEQUENCE q RESTART WITH 50; INSERT INTO t VALUES (NEXTVAL('q'), CURRVAL('q'))", "SELECT k, c, CURRVAL('q') AS now FROM t"),
        "SELECT * FROM (VALUES (5, 0, 50), (6, 0, 50), (50, 50, 50)) x(k, c, now)",
    ),
    "engine_alter": (
        script(LOADED + "ALTER TABLE acc ADD COLUMN tag TEXT DEFAULT 'new'; ALTER TABLE acc RENAME COLUMN name TO title; ALTER TABLE acc ALTER COLUMN nation TYPE BIGINT; ALTER TABLE acc DROP COLUMN bal; ALTER TABLE acc ADD twice AS (nation * 2); ALTER TABLE acc ADD CONSTRAINT plus CHECK (k >= 0); ALTER TABLE acc DROP CONSTRAINT plus; ALTER TABLE acc RENAME TO acc2; INSERT INTO acc2 (k, title) VALUES (-1, 'last')", "SELECT * FROM acc2", "customer"),
        "SELECT c_custkey AS k, c_name AS title, CAST(c_nationkey AS BIGINT) AS nation, 'new' AS tag, CAST(c_nationkey AS BIGINT) * 2 AS twice FROM customer UNION ALL VALUES (-1, 'last', NULL, 'new', NULL)",
    ),
    "engine_drop": (script("CREATE TABLE a (x INT); CREATE VIEW v AS SELECT x FROM a; CREATE INDEX i ON a (x); CREATE SEQUENCE s; DROP VIEW v; DROP INDEX i; DROP SEQUENCE s; DROP TABLE a; DROP TABLE IF EXISTS a; CREATE TABLE IF NOT EXISTS b (y INT)", "SELECT table_name FROM INFORMATION_SCHEMA.TABLES"), "SELECT 'b' AS table_name"),
    "engine_cascade": (
        script("CREATE TABLE n (k INT PRIMARY KEY); CREATE TABLE c (k BIGINT PRIMARY KEY, n INT REFERENCES n(k) ON DELETE CASCADE ON UPDATE CASCADE); CREATE TABLE o (k BIGINT PRIMARY KEY, c BIGINT REFERENCES c(k) ON DELETE SET NULL); INSERT INTO n SELECT n_nationkey FROM nation; INSERT INTO c SELECT c_custkey, c_nationkey FROM customer; INSERT INTO o SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey END FROM orders; UPDATE n SET k = 100 WHERE k = 3; DELETE FROM n WHERE k < 5", "SELECT o.k, o.c, c.n FROM o LEFT JOIN c ON o.c = c.k", "nation", "customer", "orders"),
        "SELECT o_orderkey AS k, c_custkey AS c, CASE WHEN c_nationkey = 3 THEN 100 ELSE c_nationkey END AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey >= 5 OR c_nationkey = 3) ON o_custkey = c_custkey",
    ),
    "engine_triggers": (
        script(LOADED + "CREATE TABLE log (k BIGINT, m TEXT); CREATE TRIGGER up AFTER UPDATE OF bal ON acc FOR EACH ROW WHEN (NEW.bal > OLD.bal) BEGIN INSERT INTO log VALUES (NEW.k, 'up'); END; CREATE TRIGGER gone AFTER DELETE ON acc BEGIN INSERT INTO log VALUES (OLD.k, 'gone'); END; CREATE TRIGGER come AFTER INSERT ON acc BEGIN INSERT INTO log VALUES (NEW.k, 'come'); END; CREATE VIEW v AS SELECT k, name FROM acc; CREATE TRIGGER inst INSTEAD OF INSERT ON v BEGIN INSERT INTO acc (k, name) VALUES (NEW.k, UPPER(NEW.name)); END; UPDATE acc SET bal = bal * 2; DELETE FROM acc WHERE nation = 9; INSERT INTO v (k, name) VALUES (-1, 'z')", "SELECT k, m FROM log", "customer"),
        "SELECT c_custkey AS k, 'up' AS m FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'gone' FROM customer WHERE c_nationkey = 9 UNION ALL VALUES (-1, 'come')",
    ),
    "engine_function": (script("CREATE FUNCTION net(x DOUBLE, d DOUBLE) RETURNS DOUBLE AS BEGIN RETURN x * (1 - d); END", "SELECT l_orderkey, l_linenumber, net(l_extendedprice, l_discount) AS v FROM lineitem", "lineitem"), "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS v FROM lineitem"),
    "engine_procedure": (
        script(LOADED + "CREATE PROCEDURE raise_(n INT, by_ DOUBLE) AS BEGIN UPDATE acc SET bal = bal + @by_ WHERE nation = @n; DELETE FROM acc WHERE bal < 0 AND nation = @n; END; CALL raise_(4, 100); CALL raise_(6, -50)", STATE, "customer"),
        "SELECT k, name, nation, bal FROM (SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, CASE c_nationkey WHEN 4 THEN c_acctbal + 100 WHEN 6 THEN c_acctbal + -50 ELSE c_acctbal END AS bal FROM customer) WHERE NOT (nation IN (4, 6) AND bal < 0)",
    ),
    "engine_rowversion": (
        script("CREATE TABLE t (k BIGINT PRIMARY KEY, v DOUBLE, rv ROWVERSION); INSERT INTO t (k, v) SELECT c_custkey, c_acctbal FROM customer; UPDATE t SET v = 0 WHERE k % 2 = 0; UPDATE t SET v = 1 WHERE k % 4 = 0", "SELECT k, v, rv FROM t", "customer"),
        "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 1 WHEN c_custkey % 2 = 0 THEN 0 ELSE c_acctbal END AS v, CASE WHEN c_custkey % 4 = 0 THEN 3 WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS rv FROM customer",
    ),
    "engine_transactions": (
        script(LOADED + "BEGIN TRANSACTION; UPDATE acc SET bal = 0 WHERE nation = 1; SAVEPOINT a; DELETE FROM acc WHERE nation = 2; SAVEPOINT b; DELETE FROM acc; ROLLBACK TO SAVEPOINT b; RELEASE b; COMMIT; BEGIN; DELETE FROM acc; ROLLBACK; SET TRANSACTION ISOLATION LEVEL SNAPSHOT", STATE, "customer"),
        "SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, CASE WHEN c_nationkey = 1 THEN 0 ELSE c_acctbal END AS bal FROM customer WHERE c_nationkey <> 2",
    ),
    "engine_explain": (
        lambda s, d: engine(s, d, "orders").query("EXPLAIN QUERY PLAN SELECT o_custkey, COUNT(*) FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey").agg(F.max(F.lower("detail").startswith("filter")).alias("filters"), F.max(F.lower("detail").contains("aggregate")).alias("aggregates"), F.min("parent").alias("root")),
        "SELECT true AS filters, true AS aggregates, 0 AS root",
    ),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for k, (q, _) in ENTRIES.items()}
ORACLE: dict[str, str] = {k: o for k, (_, o) in ENTRIES.items()}
