"""Statements through the engine: changes, constraints, cascades, triggers, routines, transactions, metadata."""

import pytest

from tarnwick.engine import Engine
from tarnwick.errors import ConflictError, ConstraintError, EngineError, ParseError, Signal


@pytest.fixture()
def db(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def all_of(db, text, params=None):
    return sorted((tuple(r) for r in db.query(text, params).collect()), key=str)


USERS = "CREATE TABLE users (id BIGINT PRIMARY KEY AUTOINCREMENT, name VARCHAR(20) NOT NULL, score INT DEFAULT 7, twice AS (score * 2) STORED, CHECK (score < 1000))"


def test_insert_defaults_returning(db):
    db.execute(USERS)
    got = db.execute("INSERT INTO users (name, score) VALUES ('ann', 1), ('bob', DEFAULT) RETURNING id, name, twice")
    assert sorted(map(tuple, got.df.collect())) == [(1, "ann", 2), (2, "bob", 14)] and got.affected == 2
    assert db.execute("SELECT LAST_INSERT_ROWID() AS i, CHANGES() AS c").rows() == [{"i": 2, "c": 2}]
    db.execute("INSERT INTO users (name) SELECT name || '2' FROM users; INSERT INTO users (name) VALUES (@n)", {"n": "cy"})
    assert all_of(db, "SELECT id FROM users") == [(1,), (2,), (3,), (4,), (5,)]
    for bad in ("INSERT INTO users (id, name) VALUES (1, 'x')", "INSERT INTO users (name, score) VALUES ('x', 1000)", "INSERT INTO users (name) VALUES (NULL)", f"INSERT INTO users (name) VALUES ('{'a' * 21}')"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    assert db.query("SELECT COUNT(*) FROM users").first()[0] == 5
    with pytest.raises(EngineError):
        db.execute("INSERT INTO users (nope) VALUES (1)")


def test_upserts(db):
    db.execute("CREATE TABLE s (k TEXT PRIMARY KEY, v INT); INSERT INTO s VALUES ('a', 1), ('b', 2)")
    db.execute("INSERT OR IGNORE INTO s VALUES ('a', 9), ('c', 3), ('c', 4)")
    assert all_of(db, "SELECT * FROM s") == [("a", 1), ("b", 2), ("c", 3)]
    db.execute("INSERT OR REPLACE INTO s VALUES ('b', 20), ('d', 5)")
    db.execute("INSERT INTO s VALUES ('a', 5), ('e', 6) ON CONFLICT (k) DO UPDATE SET v = s.v + EXCLUDED.v WHERE s.v < 3")
    db.execute("INSERT INTO s VALUES ('a', 100) ON CONFLICT DO NOTHING")
    assert all_of(db, "SELECT * FROM s") == [("a", 6), ("b", 20), ("c", 3), ("d", 5), ("e", 6)]


def test_update_delete_from_using(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT); CREATE TABLE u (id INT, w INT); INSERT INTO t VALUES (1, 10), (2, 20), (3, 30); INSERT INTO u VALUES (1, 5), (1, 7), (3, 9)")
    got = db.execute("UPDATE t SET v = u.w FROM u WHERE t.id = u.id RETURNING id, v")
    assert sorted(map(tuple, got.df.collect())) == [(1, 5), (3, 9)]
    assert db.execute("DELETE FROM t USING u WHERE t.id = u.id AND u.w > 8").affected == 1
    assert all_of(db, "SELECT * FROM t") == [(1, 5), (2, 20)]
    assert db.execute("TRUNCATE TABLE t").affected == 2 and all_of(db, "SELECT * FROM t") == []


def test_merge(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'); CREATE TABLE s (id INT, v TEXT); INSERT INTO s VALUES (1, 'x'), (2, 'del'), (8, 'new'), (9, 'no')")
    n = db.execute("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED AND s.v = 'del' THEN DELETE WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED AND s.v <> 'no' THEN INSERT (id, v) VALUES (s.id, s.v)").affected
    assert n == 3 and all_of(db, "SELECT * FROM t") == [(1, "x"), (3, "c"), (8, "new")]


def test_foreign_keys(db):
    db.execute("CREATE TABLE d (id INT PRIMARY KEY, up INT REFERENCES d(id) ON DELETE CASCADE); CREATE TABLE e (id INT PRIMARY KEY, d INT REFERENCES d(id) ON DELETE CASCADE ON UPDATE CASCADE); CREATE TABLE f (e INT DEFAULT 0 REFERENCES e(id) ON DELETE SET NULL)")
    db.execute("INSERT INTO d VALUES (1, NULL), (2, 1), (3, NULL); INSERT INTO e VALUES (10, 1), (20, 2), (30, 3); INSERT INTO f VALUES (10), (20), (30)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO e VALUES (40, 99)")
    with pytest.raises(ConstraintError):
        db.execute("DROP TABLE e")
    db.execute("UPDATE d SET id = 33 WHERE id = 3")
    assert all_of(db, "SELECT * FROM e WHERE id = 30") == [(30, 33)]
    db.execute("DELETE FROM d WHERE id = 1")
    assert all_of(db, "SELECT id FROM d") == [(33,)] and all_of(db, "SELECT id FROM e") == [(30,)]
    assert all_of(db, "SELECT * FROM f") == sorted([(None,), (None,), (30,)], key=str)
    db.execute("CREATE TABLE g (e INT REFERENCES e(id)); INSERT INTO g VALUES (30)")
    with pytest.raises(ConstraintError):
        db.execute("DELETE FROM e")
    assert all_of(db, "SELECT id FROM e") == [(30,)]


def test_triggers(db):
    db.execute(USERS + "; CREATE TABLE log (m TEXT); INSERT INTO users (name, score) VALUES ('a', 1), ('b', 5)")
    db.execute("CREATE TRIGGER g AFTER UPDATE OF score ON users FOR EACH ROW WHEN (NEW.score > OLD.score) BEGIN INSERT INTO log VALUES (NEW.name || ':' || OLD.score || '>' || NEW.score); END")
    db.execute("CREATE TRIGGER h BEFORE DELETE ON users WHEN (OLD.name = 'b') BEGIN SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'not b'; END")
    db.execute("UPDATE users SET score = score * 3; UPDATE users SET score = 0; UPDATE users SET name = 'c' WHERE name = 'a'")
    assert all_of(db, "SELECT * FROM log") == [("a:1>3",), ("b:5>15",)]
    with pytest.raises(Signal, match="not b"):
        db.execute("DELETE FROM users")
    assert db.execute("DELETE FROM users WHERE name = 'c'").affected == 1
    db.execute("CREATE VIEW v AS SELECT id, name FROM users; CREATE TRIGGER i INSTEAD OF INSERT ON v BEGIN INSERT INTO users (name) VALUES (UPPER(NEW.name)); END; INSERT INTO v (id, name) VALUES (0, 'z')")
    assert all_of(db, "SELECT name FROM users") == [("Z",), ("b",)]


def test_transactions_and_time_travel(db):
    db.execute("CREATE TABLE t (x INT); INSERT INTO t VALUES (1)")
    moment = db.catalog.get("tables", "t")["versions"][-1]["time"]
    db.execute("BEGIN TRANSACTION; INSERT INTO t VALUES (2); SAVEPOINT p; DELETE FROM t; ROLLBACK TO SAVEPOINT p; INSERT INTO t VALUES (3); RELEASE p; COMMIT")
    assert all_of(db, "SELECT * FROM t") == [(1,), (2,), (3,)]
    db.execute("BEGIN; UPDATE t SET x = 0; ROLLBACK")
    assert all_of(db, "SELECT * FROM t") == [(1,), (2,), (3,)]
    assert [r.x for r in db.as_of("t", moment).collect()] == [1]
    db.vacuum()
    assert not [n for n in db.catalog.files.names(db.catalog.root) if n.startswith("tmp-")]
    again = Engine(db.spark, db.catalog.root)
    assert all_of(again, "SELECT * FROM t") == [(1,), (2,), (3,)]
    with pytest.raises(EngineError):
        db.execute("COMMIT")


def test_routines_and_sequences(db):
    db.execute("CREATE TABLE t (x INT, y TEXT); CREATE FUNCTION dbl(x INT) RETURNS INT AS BEGIN RETURN x * 2; END; CREATE PROCEDURE add2(n INT, s TEXT) AS BEGIN INSERT INTO t VALUES (@n, @s); INSERT INTO t VALUES (dbl(@n), @s); END; CALL add2(4, 'it''s')")
    assert all_of(db, "SELECT * FROM t") == [(4, "it's"), (8, "it's")]
    db.execute("CREATE SEQUENCE q START WITH 5; INSERT INTO t VALUES (NEXTVAL('q'), 'a'), (NEXTVAL('q'), 'b')")
    assert all_of(db, "SELECT CURRVAL('q') AS c") == [(6,)]
    db.execute("ALTER SEQUENCE q RESTART WITH 50")
    assert all_of(db, "SELECT NEXTVAL('q') AS c") == [(50,)]
    with pytest.raises(ParseError):
        db.execute("CREATE FUNCTION bad(x INT) RETURNS INT AS BEGIN RETURN bad(x); END")
    with pytest.raises(EngineError):
        db.execute("CALL add2(1)")


def test_alter_and_metadata(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, a VARCHAR(5)); INSERT INTO t VALUES (1, 'x')")
    db.execute("ALTER TABLE t ADD COLUMN b INT DEFAULT 3; ALTER TABLE t RENAME COLUMN a TO c; ALTER TABLE t ALTER COLUMN b TYPE BIGINT; ALTER TABLE t ADD CONSTRAINT pos CHECK (b > 0); ALTER TABLE t ADD v AS (b + id)")
    assert all_of(db, "SELECT * FROM t") == [(1, "x", 3, 4)]
    with pytest.raises(ConstraintError):
        db.execute("UPDATE t SET b = 0")
    db.execute("ALTER TABLE t DROP CONSTRAINT pos; UPDATE t SET b = 0; ALTER TABLE t DROP COLUMN v; CREATE UNIQUE INDEX ux ON t (c) INCLUDE (b); ALTER TABLE t RENAME TO t2")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t2 VALUES (2, 'x', 1)")
    assert all_of(db, "SELECT column_name, data_type, is_nullable FROM INFORMATION_SCHEMA.COLUMNS ORDER BY ordinal_position") == [("b", "BIGINT", "YES"), ("c", "VARCHAR", "YES"), ("id", "INT", "NO")]
    assert all_of(db, "SELECT index_name, column_name, is_included FROM INFORMATION_SCHEMA.INDEXES") == [("ux", "b", "YES"), ("ux", "c", "NO")]
    assert all_of(db, "SELECT constraint_type FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS") == [("PRIMARY KEY",)]
    for name in ("TABLES", "KEY_COLUMN_USAGE", "REFERENTIAL_CONSTRAINTS", "VIEWS", "TRIGGERS", "TRIGGERED_UPDATE_COLUMNS", "ROUTINES", "PARAMETERS", "SEQUENCES"):
        db.query(f"SELECT * FROM INFORMATION_SCHEMA.{name}").collect()
    plan = db.execute("EXPLAIN QUERY PLAN SELECT * FROM t2 WHERE id = 3").rows()
    assert plan[0]["parent"] == 0 and "id" in plan[0]["detail"]
    db.execute("DROP INDEX ux; DROP TABLE t2; DROP TABLE IF EXISTS t2")


def test_bulk_prepared_dump(db, tmp_path):
    db.execute("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT, p INT REFERENCES p(id), t TEXT)")
    assert db.bulk_insert("p", [(1,), (2,)]) == 2
    assert db.bulk_insert("c", [{"id": 1, "p": 1, "t": "it's"}, {"id": 2, "p": 2, "t": None}]) == 2
    stmt = db.prepare("INSERT INTO c VALUES (?, ?, ?)")
    assert stmt.execute_batch([[3, 1, "x"], [4, 2, "y"]]) == 2
    assert db.prepare("UPDATE c SET t = @t WHERE id = @i").execute_batch([{"t": "q", "i": 3}, {"t": "r", "i": 4}]) == 2
    assert db.bulk_update("c", {"t": "'z'"}, "id = 1") == 1 and db.bulk_delete("c", "id = @i", {"i": 2}) == 1
    assert all_of(db, "SELECT id, t FROM c") == [(1, "z"), (3, "q"), (4, "r")]
    assert db.dump(f"file://{tmp_path}/dump") == ["p", "c"]
    lines = [r.value for r in db.spark.read.text(f"file://{tmp_path}/dump/001-c").collect()]
    other = Engine(db.spark, f"file://{tmp_path}/other")
    other.execute("CREATE TABLE c (id INT, p INT, t TEXT); " + " ".join(lines))
    assert all_of(other, "SELECT id, t FROM c") == [(1, "z"), (3, "q"), (4, "r")]


def test_text_against_typed_columns(db):
    db.execute("CREATE TABLE t (d DATETIME, n INT); INSERT INTO t VALUES (TIMESTAMP'2024-01-02 00:00:00', 5), (NULL, NULL)")
    assert db.compare("t", "n", "<>", "nope").count() == 1 and db.compare("t", "n", "=", "nope").count() == 0
    assert db.compare("t", "d", "=", "yesterday").count() == 0 and db.compare("t", "d", ">=", "2024-01-01").count() == 1


def test_parse_errors(db):
    for bad in ("SELEC 1", "SELECT", "SELECT nofn(1)", "SELECT 1 FROM (SELECT 2)", "INSERT t VALUES (1)", "SELECT ROW_NUMBER()", "WITH a AS (SELECT 1), a AS (SELECT 2) SELECT 1"):
        with pytest.raises(ParseError):
            db.execute(bad)


def test_key_value(spark, tmp_path):
    from tarnwick.sources.kv import KeyValue

    kv = KeyValue(spark, f"file://{tmp_path}/kv")
    rows = lambda *x: spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in x], "key binary, value binary")
    kv.apply(rows((b"a", b"1"), (b"b", b"2"), (b"c", b"3")))
    kv.apply(rows((b"b", b"20")), spark.createDataFrame([(bytearray(b"c"),)], "key binary"))
    assert kv.get(b"b") == b"20" and kv.get(b"c") is None and kv.get(b"b", as_of=1) == b"2"
    assert [bytes(r.key) for r in kv.scan(b"a", b"b").collect()] == [b"a"] and [bytes(r.key) for r in kv.scan(as_of=1).collect()] == [b"a", b"b", b"c"]


def test_files(spark, tmp_path):
    from tarnwick.sources import files

    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], "k int, t string")
    files.export_csv(df, f"file://{tmp_path}/c")
    files.export_json(df, f"file://{tmp_path}/j")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(files.import_csv(spark, f"file://{tmp_path}/c", "k int, t string", line_breaks=True)) == key(df)
    assert key(files.import_json(spark, f"file://{tmp_path}/j", "k int, t string", lines=True)) == key(df)
    assert files.preview(df, 1) == [{"k": 1, "t": 'a "q", b\nc'}]


def parts_of(db, table):
    return db.catalog.parts(db.catalog.get("tables", table))


def test_changes_write_only_what_they_touch(db, monkeypatch):
    from tarnwick import catalog

    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v TEXT)")
    db.bulk_insert("t", db.spark.range(0, 1000, 1, 4).selectExpr("cast(id as int) AS k", "'a' AS v"))
    first = parts_of(db, "t")
    db.execute("INSERT INTO t VALUES (2000, 'b')")
    added = parts_of(db, "t")
    assert added[:-1] == first and len(added) == 2 and len([n for n in db.catalog.files.names(added[1]["path"]) if n.endswith(".parquet")]) == 1
    files = [n for n in db.catalog.files.names(first[0]["path"]) if n.endswith(".parquet")]
    db.execute("DELETE FROM t WHERE k = 3; UPDATE t SET v = 'c' WHERE k = 4")
    kept = parts_of(db, "t")[0]["files"]
    assert len(files) == 4 and len(kept) == 3 and set(kept) < set(files)
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (5, 'again')")
    assert db.query("SELECT COUNT(*), SUM(k) FROM t").first()[:] == (1000, sum(range(1000)) - 3 + 2000)
    monkeypatch.setattr(catalog, "FAN", 4)
    for i in range(9):
        db.execute(f"INSERT INTO t VALUES ({3000 + i}, 'd')")
    assert len(parts_of(db, "t")) < 9 and db.query("SELECT COUNT(*) FROM t").first()[0] == 1009


def test_two_sessions_do_not_overwrite_each_other(db):
    db.execute("CREATE TABLE t (x INT)")
    other = Engine(db.spark, db.catalog.root)
    db.execute("BEGIN; INSERT INTO t VALUES (1)")
    other.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(ConflictError):
        db.execute("COMMIT")
    assert all_of(db, "SELECT x FROM t") == [(2,)]
    db.execute("INSERT INTO t VALUES (1)")
    assert all_of(other, "SELECT x FROM t") == [(1,), (2,)]


def test_a_crash_between_steps_loses_nothing(db, monkeypatch):
    db.execute("CREATE TABLE t (x INT); INSERT INTO t VALUES (1)")
    root, files = db.catalog.root, db.catalog.files
    for step in ("write_new", "_part"):
        with monkeypatch.context() as m:
            def broken(*a, **b):
                raise RuntimeError("lost")

            m.setattr(files if step == "write_new" else db.catalog, step, broken)
            with pytest.raises(RuntimeError):
                db.execute("INSERT INTO t VALUES (2)")
        again = Engine(db.spark, root)
        assert all_of(again, "SELECT x FROM t") == [(1,)]
        db = again
        files = db.catalog.files
    files.delete(f"{root}/catalog")
    with pytest.raises(EngineError):
        Engine(db.spark, root)


def test_statements_leave_no_temporary_folders(db):
    db.execute(USERS + "; INSERT INTO users (name) VALUES ('a'), ('b'); UPDATE users SET score = 1; DELETE FROM users WHERE name = 'a'")
    assert not [n for n in db.catalog.files.names(db.catalog.root) if n.startswith("tmp-")]
