import http.server
import io
import json
import logging
import sqlite3
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from sparkferry.plans import log, runner, serve
from sparkferry.plans.config import Config, vault
from sparkferry.plans.model import Column, Table
from sparkferry.sources.sqlite_catalog import index_columns
from sparkferry.sources.stores import JdbcStore, ParquetStore, SqliteStore, open_store, switched_off, upsert_sql, with_retries
from sparkferry.streaming.upserts import merge_stream


@pytest.fixture
def shop(tmp_path):
    path = str(tmp_path / "shop.db")
    with sqlite3.connect(path) as c:
        c.executescript(
            """create table users (id integer primary key autoincrement, name varchar(20) not null collate nocase, live boolean default 1, pay decimal(10,2), pic blob, unique(name));
            create table orders (id integer, line integer, user_id int references users(id) on delete cascade, note text default 'a,b', total real generated always as (line * 2.5) stored, check (line > 0), primary key (line, id));
            create index ix_note on orders (note desc, user_id);
            create table empty (x int);
            create table fixed (k text primary key, v int) without rowid;"""
        )
        c.executemany("insert into users values (?,?,?,?,?)", [(1, "Ann", 1, 1.5, b"\x00\xff"), (2, "Bob", 0, None, None), (3, "Cy", None, "x", b"")])
        c.executemany("insert into orders (id, line, user_id, note) values (?,?,?,?)", [(1, 1, 1, "n"), (1, 2, 2, None), (2, 1, 9, "orphan")])
        c.execute("insert into fixed values ('a', 1)")
    return path


def test_sqlite_catalog(spark, shop):
    store = SqliteStore(spark, shop, rows=2)
    assert store.tables() == ["empty", "fixed", "orders", "users"]
    users, orders = store.describe("users"), store.describe("orders")
    assert [c.name for c in users.columns if c.auto_increment] == ["id"] and users.columns[1].collation == "nocase"
    assert orders.key == ["line", "id"] and orders.columns[4].generated == "line * 2.5"
    kinds = {c.kind: c for c in orders.constraints}
    assert kinds["FOREIGN KEY"].to_table == "users" and kinds["FOREIGN KEY"].on_delete == "CASCADE"
    assert kinds["CHECK"].definition == "line > 0" and orders.indexes[0].columns == ("note", "user_id")
    assert any(c.kind == "UNIQUE" and c.columns == ("name",) for c in users.constraints)
    assert store.describe("nothing") is None
    assert index_columns('CREATE INDEX i ON t USING btree (lower(a), "B c" DESC NULLS LAST, d text_ops)') == ("lower(a)", "B c", "d")


def test_sqlite_rows(spark, shop):
    store = SqliteStore(spark, shop, rows=2)
    got = {r.id: r for r in store.read("users").collect()}
    assert bytes(got[1].pic) == b"\x00\xff" and str(got[1].pay) == "1.50" and got[2].pay is None and got[3].pay is None and got[1].live is None or got[1].live is True
    assert store.read("orders").count() == 3 and store.read("empty").count() == 0 and store.read("fixed").count() == 1


def test_run_creates_then_alters(spark, shop, tmp_path):
    source = SqliteStore(spark, shop)
    destination = ParquetStore(spark, str(tmp_path / "out"))
    config = Config(source="sqlite", destination="postgres", retries=0, workers=2)
    results = {r.table: r for r in runner.run(source, destination, config)}
    assert results["users"].status == "ok" and results["users"].rows == 3, results["users"]
    assert results["orders"].status == "constraint_failed" and "1 rows without users" in results["orders"].constraint_error
    assert runner.exit_code(list(results.values())) == 2
    with sqlite3.connect(shop) as c:
        c.execute("update users set name = 'Anna' where id = 1")
        c.execute("delete from users where id = 2")
    again = runner.run(source, destination, config.with_(strategy="alter", validate=False), ["users"])
    assert again[0].status == "ok"
    assert sorted(r.name for r in destination.read("users").collect()) == ["Anna", "Bob", "Cy"]
    frame = runner.results_frame(spark, list(results.values()))
    assert frame.count() == 4 and runner.exit_code_frame(frame).first()[0] == 2


def test_failures_are_results(spark, shop, tmp_path):
    class Broken(SqliteStore):
        def read(self, name):
            if name == "users":
                raise OSError("gone")
            return super().read(name)

    destination, waits = ParquetStore(spark, str(tmp_path / "out")), []
    config = Config(source="sqlite", destination="postgres", retries=2, retry_interval=7)
    results = {r.table: r for r in runner.run(Broken(spark, shop), destination, config, sleep=waits.append)}
    assert results["users"].data_error == "gone" and waits == [7, 7]
    assert results["orders"].skipped and results["empty"].status == "ok" and runner.exit_code(list(results.values())) == 1
    both = {r.table: r for r in runner.run(Broken(spark, shop), destination, config.with_(skip_failed_tables=True), sleep=waits.append)}
    assert both["orders"].rows == 3


def test_deadline(spark, shop, tmp_path):
    ticks = iter(range(0, 10_000, 200))
    out = runner.run(SqliteStore(spark, shop), ParquetStore(spark, str(tmp_path / "out")), Config(source="sqlite", destination="postgres", retries=0, table_timeout=100), ["empty"], clock=lambda: next(ticks))
    assert "more than 100 s" in (out[0].schema_error or out[0].data_error)


def test_retries():
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "done"

    assert with_retries(work, 3, 0, lambda _: None) == "done" and len(tries) == 3
    with pytest.raises(OSError):
        with_retries(lambda: (_ for _ in ()).throw(OSError("never")), 1, 0, lambda _: None)


def test_a_write_may_read_what_it_replaces(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "out"))
    store.write("t", spark.range(5))
    store.write("t", store.read("t").withColumn("id", F.col("id") + 1))
    assert sorted(r.id for r in store.read("t").collect()) == [1, 2, 3, 4, 5]
    store.drop("t")
    assert store.tables() == []


def test_jdbc_with_the_bundled_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    store = JdbcStore(spark, url, "derby", options)
    store.write("NUMBERS", spark.range(100).withColumnRenamed("id", "N"), "overwrite")
    assert "NUMBERS" in store.tables()
    assert store.read("NUMBERS", by="N").count() == 100


def test_stream_of_changes(spark, tmp_path):
    folder = str(tmp_path / "changes")
    store = ParquetStore(spark, str(tmp_path / "out"))
    put = lambda rows: spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.mode("append").parquet(folder)
    put([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    stream = spark.readStream.schema("k int, at int, v string").parquet(folder)
    run = lambda: merge_stream(stream, store, "t", ["k"], [F.col("at")], str(tmp_path / "check"), buckets=4).awaitTermination()
    run()
    first = store._parts("t")
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(1, "b"), (2, "c")] and len(first) == 4
    put([(2, 5, "d"), (2, 4, "x")])
    run()
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(1, "b"), (2, "d")]
    assert sum(store._parts("t")[k] != first[k] for k in range(4)) == 1  # one bucket only is written again
    store.vacuum("t")
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(1, "b"), (2, "d")]
    store.write("u", spark.createDataFrame([(i, 0, "old") for i in range(20)], "k int, at int, v string"))
    store.merge_buckets("u", spark.createDataFrame([(3, 1, "new"), (99, 1, "new")], "k int, at int, v string"), ["k"], 4)
    assert sorted(r.k for r in store.read("u").where("v = 'new'").collect()) == [3, 99] and store.read("u").count() == 21


def test_versions_of_a_table(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "out"))
    for n in (3, 4):
        store.write("t", spark.range(n))
    folder = tmp_path / "out" / "t.parquet"
    spark.range(9).write.parquet(str(folder / "v000000000003-broken"))  # a writer died before its marker
    assert store.read("t").count() == 4
    store.write("t", spark.range(6))
    assert store.read("t").count() == 6
    store.vacuum("t")
    assert len([x for x in folder.iterdir() if x.is_dir()]) == 1 and store.read("t").count() == 6
    spark.range(9).write.parquet(str(tmp_path / "out" / "u.parquet" / "v000000000001-broken"))
    assert store.tables() == ["t"] and store.describe("u") is None


@pytest.fixture
def copy(tmp_path):
    path = str(tmp_path / "copy.db")
    sqlite3.connect(path).close()
    return path


def all_rows(path, sql):
    with sqlite3.connect(path) as c:
        return c.execute(sql).fetchall()


def test_database_to_database(spark, shop, copy):
    source, destination = SqliteStore(spark, shop), SqliteStore(spark, copy)
    config = Config(source="sqlite", destination="sqlite", retries=0, workers=1)
    results = {r.table: r for r in runner.run(source, destination, config)}
    assert {n: (r.status, r.rows) for n, r in results.items()} == {"users": ("ok", 3), "orders": ("ok", 3), "empty": ("ok", 0), "fixed": ("ok", 1)}, results
    for table in ("id, line, user_id, note, total from orders", "id, name, live, pic from users", "* from fixed"):
        assert sorted(all_rows(copy, f"select {table}"), key=repr) == sorted(all_rows(shop, f"select {table}"), key=repr)
    made = destination.describe("orders")
    assert made.key == ["line", "id"] and {c.kind for c in made.constraints} >= {"CHECK", "FOREIGN KEY", "PRIMARY KEY"} and [i.name for i in made.indexes if not i.primary] == ["ix_note"]
    with sqlite3.connect(shop) as c:  # a new column, a changed row, a row that goes, a new row
        c.execute("alter table users add column city text default 'none'")
        c.execute("update users set name = 'Anna', city = 'Rome' where id = 1")
        c.execute("delete from users where id = 2")
        c.execute("insert into users (id, name) values (7, 'Di')")
    for _ in range(2):
        again = runner.run(source, destination, config.with_(strategy="alter"), ["users"])[0]
        assert again.status == "ok" and again.rows == 3, again
        assert all_rows(copy, "select id, name, city from users order by id") == [(1, "Anna", "Rome"), (2, "Bob", "none"), (3, "Cy", "none"), (7, "Di", "none")]
    fresh = {r.table: r.status for r in runner.run(source, destination, config)}
    assert set(fresh.values()) == {"ok"} and len(all_rows(copy, "select * from users")) == 3


def test_a_failed_write_leaves_the_table(spark, copy):
    with sqlite3.connect(copy) as c:
        c.execute("create table t (k integer primary key, v text not null)")
        c.execute("insert into t values (1, 'old')")
    store = SqliteStore(spark, copy)
    with pytest.raises(sqlite3.IntegrityError):
        store.save("t", spark.createDataFrame([(1, "new"), (2, None)], "k long, v string"), ["k"], store.describe("t"))
    assert all_rows(copy, "select * from t") == [(1, "old")]
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(500)], "k long, v string").repartition(3)
    assert store.save("t", rows, ["k"], store.describe("t")) == 500 and all_rows(copy, "select count(*), min(v) from t") == [(500, "v0")]


def test_jdbc_upsert_with_the_bundled_database(spark, tmp_path):
    store = JdbcStore(spark, f"jdbc:derby:{tmp_path}/up;create=true", "derby", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, partitions=2)
    with store.session() as run:
        run('create table "t" ("k" bigint primary key, "v" varchar(20), "kept" int default 5)')
        run("""insert into "t" values (1, 'old', 9), (2, 'two', 9)""")
    t = Table("t", "derby", (Column("k", "bigint", False, True),))
    assert store.save("t", spark.createDataFrame([(1, "new"), (3, "three")], "k long, v string"), ["k"], t) == 2
    got = lambda: sorted(map(tuple, store.read("t").collect()))
    assert got() == [(1, "new", 9), (2, "two", 9), (3, "three", 5)]
    assert store.save("t", spark.createDataFrame([(3,), (4,)], "k long"), ["k"], t) == 2 and got()[2:] == [(3, "three", 5), (4, None, 5)]
    assert store.save("t", spark.createDataFrame([(8, "x")], "k long, v string"), ["k"], t, replace=True) == 1 and got() == [(8, "x", 5)]
    with pytest.raises(Exception):
        store.save("t", spark.createDataFrame([(9, "y"), (9, "z")], "k long, v string"), [], t)
    assert got() == [(8, "x", 5)] and not [n for n in store.tables() if "stage" in n]


def test_upsert_statements():
    assert upsert_sql("t", "s", ["a", "b"], ["a"], "mysql") == "INSERT INTO `t` (`a`, `b`) SELECT `a`, `b` FROM `s` ON DUPLICATE KEY UPDATE `b` = VALUES(`b`)"
    assert upsert_sql("t", "s", ["a"], ["a"], "mysql") == "INSERT IGNORE INTO `t` (`a`) SELECT `a` FROM `s`"
    assert upsert_sql("t", "s", ["a", "b"], ["a"], "postgres") == 'INSERT INTO "t" ("a", "b") SELECT "a", "b" FROM "s" WHERE true ON CONFLICT ("a") DO UPDATE SET "b" = EXCLUDED."b"'
    assert upsert_sql("t", "s", ["a"], ["a"], "postgres").endswith('ON CONFLICT ("a") DO NOTHING') and upsert_sql("t", "s", ["a"], [], "postgres") == 'INSERT INTO "t" ("a") SELECT "a" FROM "s"'


@pytest.mark.parametrize("dialect,before,steps", [("mysql", "1", ["SET SESSION foreign_key_checks = 0", "in", "SET SESSION foreign_key_checks = 1"]), ("postgres", None, ["SET session_replication_role = replica", "in", "SET session_replication_role = origin"]), ("derby", None, ["in"])])
def test_foreign_keys_are_off_and_on_again(dialect, before, steps):
    said = []
    with pytest.raises(KeyError), switched_off(lambda _: before, said.append, dialect):
        said.append("in")
        raise KeyError
    assert said == steps


def test_unfit_rows(spark, tmp_path):
    path = str(tmp_path / "odd.db")
    with sqlite3.connect(path) as c:
        c.execute("create table flags (k integer primary key, f text)")
        c.executemany("insert into flags values (?, ?)", [(1, "yes"), (2, "maybe"), (3, None), (4, "\toff\n")])
    source, config = SqliteStore(spark, path), Config(source="sqlite", destination="postgres", retries=0, validate=False)
    spec = source.describe("flags")
    types = runner.TypeMap({("sqlite", "postgres"): [(("text",), "BOOLEAN", "ignore_source"), (("integer",), "BIGINT", "ignore_source")]}, {}, {})

    def sync(how):
        store = ParquetStore(spark, str(tmp_path / how))
        out, _ = runner.sync_table(source, store, spec, config.with_(unfit=how), types=types)
        return out, {n: sorted(map(tuple, store.read(n).collect()), key=repr) for n in store.tables()}

    out, tables = sync("fail")
    assert out.status == "failed" and "1 rows of flags" in out.data_error and out.unfit == 1 and tables == {}
    out, tables = sync("quarantine")
    assert (out.status, out.rows, out.unfit) == ("ok", 3, 1) and tables == {"flags": [(1, True), (3, None), (4, False)], "flags__unfit": [(2, "maybe")]}
    out, tables = sync("null")
    assert out.rows == 4 and tables["flags"][1] == (2, None)


def test_cancellation(spark, shop, tmp_path):
    stop, destination = threading.Event(), ParquetStore(spark, str(tmp_path / "out"))
    stop.set()
    results = runner.run(SqliteStore(spark, shop), destination, Config(source="sqlite", destination="postgres"), stop=stop)
    assert {r.status for r in results} == {"failed"} and all(r.skipped == "cancelled before it began" for r in results) and runner.exit_code(results) == 1

    class Slow(ParquetStore):
        def save(self, name, rows, *rest, **more):
            seen.append(True)
            return super().save(name, rows.withColumn("__slow", F.expr("reflect('java.lang.Thread', 'sleep', 20000L)")), *rest, **more)

    stop, seen, began = threading.Event(), [], time.monotonic()
    threading.Timer(1.0, stop.set).start()
    out = runner.run(SqliteStore(spark, shop), Slow(spark, str(tmp_path / "slow")), Config(source="sqlite", destination="postgres", retries=0), ["fixed"], stop=stop)[0]
    assert "cancelled" in (out.data_error or out.schema_error) and time.monotonic() - began < 15
    out = runner.run(SqliteStore(spark, shop), Slow(spark, str(tmp_path / "late")), Config(source="sqlite", destination="postgres", retries=0, table_timeout=3), ["fixed"])[0]
    assert "more than 3 s" in (out.data_error or out.schema_error)


def test_log_lines_hold_no_secrets():
    out = io.StringIO()
    top = logging.getLogger("sparkferry")
    before = top.handlers[:], top.level, top.propagate
    try:
        log.configure(as_json=True, words=("hunter2",), stream=out)
        log.logger("run").info("jdbc:mysql://h/d?user=u&password=abc;x postgres://bob:pw@h/d said hunter2", extra={"table": "t", "token": "zzz", "rows": 3})
        log.configure(stream=out)
        log.logger("run").info("plain", extra={"table": "t"})
    finally:
        top.handlers[:], top.propagate = before[0], before[2]
        top.setLevel(before[1])
    first, second = out.getvalue().splitlines()
    row = json.loads(first)
    assert row["level"] == "INFO" and row["rows"] == 3 and row["token"] == "***" and "u&password=***" in row["msg"] and "bob:***@h" in row["msg"]
    assert not any(x in first for x in ("abc", "pw@", "hunter2", "zzz")) and second.endswith("sparkferry.run plain table=t")


def test_http():
    ready = [False]
    server = serve.serve(0, lambda: "sparkferry_run_seconds 1\n", lambda: ready[0], "127.0.0.1")
    ask = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=5).read().decode()
    assert ask("/metrics") == "sparkferry_run_seconds 1\n" and ask("/healthz") == "ok"
    for path, status in (("/readyz", 503), ("/nothing", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(path)
        assert e.value.code == status
    ready[0] = True
    assert ask("/readyz") == "ok"
    server.shutdown()


def test_vault():
    class Vault(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            found = {"/v1/secret/data/db/src": {"data": {"data": {"username": "u", "password": "p"}}}, "/v1/secret/data/bare": {"data": {"data": {"pass": "q"}}}}.get(self.path)
            status = 403 if self.headers["X-Vault-Token"] != "t0k" else 200 if found else 404
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(found).encode() if status == 200 else b"{}")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Vault)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at, paths = f"http://127.0.0.1:{server.server_port}/", {"SRC": "/db/src", "DST": "gone", "BARE": "bare"}
    look = vault(at, "t0k", paths)
    assert look("SRC") == ("u", "p") and look("OTHER") is None and vault(at, "t0k", paths, password_key="pass")("BARE") == ("", "q")
    for label, said in (("DST", "is not there"), ("BARE", "has no text")):
        with pytest.raises(ValueError, match=said):
            look(label)
    with pytest.raises(ValueError, match="status 403") as e:
        vault(at, "wrong", paths)("SRC")
    assert "wrong" not in str(e.value)
    server.shutdown()


def test_open_store(spark, shop, tmp_path):
    assert open_store(spark, "sqlite", shop).ping() and open_store(spark, "parquet", str(tmp_path)).tables() == []
    jdbc = open_store(spark, "postgres", "jdbc:postgresql://h/d", "u", "p", pool=4)
    assert jdbc.partitions == 4 and jdbc.options == {"user": "u", "password": "p", "stringtype": "unspecified"}


def test_command_line(shop, copy, capsys, spark):
    from sparkferry.__main__ import main

    env = {"SYNC_DIRECTION": "sqlite-to-sqlite", "DST_URL": copy, "RETRIES": "0"}
    assert main(["--source", shop, "--tables", "users,fixed,none", "--workers", "1", "--metrics-port", "0"], env) == 0
    assert capsys.readouterr().out.splitlines() == ["fixed\tok\t1\t", "none\tskipped\t0\tno such table", "users\tok\t3\t"]
    assert all_rows(copy, "select count(*) from users") == [(3,)]
    assert main(["--direction", "mysql-to-postgres", "--source", "jdbc:x", "--destination", "jdbc:y"], {"RETRIES": "0"}) == 1
    with pytest.raises(SystemExit):
        main([], {"SYNC_DIRECTION": "sqlite-to-sqlite"})


def test_progress_is_logged(spark, shop, tmp_path, monkeypatch, caplog):
    monkeypatch.setattr(runner, "PROGRESS", 0.3)
    monkeypatch.setattr(logging.getLogger("sparkferry"), "propagate", True)
    with caplog.at_level(logging.INFO, "sparkferry"), runner.jobs_of(spark, "t", 60, threading.Event()):
        spark.range(2).select(F.expr("reflect('java.lang.Thread', 'sleep', 1500L)")).write.format("noop").mode("overwrite").save()
    assert any(r.msg == "progress" and r.table == "t" for r in caplog.records)
