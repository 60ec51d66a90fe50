"""Where tables are read from and written to: folders of Parquet, JDBC databases and SQLite files."""

from __future__ import annotations

import json
import re
import sqlite3
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkferry.functions.names import is_system_table, quote
from sparkferry.operators import merge
from sparkferry.plans.execute import execute
from sparkferry.plans.model import Column, Table
from sparkferry.sources import jdbc_catalog, sqlite_catalog


def with_retries(work: Callable, retries: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep):
    """What work returns, tried up to retries + 1 times with a fixed wait; the last error is raised."""
    for k in range(retries + 1):
        try:
            return work()
        except Exception:
            if k == retries:
                raise
            sleep(wait)


class Store(ABC):
    dialect = "spark"

    @abstractmethod
    def tables(self) -> list[str]:
        """Base tables by name."""

    @abstractmethod
    def read(self, name: str) -> DataFrame: ...

    @abstractmethod
    def describe(self, name: str) -> Table | None:
        """The table's catalog entry; None for a table that isn't there."""

    def ping(self) -> bool:
        self.tables()
        return True

    def count(self, name: str) -> int:
        return self.read(name).count()

    #: Whether statements that change tables run here; a store without them takes its schema from the rows.
    executes = False

    def execute(self, statements: list) -> int:
        """Runs typed statements in their order, in one transaction where the database has it; the number that did something."""
        raise TypeError(f"{type(self).__name__} runs no statements")

    def save(self, name: str, rows: DataFrame, key: list[str], have: Table | None, replace: bool = False) -> int:
        """Writes rows: all anew (`replace`, or without a table), merged by key, or appended without a key. Returns how many rows there were."""
        raise TypeError(f"{type(self).__name__} is read only")


class Counted:
    """rows that count themselves while they are written, so that a source is read once."""

    def __init__(self, rows: DataFrame):
        self.seen = Observation()
        self.plain, self.rows = rows, rows.observe(self.seen, F.count(F.lit(1)).alias("n"))

    def n(self) -> int:
        """To be asked after the write. A plan that needn't run the rows (an empty side, say) has counted nothing."""
        got = self.seen.get
        return got["n"] if "n" in got else self.plain.count()


#: How the files begin that mark whole versions; Spark's readers pass over such names.
MARKER = "_whole-"
#: Spark types as the dialect of Parquet stores writes them.
SPARK_NAMES = {"string": "text", "long": "bigint", "integer": "int", "short": "smallint", "byte": "tinyint", "double": "double", "float": "float", "boolean": "boolean", "binary": "bytea", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp"}


def open_store(spark: SparkSession, dialect: str, where: str, user: str = "", password: str = "", pool: int = 20) -> Store:
    """The store of a dialect: a SQLite file, a database by its JDBC url, or (`parquet`) a folder. pool bounds the connections of a read or write."""
    if dialect == "parquet":
        return ParquetStore(spark, where)
    if dialect == "sqlite":
        return SqliteStore(spark, where)
    options = {"user": user, "password": password} if user or password else {}
    return JdbcStore(spark, where, dialect, options | ({"stringtype": "unspecified"} if dialect == "postgres" else {}), partitions=pool)


class ParquetStore(Store):
    """A folder with a subfolder or file `name.parquet` for each table.

    A written table is a folder of numbered versions, each with an empty marker file that is made when the version is whole. The
    highest marker counts; making one file is atomic wherever the folder lies, so readers see one version or the other, a
    crash leaves the last one, and a write may read the table that it replaces.
    """

    dialect = "postgres"

    def __init__(self, spark: SparkSession, folder: str, specs: dict[str, Table] | None = None):
        self.spark, self.folder, self.specs = spark, folder.rstrip("/"), specs or {}

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def tables(self) -> list[str]:
        p, fs = self._fs(self.folder)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        return sorted(n.removesuffix(".parquet") for n in names if self._path(n.removesuffix(".parquet")))

    def _listed(self, name: str) -> list[str]:
        p, fs = self._fs(f"{self.folder}/{name}.parquet")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) and fs.getFileStatus(p).isDirectory() else []

    def _path(self, name: str) -> str | None:
        """Where the table's rows lie: its highest whole version, or the file or folder itself if it has no versions; None if none is whole."""
        top, listed = f"{self.folder}/{name}.parquet", self._listed(name)
        whole = max((n for n in listed if n.startswith(MARKER)), default=None)
        if whole:
            return f"{top}/v{whole.removeprefix(MARKER)}"
        return None if any(re.match(r"v\d", n) for n in listed) else top

    def _parts(self, name: str) -> dict[int, str]:
        """For a table in buckets: each bucket's folder, as its marker lists them. Others have none."""
        path = self._path(name)
        if path is None or "/v" not in path.removeprefix(self.folder):
            return {}
        top, _, version = path.rpartition("/v")
        marker, fs = self._fs(f"{top}/{MARKER}{version}")
        stream = fs.open(marker)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): f"{top}/{v}" for k, v in json.loads(text or "{}").items()}

    def read(self, name: str) -> DataFrame:
        parts = self._parts(name)
        return self.spark.read.parquet(*(parts.values() if parts else [self._path(name)]))

    def describe(self, name: str) -> Table | None:
        if name in self.specs:
            return self.specs[name]
        if name not in self.tables():
            return None
        fields = self.read(name).schema.fields
        return Table(name, self.dialect, tuple(Column(f.name, SPARK_NAMES.get(f.dataType.typeName(), f.dataType.simpleString()), f.nullable, ordinal=i) for i, f in enumerate(fields)))

    def _version(self, name: str) -> str:
        return f"{max((int(m[1]) for n in self._listed(name) if (m := re.match(r'v(\d+)', n))), default=0) + 1:012d}-{uuid.uuid4().hex}"

    def _publish(self, name: str, version: str, parts: dict[int, str]) -> None:
        """Makes a version count, by a marker file that is whole when it gets its name."""
        top = f"{self.folder}/{name}.parquet"
        marker, fs = self._fs(f"{top}/{MARKER}{version}")
        draft, _ = self._fs(f"{top}/_draft-{version}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(parts).encode() if parts else b""))
        out.close()
        fs.rename(draft, marker)

    def write(self, name: str, df: DataFrame) -> None:
        version = self._version(name)
        df.write.parquet(f"{self.folder}/{name}.parquet/v{version}")
        self._publish(name, version, {})

    def merge_buckets(self, name: str, rows: DataFrame, key: list[str], buckets: int = 64) -> None:
        """Upserts rows, unique by key, into a table that is kept in buckets of its key's hash: only buckets that the rows fall into are
        read and written again. A table that isn't there, or not in so many buckets, is first written in full."""
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(buckets)).cast("int")
        top, parts, version = f"{self.folder}/{name}.parquet", self._parts(name), self._version(name)
        rows = rows.withColumn("__bucket", bucket)
        touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
        if name in self.tables() and len(parts) != buckets:
            old, parts, touched = self.read(name), {}, list(range(buckets))
        elif found := [parts[k] for k in touched if k in parts]:
            old = self.spark.read.parquet(*found)
        else:
            old = rows.drop("__bucket").limit(0)
        merged = merge.upsert(old, rows.drop("__bucket"), key).withColumn("__bucket", bucket)
        merged.repartition(F.col("__bucket")).write.partitionBy("__bucket").parquet(f"{top}/v{version}")
        p, fs = self._fs(f"{top}/v{version}")
        written = {int(m[1]) for s in fs.listStatus(p) if (m := re.fullmatch(r"__bucket=(\d+)", s.getPath().getName()))}
        for k in set(range(buckets)) - written - set(parts):  # empty ones too, so that all are listed
            merged.drop("__bucket").limit(0).write.parquet(f"{top}/v{version}/__bucket={k}")
            written.add(k)
        kept = {k: path.removeprefix(f"{top}/") for k, path in parts.items()}
        self._publish(name, version, kept | {k: f"v{version}/__bucket={k}" for k in written})

    def vacuum(self, name: str) -> None:
        """Deletes all versions but the one that counts; no reader of them, and no writer, may be left."""
        now = (self._path(name) or "").rpartition("/v")[2]
        used = {path.split("/")[-2] for path in self._parts(name).values()}
        for n in self._listed(name):
            if re.match(rf"(v|{MARKER}|_draft-)\d", n) and not n.endswith(now) and n not in used:
                p, fs = self._fs(f"{self.folder}/{name}.parquet/{n}")
                fs.delete(p, True)

    def save(self, name: str, rows: DataFrame, key: list[str], have: Table | None, replace: bool = False) -> int:
        counted = Counted(rows)
        self.write(name, counted.rows if replace or have is None else merge.upsert(self.read(name), counted.rows, key))
        return counted.n()

    def drop(self, name: str) -> None:
        p, fs = self._fs(f"{self.folder}/{name}.parquet")
        fs.delete(p, True)


class JdbcStore(Store):
    """A database by JDBC; its driver must be on Spark's class path. Reads are split by the given column's range; Spark pushes filters, columns and top-k down."""

    def __init__(self, spark: SparkSession, url: str, dialect: str, options: dict[str, str] | None = None, partitions: int = 8):
        self.spark, self.url, self.dialect, self.options, self.partitions = spark, url, dialect, options or {}, partitions

    #: The query for base tables of the current schema.
    LISTS = {
        "mysql": "select table_name as name from information_schema.tables where table_schema = database() and table_type = 'BASE TABLE'",
        "postgres": "select table_name as name from information_schema.tables where table_schema = current_schema() and table_type = 'BASE TABLE'",
        "sqlite": "select name from sqlite_master where type = 'table'",
        "derby": "select tablename as name from sys.systables where tabletype = 'T'",
    }

    def _load(self, **more: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, **self.options, **more).load()

    def tables(self) -> list[str]:
        names = [r[0] for r in self._load(query=self.LISTS[self.dialect]).collect()]
        return sorted(n for n in names if not is_system_table(n, self.dialect))

    def read(self, name: str, by: str | None = None) -> DataFrame:
        if by is None:
            return self._load(dbtable=quote(name, self.dialect))
        low, high = self._load(dbtable=quote(name, self.dialect)).agg(F.min(by), F.max(by)).first()
        if low is None:
            return self._load(dbtable=quote(name, self.dialect))
        return self._load(dbtable=quote(name, self.dialect), partitionColumn=by, lowerBound=str(low), upperBound=str(high), numPartitions=str(self.partitions))

    def describe(self, name: str) -> Table | None:
        if self.dialect in jdbc_catalog.COLUMNS:
            return jdbc_catalog.describe(lambda sql: [r.asDict() for r in self._load(query=sql).collect()], name, self.dialect)
        if name not in self.tables():
            return None
        fields = self._load(dbtable=quote(name, self.dialect)).schema.fields
        return Table(name, self.dialect, tuple(Column(f.name, SPARK_NAMES.get(f.dataType.typeName(), f.dataType.simpleString()), f.nullable, ordinal=i) for i, f in enumerate(fields)))

    def write(self, name: str, df: DataFrame, mode: str = "append") -> None:
        df.write.format("jdbc").options(url=self.url, dbtable=quote(name, self.dialect), numPartitions=str(self.partitions), **self.options).mode(mode).save()

    executes = True

    def _connection(self):
        """One of the driver's own, by Spark's way of finding the database's driver class."""
        jvm = self.spark.sparkContext._jvm
        options = jvm.java.util.HashMap()
        for k, v in {"url": self.url, "dbtable": "none", **self.options}.items():
            options.put(k, v)
        made = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(jvm.PythonUtils.toScalaMap(options))
        return jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).createConnectionFactory(made).apply(-1)

    @contextmanager
    def session(self, keys_off: bool = False):
        """A function that runs SQL, within one transaction; foreign keys and triggers are off in it if `keys_off`, and as before after it."""
        c = self._connection()

        def ask(sql: str) -> str | None:
            s = c.createStatement()
            try:
                found = s.executeQuery(sql)
                return found.getString(1) if found.next() else None
            finally:
                s.close()

        def run(sql: str) -> int:
            s = c.createStatement()
            try:
                return s.executeUpdate(sql)
            finally:
                s.close()

        try:
            with switched_off(ask, run, self.dialect if keys_off else ""):
                c.setAutoCommit(False)
                try:
                    yield run
                    c.commit()
                except BaseException:
                    c.rollback()
                    raise
                finally:
                    c.setAutoCommit(True)
        finally:
            c.close()

    def execute(self, statements: list) -> int:
        with self.session() as run:
            return execute(statements, run, self.dialect)

    def save(self, name: str, rows: DataFrame, key: list[str], have: Table | None, replace: bool = False) -> int:
        """Rows are written by all executors to a staging table of the table's own types, then merged by one statement in one transaction."""
        stage = f"{name[:40]}_stage_{uuid.uuid4().hex[:12]}"
        listed = ", ".join(quote(c, self.dialect) for c in rows.columns)
        with self.session() as run:
            run(f"CREATE TABLE {quote(stage, self.dialect)} AS SELECT {listed} FROM {quote(name, self.dialect)} {'WITH NO DATA' if self.dialect == 'derby' else 'WHERE 1 = 0'}")
        try:
            self.write(stage, rows)
            n = int(self._load(query=f"SELECT count(*) AS n FROM {quote(stage, self.dialect)}").first()[0])
            with self.session(keys_off=True) as run:
                if replace:
                    run(f"DELETE FROM {quote(name, self.dialect)}")
                run(upsert_sql(name, stage, rows.columns, [] if replace else key, self.dialect))
        finally:
            with self.session() as run:
                run(f"DROP TABLE {quote(stage, self.dialect)}")
        return n


# Each database's own switch for foreign keys and triggers of a session, as the question, the answer to assume where it can't be asked, and the statement.
SWITCHES = {
    "mysql": ("SELECT @@SESSION.foreign_key_checks", "1", "SET SESSION foreign_key_checks = {0}", "0"),
    "postgres": ("SHOW session_replication_role", "origin", "SET session_replication_role = {0}", "replica"),
    "sqlite": ("PRAGMA foreign_keys", "0", "PRAGMA foreign_keys = {0}", "0"),
}


@contextmanager
def switched_off(ask: Callable[[str], str | None], run: Callable[[str], object], dialect: str):
    """Foreign keys and triggers of a session are off within, and as they were after it, also after an error. Other dialects have no switch."""
    if dialect not in SWITCHES:
        yield
        return
    question, assumed, statement, off = SWITCHES[dialect]
    try:
        before = str(ask(question) or assumed).strip()
    except Exception:
        before = assumed
    run(statement.format(off))
    try:
        yield
    finally:
        run(statement.format(before))


def upsert_sql(name: str, source: str, columns: list[str], key: list[str], dialect: str) -> str:
    """The statement that merges table `source` into `name` by key; columns beside the key get the source's values, and with none
    of them existing rows stay. Without a key it appends."""
    q = lambda c: quote(c, dialect)
    listed, rest = ", ".join(map(q, columns)), [c for c in columns if c not in key]
    insert = f"INTO {q(name)} ({listed}) SELECT {listed} FROM {q(source)}"
    if not key:
        return f"INSERT {insert}"
    if dialect == "mysql":
        return f"INSERT {insert} ON DUPLICATE KEY UPDATE {', '.join(f'{q(c)} = VALUES({q(c)})' for c in rest)}" if rest else f"INSERT IGNORE {insert}"
    if dialect in ("postgres", "sqlite"):
        what = "UPDATE SET " + ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in rest) if rest else "NOTHING"
        return f"INSERT {insert} WHERE true ON CONFLICT ({', '.join(map(q, key))}) DO {what}"
    on = " AND ".join(f"d.{q(k)} = s.{q(k)}" for k in key)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{q(c)} = s.{q(c)}' for c in rest)}" if rest else ""
    return f"MERGE INTO {q(name)} d USING {q(source)} s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({', '.join(f's.{q(c)}' for c in columns)})"


class SqliteStore(Store):
    """A SQLite file, which the driver and all executors must be able to open. Rows are read by ranges of rowid, so that no task holds a table.

    A file has one writer: the driver, which gets the rows partition by partition, so that it never holds a table either.
    """

    dialect = "sqlite"

    def __init__(self, spark: SparkSession, path: str, rows: int = 100_000):
        self.spark, self.path, self.rows = spark, path, rows

    executes = True

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    @contextmanager
    def session(self, keys_off: bool = False):
        """A function that runs SQL, within one transaction; foreign keys are off in it if `keys_off`."""
        c = sqlite3.connect(self.path, timeout=60, isolation_level=None)
        try:
            with switched_off(lambda sql: (c.execute(sql).fetchone() or [None])[0], c.execute, "sqlite" if keys_off else ""):
                c.execute("BEGIN IMMEDIATE")
                try:
                    yield c.execute
                    c.execute("COMMIT")
                except BaseException:
                    c.execute("ROLLBACK")
                    raise
        finally:
            c.close()

    def execute(self, statements: list) -> int:
        with self.session() as run:
            return execute(statements, run, "sqlite")

    def save(self, name: str, rows: DataFrame, key: list[str], have: Table | None, replace: bool = False) -> int:
        sql, names, n = quote(name, "sqlite"), ", ".join(quote(c, "sqlite") for c in rows.columns), 0
        kinds = [f.dataType.typeName() for f in rows.schema.fields]
        plain = rows.select(*[F.col(f"`{c}`") if k in ("boolean", "binary", "string", "long", "integer", "short", "byte", "double", "float") else F.col(f"`{c}`").cast("string").alias(c) for c, k in zip(rows.columns, kinds, strict=True)])
        with self.session(keys_off=True) as run:
            if replace:
                run(f"DELETE FROM {sql}")
            run(f"CREATE TEMP TABLE sparkferry_stage AS SELECT {names} FROM {sql} WHERE 0")
            put = f"INSERT INTO sparkferry_stage VALUES ({', '.join('?' * len(rows.columns))})"
            for row in plain.toLocalIterator():
                run(put, [bytes(v) if isinstance(v, bytearray) else v for v in row])
                n += 1
            run(upsert_sql(name, "sparkferry_stage", rows.columns, [] if replace else key, "sqlite"))
            run("DROP TABLE sparkferry_stage")
        return n

    def tables(self) -> list[str]:
        with self._open() as c:
            names = [r[0] for r in c.execute("select name from sqlite_master where type = 'table'")]
        return sorted(n for n in names if not is_system_table(n, "sqlite"))

    def describe(self, name: str) -> Table | None:
        with self._open() as c:
            return sqlite_catalog.describe(c, name)

    def read(self, name: str) -> DataFrame:
        """SQLite's columns hold values of any type; one that doesn't fit the column's becomes null."""
        table = self.describe(name)
        if table is None:
            raise ValueError(f"no table {name!r}")
        schema, path, sql = table.schema(), self.path, quote(name, "sqlite")
        with self._open() as c:
            try:
                low, high = c.execute(f"select min(rowid), max(rowid) from {sql}").fetchone()
                ranges = [(a, a + self.rows) for a in range(low, high + 1, self.rows)] if low is not None else []
                where = " where rowid >= ? and rowid < ?"
            except sqlite3.OperationalError:  # without rowid
                ranges, where = [(0, 0)], " where ? = ?"
        names = ", ".join(quote(f.name, "sqlite") for f in schema.fields)
        kinds = [f.dataType.typeName() for f in schema.fields]

        def rows(batches):
            import pandas as pd

            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
                for b in batches:
                    for low, high in zip(b["low"], b["high"], strict=True):
                        got = c.execute(f"select {names} from {sql}{where}", (int(low), int(high)))
                        while part := got.fetchmany(10_000):
                            yield pd.DataFrame({str(i): pd.Series([sqlite_catalog.value(r[i], kinds[i]) for r in part], dtype=object) for i in range(len(kinds))})

        wire = ", ".join(f"`{i}` string" for i in range(len(kinds)))
        parts = self.spark.createDataFrame(ranges, "low long, high long").repartition(max(1, len(ranges))) if ranges else self.spark.createDataFrame([], "low long, high long")
        text = parts.mapInPandas(rows, wire)
        return text.select(*[(F.unbase64(F.col(f"`{i}`")) if f.dataType.typeName() == "binary" else F.col(f"`{i}`").try_cast(f.dataType)).alias(f.name, metadata=f.metadata) for i, f in enumerate(schema.fields)])
