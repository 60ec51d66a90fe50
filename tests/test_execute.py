import sqlite3

import pytest

from sparkferry.plans import ddl, execute, schema_diff
from sparkferry.plans.ddl import Phase
from sparkferry.plans.model import Column, Index, Table

SCRIPT = """-- a comment; with a semicolon
CREATE TABLE IF NOT EXISTS "t" ("a" text DEFAULT 'x;--y', "b" int); /* more */ CREATE UNIQUE INDEX "ux" ON "t" ("a");
ALTER TABLE "t" ADD CONSTRAINT "fk" FOREIGN KEY ("b") REFERENCES "p" ("id") DEFERRABLE INITIALLY DEFERRED;
ALTER TABLE "t" DROP CONSTRAINT IF EXISTS "t_b_fkey"; ALTER TABLE "t" DROP CONSTRAINT "t_pkey"; ALTER TABLE "t" ADD COLUMN "c" int; ALTER TABLE "t" DROP COLUMN "d"; DROP INDEX IF EXISTS "ix";
ALTER TABLE `t` DROP PRIMARY KEY"""


def test_scripts_are_split_and_ordered():
    got = execute.parse(SCRIPT, "postgres", {"t_b_fkey": "FOREIGN KEY", "t_pkey": "PRIMARY KEY"})
    assert "'x;--y'" in got[0].sql and len(got) == 9
    assert [(s.phase.name, s.name) for s in ddl.in_order(got)] == [
        ("DROP_CONSTRAINT", "t_b_fkey"), ("DROP_CONSTRAINT", "PRIMARY"), ("DROP_CONSTRAINT", "t_pkey"), ("DROP_INDEX", "ix"), ("CREATE_TABLE", "t"), ("ALTER_COLUMN", "d"), ("ALTER_COLUMN", "c"), ("ADD_INDEX", "ux"), ("DEFERRED", "fk"),
    ]
    with pytest.raises(ValueError):
        execute.parse("GRANT ALL", "mysql")
    unknown = execute.parse("ALTER TABLE t DROP CONSTRAINT some_name; ALTER TABLE s.t DROP FOREIGN KEY `b`; alter table t add constraint c check (a > 0); ALTER TABLE t MODIFY COLUMN `q` int", "mysql")
    assert [(s.phase.name, s.rank, s.name) for s in ddl.in_order(unknown)] == [("DROP_CONSTRAINT", 1, "b"), ("DROP_CONSTRAINT", 5, "some_name"), ("ALTER_COLUMN", 2, "q"), ("ADD_CONSTRAINT", 3, "c")]


def test_a_plan_runs_and_runs_again(tmp_path):
    t = Table("t", "sqlite", (Column("id", "integer", False, True, ordinal=1), Column("a", "varchar(9)", ordinal=2)), (Index("ix", ("a",)),))
    made = schema_diff.plan(t, None, "sqlite").statements
    with sqlite3.connect(tmp_path / "x.db") as c:
        assert execute.execute(list(made), c.execute, "sqlite") == 2
        c.execute("insert into t values (1, 'b')")
        execute.execute(list(made), c.execute, "sqlite")
        again = [ddl.Statement(Phase.ADD_INDEX, 0, "ix", "CREATE INDEX ix ON t (a)"), ddl.Statement(Phase.DROP_INDEX, 0, "no", "DROP INDEX missing")]
        assert execute.execute(again, c.execute, "sqlite") == 0


def test_errors_of_a_phase_are_gathered():
    said = []

    def run(sql):
        said.append(sql)
        if "bad" in sql:
            raise RuntimeError("syntax")

    steps = [ddl.Statement(Phase.ADD_INDEX, 0, n, n) for n in ("bad1", "bad2", "good")] + [ddl.Statement(Phase.ADD_CONSTRAINT, 1, "later", "later")]
    with pytest.raises(execute.Failed) as e:
        execute.execute(steps, run, "mysql")
    assert len(e.value.errors) == 2 and said == ["bad1", "bad2", "good"]
    said.clear()
    with pytest.raises(execute.Failed):
        execute.execute([ddl.Statement(Phase.ALTER_COLUMN, 1, n, n) for n in ("bad", "good")], run, "mysql")
    assert said == ["bad"]


@pytest.mark.parametrize(
    "error,phase,dialect,want",
    [("ERROR 42P07: relation exists", Phase.CREATE_TABLE, "postgres", True), ("ERROR 42P07", Phase.DROP_TABLE, "postgres", False), ("1091 (42000)", Phase.DROP_INDEX, "mysql", True), ("11091", Phase.DROP_INDEX, "mysql", False), ("index ix already exists", Phase.ADD_INDEX, "sqlite", True), ("disk full", Phase.ADD_INDEX, "sqlite", False)],
)
def test_ignorable(error, phase, dialect, want):
    assert execute.ignorable(error, ddl.Statement(phase, 0, "x", "X"), dialect) is want


def test_savepoints_in_postgres():
    said = []

    def run(sql):
        said.append(sql)
        if sql == "there":
            raise RuntimeError("ERROR 42P07: relation exists")

    assert execute.execute([ddl.Statement(Phase.CREATE_TABLE, 0, "t", "there"), ddl.Statement(Phase.ADD_INDEX, 0, "i", "new")], run, "postgres") == 1
    assert said == ["SAVEPOINT statement", "there", "ROLLBACK TO SAVEPOINT statement", "SAVEPOINT statement", "new", "RELEASE SAVEPOINT statement"]
