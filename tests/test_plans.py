import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkferry.plans import ddl, graph, schema_diff
from sparkferry.plans.catalog import BLOG, OLD_BLOG
from sparkferry.plans.config import Config, credentials, jdbc_url
from sparkferry.plans.model import Column, Constraint, Index, Result, Table, exit_code


def test_order_prefers_names_and_references():
    edges = {("loans", "readers"), ("fines", "loans"), ("fines", "readers"), ("copies", "books"), ("loans", "copies"), ("authors_books", "authors"), ("authors_books", "books")}
    tables = ["readers", "loans", "books", "fines", "copies", "authors", "authors_books"]
    assert graph.ordered(tables, edges) == ["authors", "books", "authors_books", "copies", "readers", "loans", "fines"]
    assert graph.levels(tables, edges) == [["authors", "books", "readers"], ["authors_books", "copies"], ["loans"], ["fines"]]


def test_cycles():
    with pytest.raises(graph.Cycle):
        graph.ordered(["a", "b", "c"], {("a", "b"), ("b", "a")})
    assert graph.levels(["a", "b", "c"], {("a", "b"), ("b", "a")}) == [["c"], ["a", "b"]]


@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)).filter(lambda e: e[0] > e[1])))
def test_order_respects_each_edge(pairs):
    edges = {(str(a), str(b)) for a, b in pairs}
    out = graph.ordered([str(i) for i in range(10)], edges)
    assert all(out.index(b) < out.index(a) for a, b in edges) and len(out) == 10


def test_edges_leave_out_self_and_unknown():
    t = Table("a", "mysql", constraints=tuple(Constraint(n, "FOREIGN KEY", ("x",), to_table=to) for n, to in (("1", "a"), ("2", "z"), ("3", "b"))))
    assert graph.edges_of([t, Table("b", "mysql")]) == {("a", "b")}


def test_create_for_postgres():
    made = schema_diff.plan(BLOG, None, "postgres", "drop_create").statements
    assert [s.phase.name for s in made] == ["DROP_TABLE", "CREATE_TABLE", "ADD_INDEX", "ADD_INDEX", "ADD_CONSTRAINT", "DEFERRED"]
    create = made[1].sql
    assert '"id" INTEGER GENERATED BY DEFAULT AS IDENTITY NOT NULL' in create
    assert '"live" BOOLEAN DEFAULT TRUE NOT NULL' in create and '"at" TIMESTAMP WITHOUT TIME ZONE DEFAULT CURRENT_TIMESTAMP' in create
    assert 'PRIMARY KEY ("id")' in create
    assert "DEFAULT CURRENT" not in schema_diff.plan(BLOG, None, "postgres", "drop_create", compat=True).statements[1].sql


def test_alter_changes_only_what_differs():
    made = [s.sql for s in schema_diff.plan(BLOG, OLD_BLOG, "postgres").statements]
    assert not any('"live"' in s or '"at"' in s or '"views" ' in s and "COLUMN" in s for s in made)
    assert schema_diff.plan(BLOG, OLD_BLOG, "postgres", "none").statements == ()
    with pytest.raises(ValueError):
        schema_diff.plan(BLOG, OLD_BLOG, "postgres", "sometimes")


def test_unique_is_kept_once():
    t = Table("t", "sqlite", (Column("a", "text", False, ordinal=1),), (), (Constraint("u", "UNIQUE", ("a",)),))
    assert any("UNIQUE" in s.sql for s in schema_diff.plan(t, None, "mysql", "drop_create").statements)
    both = Table("t", "mysql", t.columns, (Index("ux", ("a",), True),), t.constraints)
    assert sum("UNIQUE" in s.sql for s in schema_diff.plan(both, None, "postgres", "drop_create").statements) == 1


def test_key_keeps_its_declared_order():
    t = Table("t", "mysql", (Column("b", "int", False, True, ordinal=1), Column("a", "int", False, True, ordinal=2)), (), (Constraint("pk", "PRIMARY KEY", ("b", "a")),))
    assert "PRIMARY KEY (`b`, `a`)" in ddl.create_table(ddl.mapped(t, "mysql"), "mysql").sql
    assert "PRIMARY KEY (`a`, `b`)" in ddl.create_table(ddl.mapped(t, "mysql"), "mysql", compat=True).sql


def test_type_equality():
    same = lambda w, h, src="mysql", dst="postgres": schema_diff.same_type(w, h, src, dst)
    assert same(Column("a", "x", mapped="VARCHAR(10)", length=10), Column("a", "character varying", length=10))
    assert not same(Column("a", "x", mapped="VARCHAR(10)", length=10), Column("a", "character varying(20)", length=20))
    assert same(Column("a", "x", mapped="BOOLEAN"), Column("a", "tinyint(1)", length=1), "postgres", "mysql")
    assert same(Column("a", "x", mapped="CHAR(36)"), Column("a", "char(36)", length=36), "postgres", "mysql")
    assert same(Column("a", "x", mapped="INTEGER", length=11), Column("a", "integer")) and same(Column("a", "x", mapped="TEXT", length=65535), Column("a", "text"))
    assert same(Column("a", "x", mapped="DATETIME"), Column("a", "timestamp", precision=0), "postgres", "mysql")
    assert not same(Column("a", "x", mapped="NUMERIC", precision=10, scale=2), Column("a", "decimal", precision=10, scale=3))


@pytest.mark.parametrize(
    "value,type_,src,dst,want",
    [("1", "boolean", "mysql", "postgres", "TRUE"), ("0", "TINYINT(1)", "postgres", "mysql", "'0'"), ("'5'::integer", "INT", "postgres", "mysql", "5"), ("it's", "TEXT", "mysql", "postgres", "'it''s'"), ("'it''s'::text", "LONGTEXT", "postgres", "mysql", "'it''s'"), ("0101", "varbit", "mysql", "postgres", "B'0101'")],
)
def test_literals(value, type_, src, dst, want):
    assert ddl.literal(value, type_, src, dst) == want


def test_one_create_only():
    s = ddl.create_table(ddl.mapped(BLOG, "mysql"), "mysql")
    with pytest.raises(ValueError):
        ddl.in_order([s, s])


def test_exit_codes():
    ok, bad, rule, skip = Result("a"), Result("b", data_error="x"), Result("c", constraint_error="x"), Result("d", skipped="x")
    assert [exit_code(x) for x in ([], [ok], [ok, bad, rule], [ok, rule], [skip], [skip, ok])] == [0, 0, 1, 2, 3, 0]
    assert Result("e", schema_error="x", skipped="schema").status == "failed"


def test_config():
    c = Config.load({"SYNC_DIRECTION": "sqlite-to-mysql", "WORKERS": "3", "SCHEMA_SYNC_STRATEGY": "alter", "SKIP_FAILED_TABLES": "yes"}, batch_size=5)
    assert (c.source, c.destination, c.workers, c.strategy, c.skip_failed_tables, c.batch_size) == ("sqlite", "mysql", 3, "alter", True, 5)
    for bad in ({"source": "mysql", "destination": "sqlite"}, {"strategy": "x"}, {"workers": 0}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert credentials({"SRC_USER": "u", "SRC_PASSWORD": "p"}, "SRC") == ("u", "p")
    assert credentials({}, "SRC", [lambda _: None, lambda _: ("v", "w")]) == ("v", "w")
    with pytest.raises(ValueError):
        credentials({}, "SRC")
    assert jdbc_url("postgres", "h", 5432, "d") == "jdbc:postgresql://h:5432/d?sslmode=disable&reWriteBatchedInserts=true"
