"""A blog and shop schema end to end: MySQL's types in PostgreSQL's and Spark's, the order of tables, and statements for all."""

import pytest

from sparkferry.functions.types import map_type, spark_type
from sparkferry.plans import graph, schema_diff
from sparkferry.plans.model import Column, Constraint, Table

TYPES = [
    ("int", "INTEGER", "int"), ("varchar(50)", "VARCHAR(50)", "string"), ("text", "TEXT", "string"), ("tinyint unsigned", "SMALLINT", "short"), ("decimal(10,2)", "NUMERIC(10,2)", "decimal(10,2)"),
    ("tinyint(1)", "BOOLEAN", "boolean"), ("timestamp", "TIMESTAMP WITH TIME ZONE", "timestamp"), ("json", "JSONB", "string"), ("blob", "BYTEA", "binary"), ("enum('active','pending','banned')", "VARCHAR(255)", "string"),
    ("date", "DATE", "date"), ("time", "TIME WITHOUT TIME ZONE", "string"), ("longtext", "TEXT", "string"), ("datetime", "TIMESTAMP WITHOUT TIME ZONE", "timestamp_ntz"), ("float", "REAL", "float"),
]


@pytest.mark.parametrize("source,target,kind", TYPES)
def test_types(source, target, kind):
    assert map_type(source, "mysql", "postgres").type == target
    assert spark_type(source, "mysql") == kind


def table(name, key, **links):
    columns = [Column(k, "int", False, True, ordinal=i) for i, k in enumerate(key)]
    columns += [Column(c, "int", True, ordinal=9) for c in links if c not in key]
    return Table(name, "mysql", tuple(columns), (), (Constraint(f"pk_{name}", "PRIMARY KEY", tuple(key)), *[Constraint(f"fk_{name}_{c}", "FOREIGN KEY", (c,), "", to, (f"{to}_key",), "CASCADE") for c, to in links.items()]))


TABLES = [
    table("users", ["id"]), table("categories", ["category_id"], parent_cat_id="categories"), table("posts", ["post_id"], author_id="users"), table("comments", ["comment_id"], post_id="posts", user_id="users", parent_comment_id="comments"),
    table("post_categories", ["post_id", "category_id"], post_id="posts", category_id="categories"), table("products", ["product_id"]), table("product_variants", ["variant_id"], product_id="products"),
]


def test_order():
    assert graph.ordered([t.name for t in TABLES], graph.edges_of(TABLES)) == ["categories", "products", "product_variants", "users", "posts", "comments", "post_categories"]


@pytest.mark.parametrize("dst", ["mysql", "postgres"])
def test_statements(dst):
    for t in TABLES:
        made = schema_diff.plan(t, None, dst, "drop_create")
        assert len(made.before) == 2 and len(made.later) + len(made.deferred) == len(t.foreign_keys)
        assert bool(made.deferred) == (dst == "postgres" and bool(t.foreign_keys))
        same = Table(t.name, dst, tuple(Column(c.name, {"mysql": "int", "postgres": "integer"}[dst], c.nullable, c.primary, ordinal=c.ordinal) for c in t.columns), (), t.constraints)
        assert schema_diff.plan(t, same, dst).statements == ()
