from sparkferry.plans import metrics
from sparkferry.plans.model import Result
from sparkferry.sources import jdbc_catalog

COLUMN = {"type": "int", "nullable": 0, "default_text": None, "auto_increment": 0, "generated": None, "length": None, "prec": None, "scale": None, "collation": None, "note": None, "primary_key": 0}


def rows(sql):
    if "information_schema.columns" in sql:
        return [COLUMN | {"name": "b", "ordinal": 2, "type": "varchar(9)", "length": 9, "nullable": 1}, COLUMN | {"name": "a", "ordinal": 1, "primary_key": 1, "auto_increment": 1}]
    if "statistics" in sql or "pg_index x" in sql:
        return [
            {"name": "ix", "place": 2, "column_name": "a", "is_unique": 1, "is_primary": 0, "definition": ""}, {"name": "ix", "place": 1, "column_name": "b", "is_unique": 1, "is_primary": 0, "definition": ""},
            {"name": "iy", "place": 0, "column_name": None, "is_unique": 0, "is_primary": 0, "definition": "CREATE INDEX iy ON t USING gin (lower(b), a DESC)"},
        ]
    rule = {"definition": None, "to_table": None, "to_column": None, "on_delete": None, "on_update": None}
    return [
        rule | {"name": "fk", "kind": "FOREIGN KEY", "place": 2, "column_name": "b", "to_table": "p", "to_column": "y", "on_delete": "CASCADE"}, rule | {"name": "fk", "kind": "FOREIGN KEY", "place": 1, "column_name": "a", "to_table": "p", "to_column": "x", "on_delete": "CASCADE"},
        rule | {"name": "ck", "kind": "CHECK", "place": 1, "column_name": None, "definition": "a > 0"}, rule | {"name": "pk", "kind": "PRIMARY KEY", "place": 1, "column_name": "a"},
    ]


def test_tables_from_catalog_rows():
    for dialect in ("mysql", "postgres"):
        t = jdbc_catalog.describe(rows, "it's", dialect)
        assert [c.name for c in t.columns] == ["a", "b"] and t.columns[1].length == 9 and t.key == ["a"]
        assert [(i.name, i.columns, i.unique) for i in t.indexes] == [("ix", ("b", "a"), True), ("iy", ("lower(b)", "a"), False)]
        fk = t.foreign_keys[0]
        assert (fk.columns, fk.to_table, fk.to_columns, fk.on_delete) == (("a", "b"), "p", ("x", "y"), "CASCADE")
        assert next(c for c in t.constraints if c.kind == "CHECK").definition == "a > 0"


def test_missing_table_and_failing_lists():
    assert jdbc_catalog.describe(lambda sql: [], "t", "mysql") is None

    def only_columns(sql):
        if "information_schema.columns" not in sql:
            raise RuntimeError("denied")
        return rows(sql)

    t = jdbc_catalog.describe(only_columns, "t", "postgres")
    assert len(t.columns) == 2 and t.indexes == () and t.constraints == ()


def test_metrics(spark):
    results = [Result("a", rows=5, batches=1, seconds=0.15), Result("b", data_error="x", seconds=3.0)]
    got = {(r.metric, r.label): r.value for r in metrics.metrics_frame(spark, results, 4.0).collect()}
    assert got["tables_total", "ok"] == 1 and got["errors_total", "data_error"] == 1 and got["table_seconds_bucket", "0.2"] == 1 and got["run_seconds", ""] == 4
    assert 'sparkferry_rows_total{label="a"} 5\n' in metrics.exposition(results, 4.0)
