import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkferry.functions import definitions as D
from sparkferry.functions import types as T
from sparkferry.functions.names import is_system_table, quote, unquote

NORMAL = [
    ("Char(3)", "char"), ("NUMERIC (8 , 3)", "numeric"), ("\tSmallInt\n", "smallint"), ("bigint(20) unsigned", "bigint"), ("mediumint zerofill", "mediumint"), ("character  varying(7)", "varchar"),
    ("Double   Precision", "double"), ("time(2) without time zone", "time"), ("timestamp without time zone", "timestamp"), ("int8", "bigint"), ("serial4", "serial"), ("currency(usd)", "currency(usd)"),
    ("citext", "citext"), ("Bit Varying", "varbit"), (" ", ""),
]


@pytest.mark.parametrize("raw,want", NORMAL)
def test_normalize(raw, want):
    assert T.normalize(raw) == want


def test_normalize_as_a_column(spark):
    from sparkferry.plans.catalog import relation

    rows = relation(spark, "type want", NORMAL).select("type", "want", T.normalized(F.col("type")).alias("got")).collect()
    assert all(r.got == r.want for r in rows), rows


MODIFIERS = [
    ("char(12)", "CHAR", "postgres", T.APPLY, "CHAR(12)"), ("numeric(9,3)", "DECIMAL", "mysql", T.APPLY, "DECIMAL(9,3)"), ("numeric(3,9)", "DECIMAL", "mysql", T.APPLY, "DECIMAL"), ("numeric(0)", "DECIMAL", "mysql", T.APPLY, "DECIMAL"),
    ("time(5)", "TIME WITHOUT TIME ZONE", "postgres", T.APPLY, "TIME(5) WITHOUT TIME ZONE"), ("time(2)", "TIME", "mysql", T.APPLY, "TIME(2)"), ("time(9)", "TIME", "mysql", T.APPLY, "TIME"), ("time(2)", "TIME", "sqlite", T.APPLY, "TIME"),
    ("bigint(20)", "BIGINT", "postgres", T.APPLY, "BIGINT"), ("mediumtext", "TEXT", "postgres", T.APPLY, "TEXT"), ("varbinary(16)", "VARBINARY", "mysql", T.APPLY, "VARBINARY(16)"), ("binary(16)", "BYTEA", "postgres", T.APPLY, "BYTEA"),
    ("bit(5)", "BIT", "mysql", T.APPLY, "BIT(5)"), ("char(5)", "CHAR(36)", "mysql", T.TARGET, "CHAR(36)"), ("char(5)", "CHAR", "mysql", T.IGNORE, "CHAR"), ("set('x','y')", "VARCHAR(9)", "mysql", T.APPLY, "VARCHAR(9)"),
    ("float(7,3)", "REAL", "postgres", T.APPLY, "REAL"), ("polygon(4326)", "POLYGON", "mysql", T.APPLY, "POLYGON"),
]


@pytest.mark.parametrize("source,mapped,dialect,strategy,want", MODIFIERS)
def test_modifier(source, mapped, dialect, strategy, want):
    assert T.with_modifier(source, mapped, dialect, strategy) == want


def test_modifier_compat_keeps_the_literal_place():
    assert T.with_modifier("TIME(4) WITHOUT TIME ZONE", "TIME WITHOUT TIME ZONE", "postgres", T.APPLY, compat=True) == "TIME WITHOUT TIME ZONE(4)"


@pytest.mark.parametrize(
    "args,want,compat",
    [
        (("tinyint(1)", "mysql", "postgres"), "BOOLEAN", "BOOLEAN"), (("integer", "postgres", "mysql"), "INT", "LONGTEXT"), (("double precision", "postgres", "mysql"), "DOUBLE", "LONGTEXT"),
        (("enum('a','b')", "mysql", "postgres"), "VARCHAR(255)", "TEXT"), (("boolean", "sqlite", "mysql"), "TINYINT(1)", "LONGTEXT"), (("character varying", "postgres", "mysql", 80), "VARCHAR(80)", "VARCHAR"),
        (("numeric", "postgres", "mysql", None, 12, 3), "DECIMAL(12,3)", "DECIMAL"), (("bigint unsigned", "mysql", "postgres"), "NUMERIC(20,0)", "BIGINT"), (("integer[]", "postgres", "mysql"), "JSON", "JSON"),
        (("int(11)", "mysql", "mysql"), "int(11)", "int(11)"), (("weird", "mysql", "postgres"), "TEXT", "TEXT"), (("uuid", "postgres", "mysql"), "CHAR(36)", "CHAR(36)"),
    ],
)
def test_map_type(args, want, compat):
    assert T.map_type(*args).type == want
    assert T.map_type(*args, compat=True).type == compat


def test_base_of_generated():
    assert T.base_of_generated("int GENERATED ALWAYS AS (a + b) STORED") == "int"
    assert T.base_of_generated("bigint generated by default as identity") == "bigint"
    assert T.base_of_generated("decimal(10,2) AS (a*2)") == "decimal(10,2)"
    assert T.base_of_generated("varchar(10)") == "varchar(10)"
    assert T.base_of_generated("GENERATED") == "GENERATED"


def test_spark_types():
    got = [T.spark_type(t, d) for t, d in [("tinyint(1)", "mysql"), ("int unsigned", "mysql"), ("bigint unsigned", "mysql"), ("datetime", "mysql"), ("timestamp", "mysql"), ("timestamp", "postgres"), ("integer[]", "postgres"), ("numeric", "postgres"), ("longblob", "mysql"), ("INTEGER", "sqlite"), ("money", "postgres"), ("jsonb", "postgres")]]
    assert got == ["boolean", "long", "decimal(20,0)", "timestamp_ntz", "timestamp", "timestamp_ntz", "array<int>", "decimal(38,18)", "binary", "long", "decimal(19,2)", "string"]


DEFAULTS = [
    (None, "mysql", ""), ("  ", "postgres", ""), ("NULL", "mysql", "null"), ("null::varchar", "postgres", "null"), ("Draft", "mysql", "draft"), ("'Draft'", "sqlite", "draft"), ('"Draft"', "sqlite", "draft"), ("`Draft`", "mysql", "draft"),
    ("'it''s'", "sqlite", "it's"), ("yes", "postgres", "1"), ("'no'", "mysql", "0"), ("CURRENT_TIMESTAMP(3) ON UPDATE CURRENT_TIMESTAMP(3)", "mysql", "current_timestamp"), ("0 on update current_timestamp", "mysql", "0"),
    ("now()", "postgres", "current_timestamp"), ("(now())::date", "postgres", "current_timestamp"), ("'x'::character varying(9)", "postgres", "x"), ("(('7'::text))::integer", "postgres", "7"), ("-1.50::numeric(9,2)", "postgres", "-1.50"),
    ("nextval('orders_id_seq'::regclass)", "postgres", "nextval"), ("uuid()", "mysql", "uuid_function"), ("b'1'", "mysql", "1"), ("b'10'", "mysql", "b'10'"), ("lower( 'A' )", "sqlite", "lower( 'a' )"), ("'a::b'", "postgres", "a::b"),
    ("'{1,2}'::int[]", "postgres", "{1,2}"), ("'s'::app.mood", "postgres", "s"),
]


@pytest.mark.parametrize("raw,dialect,want", DEFAULTS)
def test_default(raw, dialect, want):
    assert D.default(raw, dialect) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("((price >= 0))", "price >= 0"), ("price\n\t>=   0", "price >= 0"), ("price >= 0 -- never less", "price >= 0"), ("/* why */ price /* what */ >= 0", "price >= 0"), ("(a = 1) OR (b = 2)", "(a = 1) or (b = 2)"),
        ("((a = 1 OR b = 2) AND c = ')')", "(a = 1 or b = 2) and c = ')'"), ("length((name)) < 9", "length((name)) < 9"), ("/* nothing */", ""), (None, ""), ("note <> '-- no /* comment */'", "note <> '-- no /* comment */'"),
    ],
)
def test_condition(raw, want):
    assert D.condition(raw) == want


def test_same_default():
    assert D.same_default("1.50", "1.5", "mysql", "postgres", "decimal(10,2)")
    assert D.same_default(None, "NULL::text", "mysql", "postgres", "text")
    assert D.same_default("1", "true", "mysql", "postgres", "boolean")
    assert not D.same_default("y", "1", "mysql", "postgres", "varchar(5)")
    assert D.same_default("y", "1", "mysql", "postgres", "varchar(5)", compat=True)
    assert not D.same_default("a", "b", "mysql", "postgres", "int")


def test_other_definitions():
    assert D.action(" set null ") == "SET NULL" and D.action(None) == "NO ACTION"
    assert D.inside("((a + B))") == "a + B" and D.inside("(a) + (b)") == "(a) + (b)"
    assert D.index("CREATE INDEX ix ON t USING btree ( Lower( A ) ,  b DESC) WHERE (c)") == "(lower(a),b desc)"
    assert D.collation("default") == "" and D.collation("UTF8") == "utf8"
    assert D.is_null_or_function("nextval") and not D.is_null_or_function("0")


@pytest.mark.parametrize("name,dialect,want", [("my`t", "mysql", "`my``t`"), ('My"T', "postgres", '"My""T"'), ("", "sqlite", '""'), ("x", "unknown", '"x"'), ("x", "MYSQL", "`x`")])
def test_quote(name, dialect, want):
    assert quote(name, dialect) == want


def test_unquote():
    assert unquote("  `trimmed`  ", "mysql") == "trimmed"
    assert unquote("`pg`", "postgres") == "`pg`"
    assert unquote('"', "postgres") == '"'


@given(st.text(), st.sampled_from(["mysql", "postgres", "sqlite"]))
def test_quoting_can_be_undone(name, dialect):
    assert unquote(quote(name, dialect), dialect) == name


@given(st.from_regex(r"[a-z]{1,8}( [a-z]{1,8})?(\(\d{1,3}\))?", fullmatch=True))
def test_normalizing_twice_is_normalizing_once(name):
    assert T.normalize(T.normalize(name)) == T.normalize(name)


def test_system_tables():
    assert is_system_table("pg_class", "postgres") and is_system_table("sqlite_sequence", "sqlite")
    assert not is_system_table("pgx", "postgres") and not is_system_table("users", "mysql")


def test_type_map_from_a_file(tmp_path, caplog):
    path = tmp_path / "types.json"
    path.write_text(
        """[{"source": "MySQL", "target": "Postgres", "types": {"set": {"type": "VARCHAR(99)", "modifier": "use_target_defined"}, "char": {"type": "BPCHAR", "modifier": "sometimes"}, "year": {"type": "INTEGER", "using": "{column} + 0"}},
        "patterns": [{"pattern": "^bit\\\\(1\\\\)$", "type": "BOOLEAN", "modifier": "ignore_source"}]}]"""
    )
    types = T.TypeMap.load(str(path))
    put = lambda t: T.map_type(t, "mysql", "postgres", types=types)
    assert put("set('a')").type == "VARCHAR(99)" and put("char(4)").type == "BPCHAR(4)" and put("year").using == "{column} + 0"
    assert put("bit(1)").type == "BOOLEAN" and put("tinyint(1)").type == "BOOLEAN" and put("int").type == "INTEGER"
    assert "sometimes" in caplog.text and T.map_type("set('a')", "mysql", "postgres").type == "TEXT"
    for bad in ('[{"source": "oracle", "target": "mysql"}]', '[{"source": "mysql", "target": "postgres", "types": {"set": {}}}]', '[{"source": "mysql", "target": "postgres", "patterns": [{"pattern": "(", "type": "X"}]}]'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            T.TypeMap.load(str(path))


def test_families():
    assert [T.family(t) for t in ("VARCHAR(9)", "point", "interval", "Double Precision", "TIMESTAMP(3) WITH TIME ZONE", "numeric(4,1)", "boolean", "longblob")] == ["text", "other", "other", "real", "clock", "decimal", "boolean", "bytes"]
    assert T.is_flag("tinyint( 1 )") and not T.is_flag("tinyint(4)")
