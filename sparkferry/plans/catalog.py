"""The registered queries of the synchronisation engine and their DuckDB equivalents.

Where a query works on catalogs, its rows are a small relation given here, in Spark and in SQL from one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkferry.functions import definitions as D
from sparkferry.functions.types import map_columns, normalized
from sparkferry.operators import coerce, merge, paging, validate
from sparkferry.plans import ddl, graph, runner, schema_diff
from sparkferry.plans.model import Column, Constraint, Index, Result, Table

QUERIES = {}
ORACLES = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(name, sql=None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    names = columns.split()
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, r, strict=True)]) for r in rows])))


def sql_values(rows: list[tuple]) -> str:
    put = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "values " + ", ".join("(" + ", ".join(map(put, r)) + ")" for r in rows)


# --- reading ---------------------------------------------------------------------------------------------------------


@register("count_rows", " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in TABLES))
def count_rows(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register("list_tables", sql_values([(t,) for t in sorted(TABLES)]).replace("values", "select * from (values", 1) + ") v(table_name)")
def list_tables(spark, sf_dir):
    from sparkferry.sources.stores import ParquetStore

    return relation(spark, "table_name", [(t,) for t in ParquetStore(spark, sf_dir).tables()])


@register("page_first", "select * from orders order by o_orderkey limit 1000")
def page_first(spark, sf_dir):
    return paging.page(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000)


@register("page_next", "select * from orders where o_orderkey > 5000 order by o_orderkey limit 1000")
def page_next(spark, sf_dir):
    return paging.page(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000, [5000])


@register("page_composite_or", "select * from conversations where conv_id > 50 or (conv_id = 50 and turn > 1) order by conv_id, turn limit 100")
def page_composite_or(spark, sf_dir):
    return paging.page(table(spark, sf_dir, "conversations"), ["turn", "conv_id"], 100, [50, 1])


@register("page_composite_tuple", "select * from conversations where (conv_id, turn) > (50, 1) order by conv_id, turn limit 100")
def page_composite_tuple(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.where(paging.after_tuple(rows, ["conv_id", "turn"], [50, 1])).orderBy("conv_id", "turn").limit(100)


@register("page_manifest", "select (r - 1) // 1000 as page_id, count(*) as n_rows, min(o_orderkey) as low, max(o_orderkey) as high from (select *, row_number() over (order by o_orderkey) as r from orders) group by 1")
def page_manifest(spark, sf_dir):
    out = paging.manifest(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000)
    return out.select("page_id", "n_rows", F.col("low.o_orderkey").alias("low"), F.col("high.o_orderkey").alias("high"))


@register("page_concat_equals_scan", "select * from conversations")
def page_concat_equals_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return paging.numbered(rows, ["conv_id", "turn"], 100).drop("page_id")


@register("scan_no_pk", "select * from lineitem")
def scan_no_pk(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


# --- coercion --------------------------------------------------------------------------------------------------------


@register("coerce_bool_int", "select l_orderkey, l_linenumber as was, l_linenumber = 1 as flag from lineitem")
def coerce_bool_int(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("was"), F.col("l_linenumber").alias("flag"))
    return coerce.coerce(rows, {"flag": "boolean"}, "postgres")


@register("coerce_bool_float", "select l_orderkey, l_discount as was, round(l_discount * 20, 6) = 1.0 as flag from lineitem")
def coerce_bool_float(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").alias("was"), (F.col("l_discount") * 20).alias("flag"))
    return coerce.coerce(rows, {"flag": "boolean"}, "postgres")


_SPELLED = "case l_linenumber when 1 then concat(' TRUE ', chr(9)) when 2 then concat(chr(10), 'f') when 3 then 'Yes' when 4 then 'off' when 5 then l_returnflag when 6 then concat(chr(13), chr(10)) else null end"


@register(
    "coerce_bool_string",
    rf"""select l_orderkey, was, case when lower(regexp_replace(was, '^\s+|\s+$', '', 'g')) in ('1', 'true', 't', 'yes', 'on') then true
  when lower(regexp_replace(was, '^\s+|\s+$', '', 'g')) in ('0', 'false', 'f', 'no', 'off') then false end as flag from (select l_orderkey, {_SPELLED} as was from lineitem)""",
)
def coerce_bool_string(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_SPELLED).alias("was")).withColumn("flag", F.col("was"))
    return coerce.coerce(rows, {"flag": "bool"}, "postgres")


@register("coerce_unfit", rf"select l_orderkey, was from (select l_orderkey, {_SPELLED} as was from lineitem) where was is not null and lower(regexp_replace(was, '^\s+|\s+$', '', 'g')) not in ('1', 'true', 't', 'yes', 'on', '0', 'false', 'f', 'no', 'off')")
def coerce_unfit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_SPELLED).alias("was"))
    return coerce.unfit(rows, {"was": "bool"}, "postgres")


@register("coerce_tinyint", "select o_orderkey, cast(case when o_totalprice > 150000 then 1 else 0 end as tinyint) as flag from orders")
def coerce_tinyint(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("flag"))
    return coerce.coerce(rows, {"flag": "tinyint(1)"}, "mysql")


# --- writing ---------------------------------------------------------------------------------------------------------

#: A destination copy that has gone stale: every third order with another price, plus rows of its own.
STALE_SQL = """select o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 as o_totalprice, o_orderdate, o_orderpriority
from orders where o_orderkey % 3 = 0
union all select o_orderkey + 1000000000, o_custkey, 'X', o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 7 = 0"""


def stale_orders(orders):
    changed = orders.where(F.col("o_orderkey") % 3 == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    own = orders.where(F.col("o_orderkey") % 7 == 0).withColumn("o_orderkey", F.col("o_orderkey") + F.lit(1000000000)).withColumn("o_orderstatus", F.lit("X"))
    return changed.unionByName(own)


MERGED_SQL = f"with d as ({STALE_SQL}) select * from orders union all select * from d where o_orderkey not in (select o_orderkey from orders)"


@register("upsert_orders", MERGED_SQL)
def upsert_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return merge.upsert(stale_orders(orders), orders, ["o_orderkey"])


@register("upsert_idempotent", MERGED_SQL)
def upsert_idempotent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return merge.upsert(merge.upsert(stale_orders(orders), orders, ["o_orderkey"]), orders, ["o_orderkey"])


@register("no_delete_propagation", f"select o_orderkey, o_orderstatus from ({STALE_SQL}) d where o_orderkey not in (select o_orderkey from orders)")
def no_delete_propagation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = merge.upsert(stale_orders(orders), orders, ["o_orderkey"])
    return out.join(orders, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@register("upsert_composite", "select conv_id, turn, role, text from conversations union all select conv_id + 1000000, turn, role, 'old' from conversations where turn = 0")
def upsert_composite(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    stale = rows.where("turn < 2").withColumn("text", F.lit("stale")).unionByName(rows.where("turn = 0").withColumn("conv_id", F.col("conv_id") + 1000000).withColumn("text", F.lit("old")))
    return merge.upsert(stale, rows, ["turn", "conv_id"])


@register("upsert_some_columns", "select o_orderkey, o_custkey, case when o_orderkey % 2 = 0 then 0 else o_totalprice end as o_totalprice from orders")
def upsert_some_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return merge.upsert(rows, rows.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), ["o_orderkey"])


@register("upsert_latest", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc, l_suppkey desc) = 1")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return merge.latest(rows, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")])


@register("insert_ignore", "select o_orderkey, o_custkey from orders union all select o_custkey + 2000000000, o_custkey from orders where o_orderkey % 5 = 0 group by o_custkey")
def insert_ignore(spark, sf_dir):
    have = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    new = have.where("o_orderkey % 5 = 0").groupBy("o_custkey").agg(F.max(F.lit(1))).select((F.col("o_custkey") + F.lit(2000000000)).alias("o_orderkey"), "o_custkey")
    return merge.upsert(have, have.where("o_orderkey % 3 = 0").unionByName(new), ["o_orderkey", "o_custkey"])


@register("append_no_pk", "select * from lineitem union all select * from lineitem where l_linenumber = 1")
def append_no_pk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return merge.upsert(rows, rows.where("l_linenumber = 1"), [])


@register("replace_table", "select o_orderkey, o_custkey, o_totalprice, cast(null as varchar) as note from orders")
def replace_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.select("o_orderkey", "o_custkey", F.lit(0.0).alias("o_totalprice"), F.lit("old").alias("note")).limit(0)
    return merge.replace(old, orders)


# --- constraints -----------------------------------------------------------------------------------------------------


@register("pk_uniqueness", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def pk_uniqueness(spark, sf_dir):
    return validate.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("unique_violations", "select c_nationkey, c_mktsegment, count(*) as n from customer where c_nationkey % 4 <> 0 group by all having count(*) > 1")
def unique_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey")))
    return validate.duplicates(rows, ["c_nationkey", "c_mktsegment"], nulls_match=False)


@register("not_null_violations", "select 'o_custkey' as \"column\", count(*) as n from orders where o_orderkey % 11 = 0 having count(*) > 0")
def not_null_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")))
    return validate.nulls(rows, ["o_orderkey", "o_custkey"])


@register("fk_orphans", "select o_orderkey, case when o_orderkey % 13 = 0 then -o_custkey when o_orderkey % 17 = 0 then null else o_custkey end as o_custkey from orders where o_orderkey % 13 = 0 and o_custkey > 0")
def fk_orphans(spark, sf_dir):
    bad = F.when(F.col("o_orderkey") % 13 == 0, -F.col("o_custkey")).when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", bad.alias("o_custkey"))
    return validate.orphans(rows, ["o_custkey"], table(spark, sf_dir, "customer"), ["c_custkey"])


@register("fk_self", "select n_nationkey, n_nationkey + 20 as parent from nation where n_nationkey + 20 not in (select n_nationkey from nation)")
def fk_self(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 20).alias("parent"))
    return validate.orphans(rows, ["parent"], rows, ["n_nationkey"])


@register("check_violations", "select l_orderkey, l_quantity from lineitem where not (l_quantity < 50)")
def check_violations(spark, sf_dir):
    return validate.violations(table(spark, sf_dir, "lineitem"), "l_quantity < 50").select("l_orderkey", "l_quantity")


# --- catalogs --------------------------------------------------------------------------------------------------------

#: The driver tables' keys and references, as a catalog lists them: table, constraint, kind, place, column, referenced table and column.
KEYS = [
    ("region", "pk", "PRIMARY KEY", 1, "r_regionkey", None, None), ("nation", "pk", "PRIMARY KEY", 1, "n_nationkey", None, None), ("nation", "fk_region", "FOREIGN KEY", 1, "n_regionkey", "region", "r_regionkey"),
    ("customer", "pk", "PRIMARY KEY", 1, "c_custkey", None, None), ("customer", "fk_nation", "FOREIGN KEY", 1, "c_nationkey", "nation", "n_nationkey"), ("supplier", "pk", "PRIMARY KEY", 1, "s_suppkey", None, None),
    ("supplier", "fk_nation", "FOREIGN KEY", 1, "s_nationkey", "nation", "n_nationkey"), ("part", "pk", "PRIMARY KEY", 1, "p_partkey", None, None), ("orders", "pk", "PRIMARY KEY", 1, "o_orderkey", None, None),
    ("orders", "fk_customer", "FOREIGN KEY", 1, "o_custkey", "customer", "c_custkey"), ("lineitem", "fk_orders", "FOREIGN KEY", 1, "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "fk_part", "FOREIGN KEY", 1, "l_partkey", "part", "p_partkey"), ("lineitem", "fk_supplier", "FOREIGN KEY", 1, "l_suppkey", "supplier", "s_suppkey"),
    ("conversations", "pk", "PRIMARY KEY", 2, "turn", None, None), ("conversations", "pk", "PRIMARY KEY", 1, "conv_id", None, None), ("categories", "fk_categories", "FOREIGN KEY", 1, "parent_id", "categories", "category_id"),
]
KEY_COLUMNS = "table_name name kind place column_name to_table to_column"
KEYS_SQL = f"(select * from ({sql_values(KEYS)}) v({', '.join(KEY_COLUMNS.split())}))"


#: A database with the keys above, and indexes; what SQLite's catalog says of it is read by the catalog reader.
SCHEMA_SQL = """
create table region (r_regionkey int primary key, r_name text);
create table nation (n_nationkey int primary key, n_name text, n_regionkey int, constraint fk_region foreign key (n_regionkey) references region (r_regionkey));
create table customer (c_custkey bigint primary key, c_name text, c_nationkey int, constraint fk_nation foreign key (c_nationkey) references nation (n_nationkey));
create table supplier (s_suppkey bigint primary key, s_nationkey int, constraint fk_nation foreign key (s_nationkey) references nation (n_nationkey));
create table part (p_partkey bigint primary key, p_name text);
create table orders (o_orderkey bigint primary key, o_custkey bigint, o_orderdate timestamp, constraint fk_customer foreign key (o_custkey) references customer (c_custkey));
create table lineitem (l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, constraint fk_orders foreign key (l_orderkey) references orders (o_orderkey),
  constraint fk_part foreign key (l_partkey) references part (p_partkey), constraint fk_supplier foreign key (l_suppkey) references supplier (s_suppkey));
create table conversations (turn bigint, conv_id bigint, role text, constraint pk primary key (conv_id, turn));
create table categories (category_id int, parent_id int, constraint fk_parent foreign key (parent_id) references categories (category_id));
create index ix_cust on orders (o_custkey); create index ix_cust_date on orders (o_custkey, o_orderdate); create unique index ux_name on customer (c_name);
"""


def sqlite_tables() -> list[Table]:
    import sqlite3

    from sparkferry.sources import sqlite_catalog

    with sqlite3.connect(":memory:") as c:
        c.executescript(SCHEMA_SQL)
        return [sqlite_catalog.describe(c, name) for (name,) in c.execute("select name from sqlite_master where type = 'table' order by name").fetchall()]


def catalog_keys(spark):
    """The keys and references that the catalog reader finds, a row for each column. A key without a name of its own is `pk`, a reference without one is named by its target."""
    rows = []
    for t in sqlite_tables():
        rows += [(t.name, "pk", "PRIMARY KEY", i + 1, c, None, None) for i, c in enumerate(t.key)]
        rows += [(t.name, f"fk_{c.to_table}", "FOREIGN KEY", i + 1, a, c.to_table, b) for c in t.foreign_keys for i, (a, b) in enumerate(zip(c.columns, c.to_columns, strict=True))]
    return relation(spark, KEY_COLUMNS, rows)


def grouped_columns(rows: DataFrame, by: list[str], place: str, column: str, to: str) -> DataFrame:
    """Columns of each index or constraint, in their places, as one comma-joined string."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, column))), lambda x: x[column]), ",").alias(to))


@register("table_columns", "select 'orders' as table_name, column_name, ordinal from (values ('o_orderkey', 1), ('o_custkey', 2), ('o_orderstatus', 3), ('o_totalprice', 4), ('o_orderdate', 5), ('o_orderpriority', 6)) v(column_name, ordinal)")
def table_columns(spark, sf_dir):
    from sparkferry.sources.stores import ParquetStore

    t = ParquetStore(spark, sf_dir).describe("orders")
    return relation(spark, "table_name column_name ordinal", [(t.name, c.name, c.ordinal + 1) for c in t.columns])


@register("pk_columns", f"select table_name, string_agg(column_name, ',' order by place) as key_columns from {KEYS_SQL} where kind = 'PRIMARY KEY' group by table_name")
def pk_columns(spark, sf_dir):
    return grouped_columns(catalog_keys(spark).where("kind = 'PRIMARY KEY'"), ["table_name"], "place", "column_name", "key_columns")


@register("constraint_columns", f"select table_name, name, kind, string_agg(column_name, ',' order by place) as columns, max(to_table) as to_table from {KEYS_SQL} group by all")
def constraint_columns(spark, sf_dir):
    rows = catalog_keys(spark)
    return grouped_columns(rows, ["table_name", "name", "kind", "to_table"], "place", "column_name", "columns").select("table_name", "name", "kind", "columns", "to_table")


INDEXES = [("orders", "ix_cust", 1, "o_custkey", 0), ("orders", "ix_cust_date", 2, "o_orderdate", 0), ("orders", "ix_cust_date", 1, "o_custkey", 0), ("customer", "ux_name", 1, "c_name", 1)]


@register("index_columns", f"select table_name, name, is_unique, string_agg(column_name, ',' order by place) as columns from ({sql_values(INDEXES)}) v(table_name, name, place, column_name, is_unique) group by all")
def index_columns(spark, sf_dir):
    rows = [(t.name, i.name, k + 1, c, int(i.unique)) for t in sqlite_tables() for i in t.indexes if not i.primary for k, c in enumerate(i.columns)]
    return grouped_columns(relation(spark, "table_name name place column_name is_unique", rows), ["table_name", "name", "is_unique"], "place", "column_name", "columns")


@register("fk_dependencies", f"select distinct table_name, to_table from {KEYS_SQL} where kind = 'FOREIGN KEY' and table_name <> to_table and to_table in (select table_name from {KEYS_SQL})")
def fk_dependencies(spark, sf_dir):
    rows = catalog_keys(spark)
    inside = rows.select(F.col("table_name").alias("to_table")).distinct()
    return rows.where("kind = 'FOREIGN KEY' and table_name <> to_table").select("table_name", "to_table").distinct().join(inside, "to_table", "left_semi").select("table_name", "to_table")


_EDGES_SQL = f"(select distinct table_name as src, to_table as dst from {KEYS_SQL} where kind = 'FOREIGN KEY' and table_name <> to_table)"


@register(
    "fk_levels",
    f"""with recursive e as (select * from {_EDGES_SQL}), t as (select distinct table_name as name from {KEYS_SQL}),
reach(name, level) as (select name, 0 from t union all select e.src, level + 1 from reach join e on e.dst = reach.name)
select name as "table", max(level) as level from reach group by name""",
)
def fk_levels(spark, sf_dir):
    rows = catalog_keys(spark)
    edges = rows.where("kind = 'FOREIGN KEY' and table_name <> to_table").select(F.col("table_name").alias("src"), F.col("to_table").alias("dst")).distinct()
    return graph.level_frame(rows.select(F.col("table_name").alias("name")).distinct(), edges)


_ORDER = ["categories", "conversations", "part", "region", "nation", "customer", "orders", "supplier", "lineitem"]


@register("fk_order", f"select * from ({sql_values([(i, t) for i, t in enumerate(_ORDER)])}) v(place, table_name)")
def fk_order(spark, sf_dir):
    found = sqlite_tables()
    return relation(spark, "place table_name", list(enumerate(graph.ordered([t.name for t in found], graph.edges_of(found)))))


# --- types and definitions -------------------------------------------------------------------------------------------

TYPE_NAMES = ["CHAR(8)", "bigint(20) unsigned", "character varying(40)", "Double Precision", "time(2) without time zone", "smallint", "POINT", "NUMERIC( 12 , 4 )", "tinyint(1)", "tinyint(4)", "set('x','y')", "enum('on','off')", "mediumtext", "varbinary(16)", "datetime(3)", "year", "float", "json", "hstore"]
#: Canonical names that a type's spelling must lead to.
NORMALIZED = [
    ("CHAR(8)", "char"), ("bigint(20) unsigned", "bigint"), ("character varying(40)", "varchar"), ("Double Precision", "double"), ("time(2) without time zone", "time"), ("smallint", "smallint"), ("POINT", "point"),
    ("NUMERIC( 12 , 4 )", "numeric"), ("tinyint(1)", "tinyint"), ("tinyint(4)", "tinyint"), ("set('x','y')", "set('x','y')"), ("enum('on','off')", "enum('on','off')"), ("mediumtext", "mediumtext"), ("varbinary(16)", "varbinary"),
    ("datetime(3)", "datetime"), ("year", "year"), ("float", "float"), ("json", "json"), ("hstore", "hstore"),
]


@register("normalize_types", f"select * from ({sql_values(NORMALIZED)}) v(type, normal)")
def normalize_types(spark, sf_dir):
    return relation(spark, "type", [(t,) for t in TYPE_NAMES]).select("type", normalized(F.col("type")).alias("normal"))


#: What each of the names must become; written out, so that a wrong rule shows.
MAPPED = [
    ("CHAR(8)", "char", "CHAR", "apply_source"), ("bigint(20) unsigned", "bigint", "BIGINT", "apply_source"), ("character varying(40)", "varchar", "VARCHAR", "apply_source"), ("Double Precision", "double", "DOUBLE PRECISION", "apply_source"),
    ("time(2) without time zone", "time", "TIME WITHOUT TIME ZONE", "apply_source"), ("smallint", "smallint", "SMALLINT", "apply_source"), ("POINT", "point", "point", "ignore_source"), ("NUMERIC( 12 , 4 )", "numeric", "NUMERIC", "apply_source"),
    ("tinyint(1)", "tinyint", "BOOLEAN", "use_target_defined"), ("tinyint(4)", "tinyint", "SMALLINT", "apply_source"), ("set('x','y')", "set", "TEXT", "ignore_source"), ("enum('on','off')", "enum", "VARCHAR(255)", "use_target_defined"),
    ("mediumtext", "mediumtext", "TEXT", "ignore_source"), ("varbinary(16)", "varbinary", "BYTEA", "apply_source"), ("datetime(3)", "datetime", "TIMESTAMP WITHOUT TIME ZONE", "apply_source"), ("year", "year", "SMALLINT", "ignore_source"),
    ("float", "float", "REAL", "apply_source"), ("json", "json", "JSONB", "ignore_source"), ("hstore", "hstore", "TEXT", None),
]


@register("map_types", f"select * from ({sql_values(MAPPED)}) v(type, key, target, strategy)")
def map_types(spark, sf_dir):
    return map_columns(relation(spark, "type", [(t,) for t in TYPE_NAMES]), spark, "mysql", "postgres").select("type", "key", "target", "strategy")


ACTIONS = ["", "no action", "CASCADE", " restrict ", "Set Null", "do nothing"]


@register("normalize_fk_action", f"select raw, case when trim(raw) = '' then 'NO ACTION' else upper(trim(raw)) end as action from ({sql_values([(a,) for a in ACTIONS])}) v(raw)")
def normalize_fk_action(spark, sf_dir):
    return relation(spark, "raw action", [(a, D.action(a)) for a in ACTIONS])


DEFAULTS = [
    ("CURRENT_TIMESTAMP(6) ON UPDATE CURRENT_TIMESTAMP(6)", "mysql", "current_timestamp"), ("b'0'", "mysql", "0"), ("'new order'::character varying", "postgres", "new order"), ("('42'::text)::bigint", "postgres", "42"),
    ("nextval('orders_seq'::regclass)", "postgres", "nextval"), ("null", "sqlite", "null"), ("ON", "mysql", "1"), ("uuid_generate_v4()", "postgres", "uuid_function"), ("", "sqlite", ""), ("-0.5", "sqlite", "-0.5"),
]


@register("normalize_defaults", f"select * from ({sql_values(DEFAULTS)}) v(raw, dialect, normal)")
def normalize_defaults(spark, sf_dir):
    return relation(spark, "raw dialect normal", [(r, d, D.default(r, d)) for r, d, _ in DEFAULTS])


# --- differences and statements --------------------------------------------------------------------------------------

WANT = [("users", "id", "int", 0, None), ("users", "name", "varchar", 0, "x"), ("users", "age", "smallint", 1, None), ("posts", "id", "int", 0, None), ("posts", "body", "text", 1, None)]
HAVE = [("users", "id", "int", 0, None), ("users", "name", "varchar", 1, None), ("users", "old", "text", 1, None), ("posts", "id", "bigint", 0, None), ("posts", "body", "text", 1, None)]
_DIFF_COLUMNS = "table_name column_name type nullable default_text"


def _diff_sql(want, have, columns, key, properties):
    names = columns.split()
    lists = [f"(select * from ({sql_values(x)}) v({', '.join(names)}))" for x in (want, have)]
    on = " and ".join(f"a.{k} is not distinct from b.{k}" for k in key)
    parts = ", ".join(f"case when a.{p} is distinct from b.{p} then '{p}' end" for p in properties)
    both = f"a.{key[0]} is not null and b.{key[0]} is not null"
    keys = ", ".join(f"coalesce(a.{k}, b.{k}) as {k}" for k in key)
    changed = f"case when {both} then concat_ws(',', {parts}) else '' end"
    return f"select {keys}, case when b.{key[0]} is null then 'ADD' when a.{key[0]} is null then 'DROP' when {changed} <> '' then 'MODIFY' else 'KEEP' end as action, {changed} as changed from {lists[0]} a full join {lists[1]} b on {on}"


@register("schema_diff_columns", _diff_sql(WANT, HAVE, _DIFF_COLUMNS, ["table_name", "column_name"], ["type", "nullable", "default_text"]))
def schema_diff_columns(spark, sf_dir):
    return schema_diff.compare(relation(spark, _DIFF_COLUMNS, WANT), relation(spark, _DIFF_COLUMNS, HAVE), ["table_name", "column_name"], ["type", "nullable", "default_text"])


WANT_RULES = [("posts", "fk_user", "FOREIGN KEY", "user_id", "users", "CASCADE"), ("posts", "uq_slug", "UNIQUE", "slug", None, None), ("posts", "chk_views", "CHECK", "views >= 0", None, None)]
HAVE_RULES = [("posts", "fk_user", "FOREIGN KEY", "user_id", "users", "NO ACTION"), ("posts", "uq_slug", "UNIQUE", "slug", None, None), ("posts", "uq_title", "UNIQUE", "title", None, None)]
_RULE_COLUMNS = "table_name name kind columns to_table on_delete"


@register("schema_diff_constraints", _diff_sql(WANT_RULES, HAVE_RULES, _RULE_COLUMNS, ["table_name", "name"], ["kind", "columns", "to_table", "on_delete"]))
def schema_diff_constraints(spark, sf_dir):
    return schema_diff.compare(relation(spark, _RULE_COLUMNS, WANT_RULES), relation(spark, _RULE_COLUMNS, HAVE_RULES), ["table_name", "name"], ["kind", "columns", "to_table", "on_delete"])


BLOG = Table(
    "posts", "mysql",
    (Column("id", "int(11)", False, True, auto_increment=True, ordinal=1), Column("user_id", "int", False, ordinal=2), Column("title", "varchar(200)", False, length=200, ordinal=3),
     Column("views", "int", True, default="0", ordinal=4), Column("live", "tinyint(1)", False, default="1", ordinal=5), Column("at", "datetime", True, default="CURRENT_TIMESTAMP", ordinal=6)),
    (Index("ix_views", ("views",)), Index("ux_title", ("title",), True)),
    (Constraint("pk", "PRIMARY KEY", ("id",)), Constraint("fk_user", "FOREIGN KEY", ("user_id",), "", "users", ("id",), "CASCADE", ""), Constraint("chk_views", "CHECK", (), "views >= 0")),
)
OLD_BLOG = Table(
    "posts", "postgres",
    (Column("id", "integer", False, True, auto_increment=True, ordinal=1), Column("title", "character varying(100)", True, length=100, ordinal=2), Column("gone", "text", ordinal=3), Column("views", "integer", True, default="0", ordinal=4),
     Column("live", "boolean", False, default="true", ordinal=5), Column("at", "timestamp without time zone", True, default="now()", ordinal=6)),
    (Index("ix_old", ("gone",)), Index("ux_title", ("title",), True)), (Constraint("chk_views", "CHECK", (), "(views > 0)"),),
)
_STATEMENTS = [
    ("DROP_CONSTRAINT", 'ALTER TABLE "posts" DROP CONSTRAINT IF EXISTS "chk_views"'), ("DROP_INDEX", 'DROP INDEX IF EXISTS "ix_old"'), ("ALTER_COLUMN", 'ALTER TABLE "posts" DROP COLUMN IF EXISTS "gone"'),
    ("ALTER_COLUMN", 'ALTER TABLE "posts" ALTER COLUMN "title" SET NOT NULL'), ("ALTER_COLUMN", 'ALTER TABLE "posts" ALTER COLUMN "title" TYPE VARCHAR(200) USING CAST("title" AS VARCHAR)'),
    ("ALTER_COLUMN", 'ALTER TABLE "posts" ADD COLUMN "user_id" INTEGER NOT NULL'), ("ADD_INDEX", 'CREATE INDEX IF NOT EXISTS "ix_views" ON "posts" ("views")'),
    ("ADD_CONSTRAINT", 'ALTER TABLE "posts" ADD CONSTRAINT "chk_views" CHECK (views >= 0)'),
    ("DEFERRED", 'ALTER TABLE "posts" ADD CONSTRAINT "fk_user" FOREIGN KEY ("user_id") REFERENCES "users" ("id") ON DELETE CASCADE DEFERRABLE INITIALLY DEFERRED'),
]


@register("ddl_alter", f"select * from ({sql_values([(i, *s) for i, s in enumerate(_STATEMENTS)])}) v(place, phase, statement)")
def ddl_alter(spark, sf_dir):
    made = schema_diff.plan(BLOG, OLD_BLOG, "postgres").statements
    return relation(spark, "place phase statement", [(i, s.phase.name, s.sql) for i, s in enumerate(made)])


_CREATED = [
    ("mysql", "DROP_TABLE", "DROP TABLE IF EXISTS `posts`"),
    ("mysql", "CREATE_TABLE", "CREATE TABLE `posts` (`id` int(11) AUTO_INCREMENT NOT NULL, `user_id` int NOT NULL, `title` varchar(200) NOT NULL, `views` int DEFAULT 0, `live` tinyint(1) DEFAULT '1' NOT NULL, `at` datetime DEFAULT CURRENT_TIMESTAMP, PRIMARY KEY (`id`))"),
    ("mysql", "ADD_INDEX", "CREATE INDEX `ix_views` ON `posts` (`views`)"), ("mysql", "ADD_INDEX", "CREATE UNIQUE INDEX `ux_title` ON `posts` (`title`)"),
    ("mysql", "ADD_CONSTRAINT", "ALTER TABLE `posts` ADD CONSTRAINT `chk_views` CHECK (views >= 0)"),
    ("mysql", "ADD_CONSTRAINT", "ALTER TABLE `posts` ADD CONSTRAINT `fk_user` FOREIGN KEY (`user_id`) REFERENCES `users` (`id`) ON DELETE CASCADE"),
    ("postgres", "DROP_TABLE", 'DROP TABLE IF EXISTS "posts" CASCADE'),
    ("postgres", "CREATE_TABLE", 'CREATE TABLE IF NOT EXISTS "posts" ("id" INTEGER GENERATED BY DEFAULT AS IDENTITY NOT NULL, "user_id" INTEGER NOT NULL, "title" VARCHAR(200) NOT NULL, "views" INTEGER DEFAULT 0, "live" BOOLEAN DEFAULT TRUE NOT NULL, "at" TIMESTAMP WITHOUT TIME ZONE DEFAULT CURRENT_TIMESTAMP, PRIMARY KEY ("id"))'),
    ("postgres", "ADD_INDEX", 'CREATE INDEX IF NOT EXISTS "ix_views" ON "posts" ("views")'), ("postgres", "ADD_INDEX", 'CREATE UNIQUE INDEX IF NOT EXISTS "ux_title" ON "posts" ("title")'),
    ("postgres", "ADD_CONSTRAINT", 'ALTER TABLE "posts" ADD CONSTRAINT "chk_views" CHECK (views >= 0)'),
    ("postgres", "DEFERRED", 'ALTER TABLE "posts" ADD CONSTRAINT "fk_user" FOREIGN KEY ("user_id") REFERENCES "users" ("id") ON DELETE CASCADE DEFERRABLE INITIALLY DEFERRED'),
]


@register("ddl_create", f"select dialect, cast(row_number() over (partition by dialect order by n) - 1 as integer) as place, phase, statement from ({sql_values([(i, *c) for i, c in enumerate(_CREATED)])}) v(n, dialect, phase, statement)")
def ddl_create(spark, sf_dir):
    rows = [(dst, i, s.phase.name, s.sql) for dst in ("mysql", "postgres") for i, s in enumerate(schema_diff.plan(BLOG, None, dst, "drop_create").statements)]
    return relation(spark, "dialect place phase statement", rows)


_KINDS = [("fk_b", "FOREIGN KEY"), ("uq_a", "UNIQUE"), ("chk_c", "CHECK"), ("pk_d", "PRIMARY KEY"), ("fk_a", "FOREIGN KEY")]


@register(
    "ddl_order",
    f"""select 'add' as list, cast(row_number() over (order by case kind when 'PRIMARY KEY' then 1 when 'UNIQUE' then 2 when 'CHECK' then 3 else 4 end, name) - 1 as integer) as place, name from ({sql_values(_KINDS)}) v(name, kind)
union all select 'drop', cast(row_number() over (order by case kind when 'FOREIGN KEY' then 1 when 'UNIQUE' then 2 when 'CHECK' then 3 else 4 end, name) - 1 as integer), name from ({sql_values(_KINDS)}) v(name, kind)""",
)
def ddl_order(spark, sf_dir):
    lists = {"add": (ddl.Phase.ADD_CONSTRAINT, ddl.ADD_RANK), "drop": (ddl.Phase.DROP_CONSTRAINT, ddl.DROP_RANK)}
    rows = [(k, i, s.name) for k, (phase, rank) in lists.items() for i, s in enumerate(ddl.in_order([ddl.Statement(phase, rank[kind], n, n) for n, kind in _KINDS]))]
    return relation(spark, "list place name", rows)


# --- runs ------------------------------------------------------------------------------------------------------------

def _folder(spark: SparkSession) -> str:
    """A new folder where the session keeps what driver and executors share, or a temporary one in a local session that names none."""
    import os
    import tempfile

    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", "").removeprefix("file:").replace("//", "/")
    if at.startswith("/"):
        os.makedirs(at, exist_ok=True)
    return tempfile.mkdtemp(prefix="sparkferry-run-", dir=at if at.startswith("/") else None)


_SHOP = """
create table nation (n_nationkey int primary key, n_name text not null);
create table customer (c_custkey bigint primary key, c_name varchar(40) not null, c_nationkey int references nation (n_nationkey), c_acctbal double, c_mktsegment text default 'NONE');
create index ix_nation on customer (c_nationkey);
"""


def synced(spark: SparkSession, sf_dir: str):
    """A run between two databases: the source has nations and customers; the destination, customers that have gone stale, one of its own, and
    no column for the segment. Returns the results and the destination."""
    import sqlite3

    from sparkferry.plans.config import Config
    from sparkferry.sources.stores import SqliteStore

    folder = _folder(spark)
    for name, script in (("source", _SHOP), ("copy", _SHOP.replace(", c_mktsegment text default 'NONE'", ""))):
        with sqlite3.connect(f"{folder}/{name}.db") as c:
            c.executescript(script)
    source, copy = (SqliteStore(spark, f"{folder}/{n}.db") for n in ("source", "copy"))
    nation, customer = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "customer")
    source.save("nation", nation, [], None)
    source.save("customer", customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), [], None)
    copy.save("nation", nation.where("n_nationkey < 5"), [], None)
    own = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("own").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(0.5).alias("c_acctbal"))
    copy.save("customer", customer.where("c_custkey % 3 = 0").select("c_custkey", F.lit("stale").alias("c_name"), F.lit(2).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal")).unionByName(own), [], None)
    return runner.run(source, copy, Config(source="sqlite", destination="sqlite", strategy="alter", retries=0, workers=2)), copy


@register("e2e_sqlite", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer union all select -1, 'own', 1, 0.5, 'NONE'")
def e2e_sqlite(spark, sf_dir):
    return synced(spark, sf_dir)[1].read("customer")


@register("e2e_results", "select 'customer' as \"table\", 'ok' as status, count(*) as rows from customer union all select 'nation', 'ok', count(*) from nation")
def e2e_results(spark, sf_dir):
    return runner.results_frame(spark, synced(spark, sf_dir)[0]).select("table", "status", "rows")


_OUTCOMES = [("users", "ok"), ("posts", "constraint_failed"), ("tags", "skipped")]


def _results():
    return [Result("users", rows=4, batches=1), Result("posts", constraint_error="orphans", rows=2, batches=1), Result("tags", skipped="no such table")]


@register("sync_results", f"select status, count(*) as n from ({sql_values(_OUTCOMES)}) v(name, status) group by status")
def sync_results(spark, sf_dir):
    return runner.results_frame(spark, _results()).groupBy("status").agg(F.count("*").alias("n"))


@register("exit_code", f"select cast(case when bool_or(status = 'failed') then 1 when bool_or(status = 'constraint_failed') then 2 when bool_and(status = 'skipped') then 3 else 0 end as integer) as exit_code from ({sql_values(_OUTCOMES)}) v(name, status)")
def exit_code(spark, sf_dir):
    return runner.exit_code_frame(runner.results_frame(spark, _results()))
