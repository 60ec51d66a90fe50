"""Catalog queries of MySQL and PostgreSQL, each with the same result columns, and the tables that their rows make.

Each query is one read by JDBC; what the database can filter, join and order it does. A query that fails for indexes or
constraints gives none, as a table without them can still be copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from itertools import groupby

from sparkferry.plans.model import Column, Constraint, Index, Table
from sparkferry.sources.sqlite_catalog import index_columns

COLUMNS = {
    "mysql": """select column_name as name, column_type as type, case is_nullable when 'YES' then 1 else 0 end as nullable, column_default as default_text,
  case when extra like '%auto_increment%' then 1 else 0 end as auto_increment, nullif(generation_expression, '') as generated, ordinal_position as ordinal,
  character_maximum_length as length, coalesce(numeric_precision, datetime_precision) as prec, numeric_scale as scale, collation_name as collation, nullif(column_comment, '') as note,
  case column_key when 'PRI' then 1 else 0 end as primary_key
from information_schema.columns where table_schema = database() and table_name = '{table}' order by ordinal_position""",
    "postgres": """select c.column_name as name, format_type(a.atttypid, a.atttypmod) as type, case c.is_nullable when 'YES' then 1 else 0 end as nullable, c.column_default as default_text,
  case when c.is_identity = 'YES' or c.column_default like 'nextval(%' then 1 else 0 end as auto_increment, nullif(c.generation_expression, '') as generated, c.ordinal_position as ordinal,
  c.character_maximum_length as length, coalesce(c.numeric_precision, c.datetime_precision) as prec, c.numeric_scale as scale, c.collation_name as collation, col_description(a.attrelid, a.attnum) as note,
  case when exists (select 1 from pg_index i where i.indrelid = a.attrelid and i.indisprimary and a.attnum = any(i.indkey)) then 1 else 0 end as primary_key
from information_schema.columns c
join pg_class t on t.relname = c.table_name join pg_namespace n on n.oid = t.relnamespace and n.nspname = c.table_schema
join pg_attribute a on a.attrelid = t.oid and a.attname = c.column_name
where c.table_schema = current_schema() and c.table_name = '{table}' order by c.ordinal_position""",
}

INDEXES = {
    "mysql": """select index_name as name, seq_in_index as place, column_name as column_name, 1 - non_unique as is_unique, case index_name when 'PRIMARY' then 1 else 0 end as is_primary, '' as definition
from information_schema.statistics where table_schema = database() and table_name = '{table}'""",
    "postgres": """select i.relname as name, 0 as place, null as column_name, case when x.indisunique then 1 else 0 end as is_unique, case when x.indisprimary then 1 else 0 end as is_primary, pg_get_indexdef(x.indexrelid) as definition
from pg_index x join pg_class i on i.oid = x.indexrelid join pg_class t on t.oid = x.indrelid join pg_namespace n on n.oid = t.relnamespace
where n.nspname = current_schema() and t.relname = '{table}'""",
}

CONSTRAINTS = {
    "mysql": """select c.constraint_name as name, c.constraint_type as kind, coalesce(k.ordinal_position, 1) as place, k.column_name as column_name, h.check_clause as definition,
  k.referenced_table_name as to_table, k.referenced_column_name as to_column, r.delete_rule as on_delete, r.update_rule as on_update
from information_schema.table_constraints c
left join information_schema.key_column_usage k on k.constraint_schema = c.constraint_schema and k.constraint_name = c.constraint_name and k.table_name = c.table_name
left join information_schema.referential_constraints r on r.constraint_schema = c.constraint_schema and r.constraint_name = c.constraint_name and r.table_name = c.table_name
left join information_schema.check_constraints h on h.constraint_schema = c.constraint_schema and h.constraint_name = c.constraint_name
where c.table_schema = database() and c.table_name = '{table}'""",
    "postgres": """select c.conname as name, case c.contype when 'p' then 'PRIMARY KEY' when 'u' then 'UNIQUE' when 'f' then 'FOREIGN KEY' when 'c' then 'CHECK' end as kind, coalesce(k.place, 1) as place, a.attname as column_name,
  case c.contype when 'c' then pg_get_expr(c.conbin, c.conrelid) end as definition, f.relname as to_table, b.attname as to_column,
  case c.confdeltype when 'c' then 'CASCADE' when 'n' then 'SET NULL' when 'd' then 'SET DEFAULT' when 'r' then 'RESTRICT' end as on_delete,
  case c.confupdtype when 'c' then 'CASCADE' when 'n' then 'SET NULL' when 'd' then 'SET DEFAULT' when 'r' then 'RESTRICT' end as on_update
from pg_constraint c join pg_class t on t.oid = c.conrelid join pg_namespace n on n.oid = t.relnamespace
left join lateral unnest(c.conkey, c.confkey) with ordinality as k(mine, theirs, place) on true
left join pg_attribute a on a.attrelid = c.conrelid and a.attnum = k.mine left join pg_class f on f.oid = c.confrelid
left join pg_attribute b on b.attrelid = c.confrelid and b.attnum = k.theirs
where n.nspname = current_schema() and t.relname = '{table}' and c.contype in ('p', 'u', 'f', 'c')""",
}

Row = Mapping[str, object]


def _number(x) -> int | None:
    return None if x is None else int(x)


def columns_of(rows: Iterable[Row]) -> tuple[Column, ...]:
    return tuple(
        Column(r["name"], r["type"], bool(r["nullable"]), bool(r["primary_key"]), r["default_text"], bool(r["auto_increment"]), r["generated"], int(r["ordinal"]), _number(r["length"]), _number(r["prec"]), _number(r["scale"]), r["collation"], r["note"])
        for r in sorted(rows, key=lambda r: int(r["ordinal"]))
    )


def indexes_of(rows: Iterable[Row]) -> tuple[Index, ...]:
    """One index for each name; columns by place, or from the definition where the catalog doesn't list them."""
    out = []
    for name, group in groupby(sorted(rows, key=lambda r: (r["name"], int(r["place"]))), key=lambda r: r["name"]):
        parts = list(group)
        listed = tuple(r["column_name"] for r in parts if r["column_name"] is not None)
        out.append(Index(name, listed or index_columns(parts[0]["definition"] or ""), bool(parts[0]["is_unique"]), bool(parts[0]["is_primary"]), parts[0]["definition"] or ""))
    return tuple(out)


def constraints_of(rows: Iterable[Row]) -> tuple[Constraint, ...]:
    out = []
    for (name, kind), group in groupby(sorted(rows, key=lambda r: (r["name"], r["kind"], int(r["place"]))), key=lambda r: (r["name"], r["kind"])):
        parts = list(group)
        pick = lambda c: tuple(r[c] for r in parts if r[c] is not None)  # noqa: E731, B023
        one = parts[0]
        out.append(Constraint(name, kind, () if kind == "CHECK" else pick("column_name"), one["definition"] or "", one["to_table"] or "", pick("to_column"), one["on_delete"] or "", one["on_update"] or ""))
    return tuple(out)


def describe(query: Callable[[str], list[Row]], table: str, dialect: str) -> Table | None:
    """A table by its catalog; None without columns. query runs SQL and returns its rows."""
    name = table.replace("'", "''")
    columns = columns_of(query(COLUMNS[dialect].format(table=name)))
    if not columns:
        return None

    def listed(sql: str, make):
        try:
            return make(query(sql.format(table=name)))
        except Exception:
            return ()

    return Table(table, dialect, columns, listed(INDEXES[dialect], indexes_of), listed(CONSTRAINTS[dialect], constraints_of))
