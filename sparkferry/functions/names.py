"""Quoting of identifiers."""

from __future__ import annotations


def _mark(dialect: str) -> str:
    return "`" if dialect.lower() in ("mysql", "spark") else '"'


def quote(name: str, dialect: str) -> str:
    q = _mark(dialect)
    return q + name.replace(q, q + q) + q


def unquote(text: str, dialect: str) -> str:
    """The name within a quoted identifier; other text is only trimmed."""
    text, q = text.strip(), _mark(dialect)
    if len(text) < 2 or text[0] != q or text[-1] != q:
        return text
    return text[1:-1].replace(q + q, q)


SYSTEM_PREFIXES = {"postgres": ("pg_", "sql_"), "sqlite": ("sqlite_",)}
SYSTEM_SCHEMAS = {"mysql": ("information_schema", "mysql", "performance_schema", "sys")}


def is_system_table(name: str, dialect: str) -> bool:
    """A table of the database itself, which is never copied."""
    low = name.lower()
    return low.startswith(SYSTEM_PREFIXES.get(dialect, ())) if dialect in SYSTEM_PREFIXES else low in SYSTEM_SCHEMAS.get(dialect, ())
