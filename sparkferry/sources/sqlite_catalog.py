"""What a SQLite file says about its tables: pragmas, and the text of CREATE TABLE for what pragmas lack."""

from __future__ import annotations

import base64
import re
import sqlite3

from sparkferry.functions.names import quote
from sparkferry.functions.types import normalize
from sparkferry.plans.model import Column, Constraint, Index, Table


def value(x, kind: str) -> str | None:
    """A value as text for Spark to cast; binary as base64."""
    if x is None:
        return None
    if kind == "binary":
        return base64.b64encode(x if isinstance(x, bytes) else str(x).encode()).decode()
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    return repr(x) if isinstance(x, float) else str(x)


def split_top(text: str) -> list[str]:
    """Parts between commas that are in no parentheses or quotes."""
    out, depth, mark, now = [], 0, "", ""
    for c in text:
        if mark:
            mark = "" if c == mark else mark
        elif c in "'\"`":
            mark = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        if c == "," and not depth and not mark:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out


def inner(text: str) -> str:
    """What stands in the first parentheses that close again."""
    at = text.find("(")
    depth = 0
    for i in range(max(at, 0), len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if at >= 0 and not depth:
            return text[at + 1 : i]
    return ""


def index_columns(definition: str) -> tuple[str, ...]:
    """Column names of an index definition: without order, nulls, collation and operator class; expressions as they are."""
    out = []
    for part in split_top(inner(definition)):
        if part.startswith("("):
            out.append(part)
            continue
        m = re.match(r'^("(?:[^"]|"")+"|`[^`]+`|\w+(?:\([^)]*\))?)', part)
        name = m[1] if m else part
        out.append(name[1:-1].replace('""', '"') if name[:1] in '"`' else name)
    return tuple(out)


def _definitions(sql: str) -> dict[str, str]:
    """Each column's definition text, by lower-case name."""
    out = {}
    for part in split_top(inner(sql)):
        m = re.match(r'^(?:"((?:[^"]|"")+)"|`([^`]+)`|\[([^\]]+)\]|(\w+))\s*(.*)$', part, re.S)
        if m and (m[4] or "").lower() not in ("constraint", "primary", "unique", "check", "foreign"):
            out[(m[1] or m[2] or m[3] or m[4]).lower()] = m[5]
    return out


def _checks(sql: str, table: str) -> list[Constraint]:
    out = []
    for m in re.finditer(r"(?i)(?:constraint\s+[\"`\[]?(\w+)[\"`\]]?\s+)?check\s*(?=\()", sql):
        out.append(Constraint(m[1] or f"chk_{table}_{len(out)}", "CHECK", definition=inner(sql[m.end() :]).strip()))
    return out


def describe(c: sqlite3.Connection, name: str) -> Table | None:
    found = c.execute("select sql from sqlite_master where type = 'table' and name = ?", (name,)).fetchone()
    if found is None:
        return None
    sql, at = found[0] or "", quote(name, "sqlite")
    said = _definitions(sql)
    columns, key = [], {}
    for cid, col, type_, notnull, default, pk, hidden in c.execute(f"pragma table_xinfo({at})"):
        text = said.get(col.lower(), "")
        generated = inner(text[m.end() :]).strip() if hidden in (2, 3) and (m := re.search(r"(?i)\bas\s*(?=\()", text)) else None
        sizes = [int(x) for x in re.findall(r"\d+", inner(type_))] if type_ else []
        kind = normalize(type_ or "")
        text_like = "char" in kind
        columns.append(
            Column(
                col, type_ or "blob", not notnull and not pk, bool(pk), default, bool(pk and re.search(r"(?i)\bautoincrement\b", text)), generated, cid,
                sizes[0] if sizes and text_like else None, sizes[0] if sizes and not text_like else None, sizes[1] if len(sizes) > 1 else None,
                m[1] if (m := re.search(r"(?i)\bcollate\s+[\"`]?(\w+)", text)) else None,
            )
        )
        if pk:
            key[pk] = col
    constraints = [Constraint(f"pk_{name}", "PRIMARY KEY", tuple(key[k] for k in sorted(key)))] if key else []
    indexes = []
    for _, index, unique, origin, _partial in c.execute(f"pragma index_list({at})"):
        cols = tuple(r[2] for r in c.execute(f"pragma index_info({quote(index, 'sqlite')})"))
        if origin == "c":
            text = c.execute("select sql from sqlite_master where type = 'index' and name = ?", (index,)).fetchone()
            indexes.append(Index(index, tuple(x if x is not None else y for x, y in zip(cols, index_columns(text[0]), strict=False)) if None in cols else cols, bool(unique), False, text[0] or ""))
        elif origin == "u":  # the index that SQLite makes for a UNIQUE: the constraint is what is kept
            constraints.append(Constraint(f"uq_{name}_{'_'.join(map(str, cols))}", "UNIQUE", cols))
    links: dict[int, list] = {}
    for row in c.execute(f"pragma foreign_key_list({at})"):
        links.setdefault(row[0], []).append(row)
    for k, rows in sorted(links.items()):
        rows.sort(key=lambda r: r[1])
        to = tuple(r[4] for r in rows)
        if None in to:  # the referenced table's own key
            other = [(r[5], r[1]) for r in c.execute(f"pragma table_info({quote(rows[0][2], 'sqlite')})") if r[5]]
            to = tuple(n for _, n in sorted(other))
        constraints.append(Constraint(f"fk_{name}_{k}", "FOREIGN KEY", tuple(r[3] for r in rows), "", rows[0][2], to, rows[0][6], rows[0][5]))
    return Table(name, "sqlite", tuple(columns), tuple(sorted(indexes, key=lambda i: i.name)), tuple(constraints + _checks(sql, name)))
