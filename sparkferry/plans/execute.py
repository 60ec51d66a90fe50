"""Running statements against a database, phase by phase, and reading statements from text."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from sparkferry.functions.names import unquote
from sparkferry.functions.tokens import Token, statements, written
from sparkferry.plans import ddl
from sparkferry.plans.ddl import Phase, Statement

# Error codes and texts that mean that a thing to be made is there already, or that a thing to be dropped is not.
THERE = {"postgres": ("42P07", "42710", "42P16"), "mysql": ("1050", "1060", "1061", "1022", "1826", "3822"), "sqlite": ("already exists", "duplicate column name")}
ABSENT = {"postgres": ("42704", "42P01", "42703"), "mysql": ("1051", "1091"), "sqlite": ("no such table", "no such index", "no such column")}
DROPS = (Phase.DROP_CONSTRAINT, Phase.DROP_INDEX, Phase.DROP_TABLE)


def ignorable(error: str, statement: Statement, dialect: str) -> bool:
    """Whether a failed statement has nothing left to do: its object is there, or gone, already."""
    drops = statement.phase in DROPS or " DROP " in f" {statement.sql.upper()} " and statement.phase == Phase.ALTER_COLUMN
    return any(re.search(rf"(?<!\w){re.escape(mark)}(?!\w)", error, re.I) for mark in (ABSENT if drops else THERE).get(dialect, ()))


class Failed(RuntimeError):
    """Statements that failed, with their errors."""

    def __init__(self, errors: list[tuple[Statement, Exception]]):
        super().__init__("; ".join(f"{s.sql}: {e}" for s, e in errors))
        self.errors = errors


def execute(statements: list[Statement], run: Callable[[str], object], dialect: str) -> int:
    """Runs statements in their order; the number that did something. Tables and columns stop at the first error; a phase
    of indexes or constraints goes on to its end and then raises all its errors, so that a transaction around it fails. PostgreSQL
    ends a transaction at the first error, so there each statement has a savepoint to go back to."""
    savepoints = dialect == "postgres"
    done = 0
    errors: list[tuple[Statement, Exception]] = []
    phase = None
    for s in ddl.in_order(list(statements)):
        if errors and s.phase != phase:
            break
        phase = s.phase
        if savepoints:
            run("SAVEPOINT statement")
        try:
            run(s.sql)
            done += 1
            if savepoints:
                run("RELEASE SAVEPOINT statement")
        except Exception as e:
            if savepoints:
                run("ROLLBACK TO SAVEPOINT statement")
            if ignorable(str(e), s, dialect):
                continue
            errors.append((s, e))
            if s.phase in (Phase.DROP_TABLE, Phase.CREATE_TABLE, Phase.ALTER_COLUMN):
                break
    if errors:
        raise Failed(errors)
    return done


#: What the words that begin a statement, or an ALTER TABLE's action, make of it.
STARTS = {
    ("CREATE", "TABLE"): Phase.CREATE_TABLE, ("DROP", "TABLE"): Phase.DROP_TABLE, ("CREATE", "INDEX"): Phase.ADD_INDEX, ("CREATE", "UNIQUE", "INDEX"): Phase.ADD_INDEX, ("DROP", "INDEX"): Phase.DROP_INDEX,
}
ACTIONS = {
    ("ADD", "CONSTRAINT"): Phase.ADD_CONSTRAINT, ("DROP", "CONSTRAINT"): Phase.DROP_CONSTRAINT, ("DROP", "FOREIGN", "KEY"): Phase.DROP_CONSTRAINT, ("DROP", "CHECK"): Phase.DROP_CONSTRAINT,
    ("DROP", "PRIMARY", "KEY"): Phase.DROP_CONSTRAINT, ("ADD", "COLUMN"): Phase.ALTER_COLUMN, ("DROP", "COLUMN"): Phase.ALTER_COLUMN, ("MODIFY", "COLUMN"): Phase.ALTER_COLUMN, ("ALTER", "COLUMN"): Phase.ALTER_COLUMN,
}
KINDS = (("PRIMARY", "KEY"), ("FOREIGN", "KEY"), ("UNIQUE",), ("CHECK",))


def split(text: str) -> list[str]:
    """Statements of a script, without comments; semicolons and dashes within quotes are text."""
    return [written(s) for s in statements(text)]


def _leads(found: list[Token], forms) -> tuple[str, ...] | None:
    return next((f for f in forms if tuple(t.text.upper() for t in found[: len(f)]) == f), None)


def _name(found: list[Token], dialect: str) -> tuple[str, list[Token]]:
    """The name that comes next, after IF [NOT] EXISTS, and what follows it."""
    while found and found[0].text.upper() in ("IF", "NOT", "EXISTS"):
        found = found[1:]
    n = 1
    while n + 1 < len(found) and found[n].text == ".":  # schema.table
        n += 2
    return (unquote(found[n - 1].text, dialect) if found[n - 1].text[:1] != '"' else found[n - 1].content) if found else "", found[n:]


def parse(text: str, dialect: str, kinds: Mapping[str, str] | None = None) -> list[Statement]:
    """A script as typed statements. Raises ValueError for a statement of no known kind.

    A constraint's kind is what its statement says. A plain DROP CONSTRAINT says none: `kinds` (constraint names to kinds, from a
    catalog) may, and a constraint that it lacks is dropped after those of known kinds.
    """
    out = []
    for found in statements(text):
        sql = written(found)
        if form := _leads(found, STARTS):
            name, _ = _name(found[len(form) :], dialect)
            out.append(Statement(STARTS[form], 0, name, sql))
            continue
        _, rest = _name(found[2:], dialect) if _leads(found, [("ALTER", "TABLE")]) else ("", [])
        form = _leads(rest, ACTIONS)
        if form is None:
            raise ValueError(f"unknown statement: {sql}")
        phase = ACTIONS[form]
        if phase == Phase.ALTER_COLUMN:
            name, _ = _name(rest[len(form) :], dialect)
            rank = ddl.COLUMN_RANK.get(form[0], ddl.COLUMN_RANK["MODIFY"])
        elif form == ("DROP", "PRIMARY", "KEY"):
            name, rank = "PRIMARY", ddl.DROP_RANK["PRIMARY KEY"]
        else:
            name, body = _name(rest[len(form) :], dialect)
            said = _leads(rest[1:], KINDS) or _leads(body, KINDS)
            kind = " ".join(said) if said else (kinds or {}).get(name, "")
            rank = (ddl.ADD_RANK if phase == Phase.ADD_CONSTRAINT else ddl.DROP_RANK).get(kind, 5)
            if phase == Phase.ADD_CONSTRAINT and [t.text.upper() for t in found[-3:]] == ["DEFERRABLE", "INITIALLY", "DEFERRED"]:
                phase = Phase.DEFERRED
        out.append(Statement(phase, rank, name, sql))
    return out
