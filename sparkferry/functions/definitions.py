"""Canonical text of defaults, actions, checks, indexes and generation expressions, so that two catalogs can be compared."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from sparkferry.functions.tokens import Token, depths, tokens, unwrapped, written
from sparkferry.functions.types import NUMBERS, family, is_flag

# Functions that databases name differently, and spellings of true and false.
FUNCTIONS = {
    "now()": "current_timestamp", "current_timestamp": "current_timestamp", "current_timestamp()": "current_timestamp", "getdate()": "current_timestamp", "sysdatetime()": "current_timestamp",
    "current_date": "current_date", "current_date()": "current_date", "current_time": "current_time", "current_time()": "current_time",
    "uuid()": "uuid_function", "gen_random_uuid()": "uuid_function", "newid()": "uuid_function", "uuid_generate_v4()": "uuid_function",
}
TRUE, FALSE = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")
KNOWN = {*FUNCTIONS.values(), "nextval"}


@dataclass(frozen=True)
class Default:
    """A default's meaning. kind: none, text, number, bits, function (a name in KNOWN), or expression; text is the value itself."""

    kind: str
    text: str = ""


def _value(found: list[Token], dialect: str) -> list[Token]:
    """The tokens of the value alone: without parentheses, casts and what MySQL says about updates."""
    found = unwrapped(found)
    if dialect == "mysql":
        low = [t.low for t in found]
        cut = next((i for i in range(1, len(low) - 1) if low[i : i + 2] == ["on", "update"]), len(low))
        found = unwrapped(found[:cut])
    while dialect == "postgres":
        casts = [i for i, (t, d) in enumerate(zip(found, depths(found), strict=True)) if t.text == "::" and d == 0 and i]
        if not casts or not all(t.kind in ("word", "name", "number") or t.text in ".,()[]" for t in found[casts[-1] + 1 :]):
            break
        found = unwrapped(found[: casts[-1]])
    return found


def _called(found: list[Token]) -> str | None:
    """The name of the function that the tokens call, with its parentheses if it has some; None for anything else."""
    if len(found) == 1 and found[0].kind == "word":
        return found[0].low
    if len(found) > 2 and found[0].kind == "word" and found[1].text == "(" and min(depths(found)[1:]) == 1 and found[-1].text == ")":
        return found[0].low + "()"
    return None


def read_default(text: str | None, dialect: str) -> Default:
    found = _value(tokens((text or "").strip()), dialect.lower())
    if not found:
        return Default("none")
    called = _called(found)
    if called in FUNCTIONS:
        return Default("function", FUNCTIONS[called])
    if called == "nextval()" and dialect.lower() == "postgres":
        return Default("function", "nextval")
    if len(found) == 1 and found[0].kind in ("string", "name"):
        return Default("text", found[0].content)
    if len(found) == 2 and found[0].low in ("b", "x") and found[1].kind == "string" and not found[1].gap:
        return Default("bits", found[0].low + found[1].text)
    if found[-1].kind == "number" and (len(found) == 1 or len(found) == 2 and found[0].text in "+-"):
        return Default("number", "".join(t.text for t in found))
    if len(found) == 1 and found[0].low == "null":
        return Default("none")
    return Default("expression", written(found))


def default(text: str | None, dialect: str, fold: bool = True) -> str:
    """A default's canonical text, in lower case; '' for none, `null` where the catalog says so. With `fold` spellings of true and false are 1 and 0."""
    read = read_default(text, dialect)
    if read.kind == "none":
        return "null" if text and text.strip() else ""
    low = read.text.lower()
    if read.kind == "bits" and dialect.lower() == "mysql" and low[1:] in ("'0'", "'1'"):
        low = low[2]
    return low if read.kind == "function" or not fold or low not in TRUE + FALSE else "1" if low in TRUE else "0"


def is_null_or_function(canonical: str) -> bool:
    return canonical in ("", "null") or canonical in KNOWN


def same_default(a: str | None, b: str | None, a_dialect: str, b_dialect: str, type_: str, compat: bool = False) -> bool:
    """Whether two defaults mean the same for a type; numbers are compared as numbers, and spellings of true and false only
    match for booleans (compat: always)."""
    fold = compat or is_flag(type_)
    x, y = default(a, a_dialect, fold), default(b, b_dialect, fold)
    x, y = ("" if x == "null" else x), ("" if y == "null" else y)
    if x == y:
        return True
    if family(type_) not in NUMBERS or not x or not y:
        return False
    try:
        return Decimal(x) == Decimal(y) if family(type_) == "decimal" else float(x) == float(y)
    except (InvalidOperation, ValueError):
        return False


def action(text: str | None) -> str:
    """A foreign key's action; none is NO ACTION."""
    return (text or "").strip().upper() or "NO ACTION"


def collation(text: str | None) -> str:
    low = (text or "").strip().lower()
    return "" if low == "default" else low


def condition(text: str | None) -> str:
    """A condition or expression without comments, enclosing parentheses and extra blanks, in lower case."""
    return written(unwrapped(tokens(text or "")), lower=True)


def inside(text: str) -> str:
    """An expression as it is written, without enclosing parentheses and comments."""
    return written(unwrapped(tokens(text)))


def index(text: str | None) -> str:
    """An index's column list: the first parentheses of its definition, or all of a text without some."""
    found = tokens(text or "")
    inner = depths(found)
    start = next((i for i, t in enumerate(found) if t.text == "("), None)
    if start is not None:
        end = next((i for i in range(start, len(found)) if inner[i] == inner[start] and found[i].text == ")"), len(found) - 1)
        found = found[start : end + 1]
    return written(found, lower=True, tight="(),")
