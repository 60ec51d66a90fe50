"""Tokens of short pieces of SQL: defaults, conditions, column lists, and scripts of statements."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<gap>(?:\s+|--[^\n]*|/\*.*?(?:\*/|\Z))+)"
    r"|(?P<string>'(?:[^']|'')*')"
    r"|(?P<name>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)"
    r"|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?!\w))"
    r"|(?P<word>\w[\w$]*)"
    r"|(?P<mark>::|.)",
    re.S,
)
_CLOSES = {"(": ")", "[": "]"}


@dataclass(frozen=True)
class Token:
    """kind is string, name (a quoted identifier), number, word or mark; gap tells that blanks or a comment stand before it."""

    kind: str
    text: str
    gap: bool = False

    @property
    def low(self) -> str:
        return self.text.lower()

    @property
    def content(self) -> str:
        """What a string or quoted name holds; the text of any other token."""
        if self.kind not in ("string", "name"):
            return self.text
        quote = self.text[0]
        return self.text[1:-1].replace(quote * 2, quote)


def tokens(sql: str) -> list[Token]:
    out, gap = [], False
    for m in _TOKEN.finditer(sql):
        if m.lastgroup == "gap":
            gap = True
        else:
            out.append(Token(m.lastgroup, m.group(), gap and bool(out)))
            gap = False
    return out


def depths(found: list[Token]) -> list[int]:
    """In how many parentheses or brackets each token stands; an opening one counts as inside, a closing one too."""
    out, depth = [], 0
    for t in found:
        depth += t.kind == "mark" and t.text in _CLOSES
        out.append(depth)
        depth -= t.kind == "mark" and t.text in _CLOSES.values()
    return out


def unwrapped(found: list[Token]) -> list[Token]:
    """Without the parentheses that enclose all."""
    while len(found) > 1 and found[0].text == "(" and found[-1].text == ")":
        inside = depths(found)
        if min(inside) < 1 or 1 in [d for d, t in zip(inside[1:-1], found[1:-1], strict=True) if t.text in ("(", ")")]:
            break
        found = found[1:-1]
    return found


def written(found: list[Token], lower: bool = False, tight: str = "") -> str:
    """The tokens as text with one blank for each gap, but none beside the marks in `tight`."""
    out = ""
    for before, t in zip([None, *found], found):
        if before and t.gap and not (tight and (t.text in tight or before.text in tight)):
            out += " "
        out += t.low if lower else t.text
    return out


def statements(script: str) -> list[list[Token]]:
    """The statements of a script, which semicolons part."""
    out: list[list[Token]] = [[]]
    for t in tokens(script):
        if t.kind == "mark" and t.text == ";":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]
