"""Splitting texts into the words that byte-level tokenizers merge within."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: How tokenizers of this kind split text before their merges; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _members(class_: str) -> str:
    """The characters of a class among the first 256, as members of a set in the standard library's syntax."""
    has = regex.compile(class_).match
    return "".join(f"\\x{c:02x}" for c in range(256) if has(chr(c)))


def splitter(pattern: str = PATTERN) -> Callable[[str], list[str]]:
    """Text to words. With the pattern above, texts of the first 256 characters are split by the standard library, with the
    same classes spelt out, in half the time."""
    whole = regex.compile(pattern).findall
    if pattern != PATTERN:
        return whole
    letter, number, blank = _members(r"\p{L}"), _members(r"\p{N}"), _members(r"\s")
    short = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+").findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return short(text)

    return split


class Known(dict):
    """word -> bytes, worked out when first asked for."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        got = self[word] = self.encode(word)
        return got

    def joined(self, words: list[str]) -> bytes:
        """All words' bytes, one after the other. Beyond `most` words it forgets them all."""
        out = b"".join(map(self.__getitem__, words))
        if len(self) > self.most:
            self.clear()
        return out
