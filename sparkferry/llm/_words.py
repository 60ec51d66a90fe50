"""Words of many texts at once: their places and 64-bit hashes, by array operations over UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at a time; a longer word is hashed whole.
BLOCK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def letter_table(extra: dict[str, str] | None = None) -> np.ndarray:
    """Byte to letter, 0 for a separator: ASCII letters in lower case, digits, the underscore, and all bytes beyond ASCII.
    extra: ASCII characters that stand for others."""
    table = np.zeros(256, np.uint8)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    table[128:] = np.arange(128, 256)
    for a, b in (extra or {}).items():
        table[ord(a)] = ord(b)
    return table


LETTERS = letter_table()
#: Blanks, punctuation and signs beyond ASCII: parts of the Unicode blocks Latin-1, general punctuation, CJK symbols and half-width forms.
SEPARATORS = r"[\x{80}-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{D7}\x{F7}\x{1680}\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FEFF}\x{FF01}-\x{FF0F}]"


def folded(column: pa.Array) -> pa.Array:
    """Texts whose words compare as they should beyond ASCII too: in lower case, and with a blank for each separator."""
    if pc.all(pc.string_is_ascii(column)).as_py() is not False:
        return column
    return pc.replace_substring_regex(pc.utf8_lower(column), SEPARATORS, " ")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Each byte's value in the polynomials, and the powers that they share.
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_powers = np.zeros(0, np.uint64)
_inverses = np.zeros(0, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, BLOCK)
        one = np.ones(1, np.uint64)
        _powers = np.concatenate([one, np.cumprod(np.full(n - 1, BASE, np.uint64))])
        _inverses = np.concatenate([one, np.cumprod(np.full(n - 1, INVERSE, np.uint64))])
    return _powers, _inverses


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = LETTERS, stem: int = 0) -> tuple[np.ndarray, ...]:
    """(text, start, end, hash) of each word: runs of letters within a text, by place. Starts and ends count from offsets[0].
    With `stem`, a fifth array has the hashes of the words' first so many bytes.

    A word's hash is its polynomial modulo 2^64 over mixed byte values, mixed: equal words have equal hashes anywhere.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    seg = letters[data[low:high]]
    n = len(seg)
    if not n:
        none = np.zeros(0, np.int64)
        return (none, none, none, *[np.zeros(0, np.uint64)] * (1 + bool(stem)))
    inside = seg > 0
    edge = np.zeros(n + 1, bool)
    edge[(offsets - low)] = True  # between these no word goes on
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = np.empty(len(starts), np.uint64)
    cut = np.minimum(ends, starts + stem) if stem else ends
    stems = np.empty(len(starts), np.uint64) if stem else hashes
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        chunk = seg[base : ends[j - 1]]
        power, inverse = powers(len(chunk) + 1)
        sums = np.empty(len(chunk) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(VALUES[chunk] * power[: len(chunk)], out=sums[1:])
        hashes[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * inverse[starts[i:j] - base]
        if stem:
            stems[i:j] = (sums[cut[i:j] - base] - sums[starts[i:j] - base]) * inverse[starts[i:j] - base]
        i = j
    text = np.searchsorted(offsets - low, starts, "right") - 1
    return (text, starts, ends, mix(hashes), *([mix(stems)] if stem else []))


def hash_words(listed: list[str]) -> np.ndarray:
    """The hashes of single words, sorted."""
    out = []
    for w in listed:
        raw = np.frombuffer(w.encode(), np.uint8)
        got = words(raw, np.array([0, len(raw)]))[3]
        if len(got) != 1:
            raise ValueError(f"not one word: {w!r}")
        out.append(got[0])
    return np.unique(np.array(out, np.uint64))


def among(hashes: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether each hash is in a sorted list."""
    if not len(listed):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(listed, hashes)
    at[at == len(listed)] = 0
    return listed[at] == hashes
