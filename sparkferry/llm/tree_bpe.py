"""Byte-level BPE encoding and decoding as a reduction over a tree.

encode(word) encodes its halves and joins them. Two encodings are joined by re-encoding the bytes around the seam; the
window grows until both of its ends are stable. When that is so is provable:

A sequence of tokens is the encoding of its bytes exactly if each two neighbours are, that is if encode(a + b) == [a, b].
(Forward: a merge that BPE makes inside a stretch of the result is the lowest-ranked, leftmost one there, so encoding the
stretch alone makes the same merges. Backward: take the first merge across a boundary of the sequence; until then each
neighbouring pair went as it goes alone, so that pair alone would make this merge too, and it wouldn't be [a, b].)

So where L and R are encodings, and W is that of the bytes of L's last i and R's first j tokens, L[:-i] + W + R[j:] is the
encoding if its neighbours at both ends of W fit. Where one doesn't, that side's window doubles, at most to all of L or R. So every word,
of any length, is halved and joined in the same way; a window is a leaf, whose bytes are merged from the start.
The join is associative, empty is neutral, and the encoding of a text's part never depends on where it was cut.
Results of words, halves and seams are remembered in a bounded table. Documents are mapped where they lie: no shuffle.
"""

from __future__ import annotations

import base64
import functools
import gc
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkferry.llm._frames import carried, ship, slices
from sparkferry.llm._split import Known, splitter

#: Remembered results in a worker, of halves and windows, and of words; beyond that it forgets them all.
CACHED, CACHED_WORDS = 100_000, 300_000
#: Bytes beyond which a window's next pair is found by a heap.
LONG_WINDOW = 256
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: Tokens whose bytes are joined directly, below which a decoding tree has no more branches.
LEAF_TOKENS = 4096


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.split = splitter(pattern)
        self.seams: dict[tuple[int, int], bool] = {}
        self.none = max(ranks.values(), default=0) + 1
        self.windows: dict[bytes, tuple[int, ...]] = {}
        gc.set_threshold(200_000, 20, 20)  # the tables hold no cycles; looking through them often is what costs
        self.small: dict[bytes, tuple[int, ...]] = {}
        self.words = Known(self.word, CACHED_WORDS)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The leaf step, which re-encodes a window: the lowest-ranked neighbours merge, the leftmost first, until none can. Short windows look
        through all their neighbours each time, which is quick; in longer ones a heap finds the next pair."""
        if (got := self.windows.get(data)) is not None:
            return got
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None and len(data) <= 2:
            return (whole,)
        if len(data) > LONG_WINDOW:
            return self._merge_by_heap(data)
        rank_of, none = ranks.get, self.none
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank_of(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != none:
            at = pairs.index(best)
            parts[at : at + 2] = [new := parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank_of(new + parts[at + 1], none)
            if at:
                pairs[at - 1] = rank_of(parts[at - 1] + new, none)
        if len(self.windows) >= CACHED:
            self.windows.clear()
        got = self.windows[data] = tuple([ranks[p] for p in parts])
        return got

    def _merge_by_heap(self, data: bytes) -> tuple[int, ...]:
        """`merge` in time n log n; such windows are not remembered. Places stay in order, so equal ranks come leftmost first."""
        n, rank_of = len(data), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a token begins at its place; -1 in ends marks a place that is gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            if (mid := ends[at]) == -1 or mid >= n or ends[mid] != end:
                continue  # one of the two has changed since
            ends[at], ends[mid] = end, -1
            if end < n:
                before[end] = at
                if (r := rank_of(data[at : ends[end]])) is not None:
                    heapq.heappush(heap, (r, at, ends[end]))
            if (left := before[at]) >= 0 and (r := rank_of(data[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[data[at : ends[at]]])
            at = ends[at]
        return tuple(out)

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        key = (a, b)
        if (got := self.seams.get(key)) is None:
            if len(self.seams) >= CACHED:
                self.seams.clear()
            got = self.seams[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == key
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encodings' bytes, one after the other."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            data = b"".join([self.bytes_of[t] for t in left[len(left) - i :] + right[:j]])
            mid = self.merge(data)
            low = i == len(left) or self.fits(left[-i - 1], mid[0])
            high = j == len(right) or self.fits(mid[-1], right[j])
            if low and high:
                return left[: len(left) - i] + mid + right[j:]
            i, j = (i if low else 2 * i), (j if high else 2 * j)

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        n = len(data)
        if n <= 1:
            return (self.ranks[data],) if n else ()
        if n <= 12:
            if (got := self.small.get(data)) is None:
                if len(self.small) >= CACHED:
                    self.small.clear()
                got = self.small[data] = self.join(self.encode_bytes(data[: n // 2]), self.encode_bytes(data[n // 2 :]))
            return got
        return self.join(self.encode_bytes(data[: n // 2]), self.encode_bytes(data[n // 2 :]))

    def word(self, word: str) -> bytes:
        ids = self.encode_bytes(word.encode())
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit: each match of the pattern by itself."""
        return self.words.joined(self.split(text))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids: leaves are joined directly, then neighbours are concatenated up the tree. An unknown id raises KeyError."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + LEAF_TOKENS])) for i in range(0, len(ids), LEAF_TOKENS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@functools.cache
def coder(path: str, pattern: str) -> TreeBPE:
    """A worker's own tables, which its later tasks use again."""
    return TreeBPE(read_ranks(path), pattern)


def _mapped(df: DataFrame, column: str, keep: tuple[str, ...], fields: str, work, path: str, pattern: str) -> DataFrame:
    ship(df.sparkSession)
    made = T._parse_datatype_string(fields)
    rows, kept, back = carried(df, column, keep, made.names)
    schema = T.StructType(kept + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for whole in batches:
            for batch in slices(whole, "in__") if pa.types.is_string(whole.schema.field("in__").type) or pa.types.is_large_string(whole.schema.field("in__").type) else [whole]:
                new = work(bpe, batch.column("in__").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + new, schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*back, *schema.names[len(kept) :])


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Each row's kept columns with ids: binary, little-endian unsigned 32-bit.

    A null text is empty and has no ids; special tokens' strings are ordinary text; repeated rows stay; an empty table gives
    an empty one; other columns may have any name. ranks: a file of base64 tokens and ranks, on every machine's disk.
    """
    path, pat = default_ranks()
    work = lambda bpe, texts: [pa.array([bpe.encode(s or "") for s in texts], pa.binary())]
    return _mapped(df, text, keep, "ids binary", work, ranks or path, pattern or pat)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None) -> DataFrame:
    """Each row's kept columns with the decoded bytes of binary ids; null ids decode to nothing."""
    path, pat = default_ranks()
    work = lambda bpe, rows: [pa.array([bpe.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in rows], pa.binary())]
    return _mapped(df, ids, keep, "decoded binary", work, ranks or path, pat)


